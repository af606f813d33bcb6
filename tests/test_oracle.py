"""Every registered query against the same result in SQL."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.check import compare, connect
from workload import oracles
from workload import queries as workload_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    """Of the library proper; the corpus queries have tests of their own."""
    assert sorted(workload_queries.queries()) == sorted(oracles.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    _, _, difference = compare(spark, con, name, SF_DIR)
    assert difference is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_streamed_runs_grow_with_the_table(spark):
    """A limit cuts a provider in its own run only; the next runs are stored whole."""
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    con = connect(folder)
    got, want, difference = compare(spark, con, "stream_ingest_runs", folder)
    assert difference is None and got == want
    texts, = con.execute("SELECT count(DISTINCT text) FROM documents").fetchone()
    assert 0.8 * texts < got / 2 < texts
