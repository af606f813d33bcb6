"""The registered corpus queries: SQL where there is some, and the pipeline stage by stage."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsflow.llm import queries
from newsflow.llm.oracles import oracle_sql
from tests.check import compare, connect
from tests.llm.brute import near_duplicate_components
from tests.llm.test_tables import leaks

SMALL, FOLDER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    _, _, difference = compare(spark, connect(SMALL), name, SMALL)
    assert difference is None


def test_digest_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name in ("op2_quality_classifier", "op4_compression_rules", "op5_secret_scan", "op9_sharding", "op10_language_id"):
        assert queries.queries()[name](spark, SMALL).count() == docs
    none = hashlib.sha256(b"").hexdigest()
    clean = queries.op5_secret_scan(spark, SMALL).filter("n_assign + n_access + n_hex = 0").first()
    assert clean.base_sha256 == none


def test_pipeline_stages(spark):
    """Each stage against its own input."""
    stages = [stage for _, stage in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("labels", "benchmark"))
    columns = docs.columns

    good = stages[0](spark, docs, FOLDER).cache()
    assert good.columns == columns
    marked = {r.doc_id: r.quality for r in labels.collect()}
    kept = {r.doc_id for r in good.select("doc_id").collect()}
    wrong = [i for i, q in marked.items() if (i in kept) != (q == 1)]
    assert len(wrong) <= 0.02 * len(marked)

    groups = near_duplicate_components([(r.doc_id, r.text) for r in good.collect()])
    single = stages[1](spark, good, FOLDER).cache()
    assert single.columns == columns
    assert sorted(r.doc_id for r in single.collect()) == sorted({root for _, root in groups.values()})

    found = leaks([(r.doc_id, r.text) for r in single.collect()], [(r.item_id, r.text) for r in items.collect()])
    clean = stages[2](spark, single, FOLDER).cache()
    assert clean.columns == columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, (_, hit, _) in found.items() if not hit)

    mixed = stages[3](spark, clean, FOLDER).cache()
    assert mixed.columns == columns
    copies = mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert 1 <= copies <= 3

    rows = stages[4](spark, mixed, FOLDER).collect()
    pieces = sum(1 for r in rows for start in r.piece_starts if start == 0)
    assert pieces == mixed.count()
