"""Session settings and the shared folder."""

from __future__ import annotations

import threading

import pytest

from newsflow import session


class Conf(dict):
    def set(self, key, value):
        self[key] = value


class Context:
    applicationId = "app-1"

    def __init__(self, master):
        self.master = master


class Session:
    def __init__(self, master, **conf):
        self.conf, self.sparkContext = Conf(conf), Context(master)


def test_the_configured_folder_is_used(spark):
    assert session.shared_dir(Session("yarn", **{"spark.checkpoint.dir": "s3://b/c/"})) == "s3://b/c"
    assert session.shared_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir") + "/x-")


def test_only_a_local_session_may_leave_it_unset():
    local = Session("local[2]")
    assert session.shared_dir(local) == session.shared_dir(local)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session("spark://host:7077"))


def test_settings(spark):
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert session.configure(spark) is spark


def test_settled_tables_have_a_known_size(spark):
    df = session.settled(spark.range(5).selectExpr("id", "id % 2 = 0 even"), "t")
    assert df.count() == 5
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(size)) < 10_000


def test_nested_blocks_that_write_nothing(spark):
    """An inner block ends without touching the outer one, equal as their lists may be."""
    with session.scratch(spark):
        with session.scratch(spark):
            pass
        inner = session.settled(spark.range(3), "t")
        assert inner.count() == 3
        with session.scratch(spark):
            outlives = session.settled(spark.range(4), "t", outlives=True)
        assert outlives.count() == 4
    assert not session.exists(spark, inner.inputFiles()[0].rsplit("/", 1)[0])


def test_a_block_of_another_thread_keeps_its_tables(spark):
    """A block that ends removes only what its own thread has written."""
    written, go_on, tables = threading.Event(), threading.Event(), []

    def other():
        with session.scratch(spark):
            tables.append(session.settled(spark.range(5), "other"))
            written.set()
            go_on.wait(60)
            tables.append(tables[0].count())

    thread = threading.Thread(target=other)
    with session.scratch(spark):
        thread.start()
        assert written.wait(60)
        session.settled(spark.range(2), "own")
    go_on.set()
    thread.join()
    assert tables[1] == 5
