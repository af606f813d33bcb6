"""Physical plans: what must be pushed down, and what must never appear."""

from __future__ import annotations

import io
import os
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from newsflow import schemas
from workload.queries import queries
from newsflow.operators import articles as art
from newsflow.operators import dedup, feed, images, sentiment
from newsflow.operators.stock_match import assign_stock
from newsflow.sources import payloads

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture
def big(spark, tmp_path):
    """A table Spark must not broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = spark.range(1000).selectExpr(
        "concat('u', id) url", "id n", "repeat('x', 100) body", "cast(null as string) image_url", "'T' title"
    )
    rows.write.parquet(str(tmp_path / "t"))
    yield spark.read.parquet(str(tmp_path / "t"))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# Their work is done when the plan of their result is made.
JOBS = {"stream_ingest_runs", "csv_scan_broken", "load_news_job", "csv_scan", "csv_scan_sentiment", "csv_scan_daily", "daily_rollup", "news_page_deep"}


@needs_tables
@pytest.mark.parametrize("name", sorted(set(queries()) - JOBS))
def test_no_python_workers_and_no_products(spark, name):
    text = plan(queries()[name](spark, SF_DIR))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "MapInArrow"):
        assert operator not in text


def test_hot_keys_are_limited_before_the_shuffle(big):
    text = plan(dedup.first_seen(big, ["url"], ["n"]))
    assert text.count("WindowGroupLimit") >= 2


def test_dedup_and_stored_check_share_one_shuffle(big):
    unique = dedup.first_seen(big, ["url"], ["n"])
    text = plan(art.new_rows(unique, big))
    shuffles = text.split("\n\n\n")[0].count("Exchange")
    assert shuffles == 2, text


def test_stored_check_reads_the_key_only(big):
    text = plan(art.new_rows(big.limit(5), big))
    assert "ReadSchema: struct<url:string>" in text


def test_only_pages_of_lacking_articles_are_searched(big):
    pages = big.withColumnRenamed("body", "html")
    tree = images.extract_images(big, pages)._jdf.queryExecution().executedPlan().toString()
    assert tree.index("element_at") < tree.index("LeftSemi")
    assert "PushedFilters: [IsNull(image_url), IsNotNull(url)]" in plan(images.extract_images(big, pages))


def test_first_pages_are_a_top_k(big):
    timed = big.withColumn("t", F.timestamp_seconds("n"))
    text = plan(feed.news_page(timed, 3, 100, time="t", tie="url"))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_payloads_are_scanned_once_per_use(spark, tmp_path):
    path = str(tmp_path / "landed")
    body = F.lit("[]").alias("body")
    spark.range(10).select(
        F.lit("r").alias("run_id"), F.lit("Finnhub").alias("provider"), F.lit("A").alias("symbol"),
        F.col("id").cast("int").alias("seq"), F.lit(200).alias("status"), body,
    ).write.parquet(path)
    landed = payloads.read_payloads(spark, path, "parquet")
    text = plan(payloads.normalize(landed))
    assert text.count("Scan parquet") // 2 == 1 and "Exchange" not in text
    assert "PushedFilters: [In(provider" in text


def test_articles_are_rolled_up_by_hash(big):
    """Only the few rows per stock, symbol and day are compared in order."""
    scored = big.select(
        F.lit(1).cast("bigint").alias("stock_id"), F.col("url").alias("symbol"), F.timestamp_seconds("n").alias("published_at"),
        F.lit("positive").alias("sentiment_label"),
        *[F.lit(0.5).alias(c) for c in ("positive_score", "neutral_score", "negative_score", "sentiment_score")])
    tree = sentiment.daily_sentiment(scored)._jdf.queryExecution().executedPlan().toString()
    by_hash = tree[tree.index("HashAggregate"):]
    assert by_hash.count("HashAggregate") == 2 and "Sort" not in by_hash


def test_many_folders_are_listed_by_a_bounded_number_of_tasks(spark, tmp_path):
    folders = [tmp_path / f"run={n}" for n in range(300)]
    for folder in folders:
        folder.mkdir()
        (folder / "a.json").write_text('{"run_id": "r", "seq": 1}\n')
    context = spark.sparkContext
    try:
        context.setJobGroup("listing", "listing")
        landed = payloads.read_payloads(spark, [str(f) for f in folders])
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    status = context.statusTracker()
    stages = [s for job in status.getJobIdsForGroup("listing") for s in status.getJobInfo(job).stageIds]
    assert 0 < sum(status.getStageInfo(s).numTasks for s in stages) <= 200
    assert landed.count() == 300


def test_a_join_by_symbol_does_not_search_the_texts_again(spark):
    """It drops NULL keys, and the symbol is computed from the text."""
    rows = [("u1", "AMD", "t", "d"), ("u2", "", "Acme", None), ("u3", None, "t", "d"), ("u4", "", "ACME", "x")]
    rows = spark.createDataFrame(rows, "url string, symbol string, title string, description string")
    rows = rows.withColumn("n", F.length("url"))
    stocks = spark.createDataFrame([(1, "AMD"), (2, "ACM")], schemas.STOCKS)
    linked = art.attach_stock_id(assign_stock(rows, {"ACM": ("acme", "roadrunner")}), stocks)
    assert sorted(map(tuple, linked.select("url", "symbol", "stock_id").collect())) == [
        ("u1", "AMD", 1), ("u2", "ACM", 2), ("u4", "ACM", 2)]
    text = linked._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("lower(") == 2  # the test whether a row stays, and the text of the match
