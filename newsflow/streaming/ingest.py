"""Incremental collector: finished runs to stored articles.

The stream reads run manifests, not response files. A manifest is written when all
responses of its run have landed, so a micro-batch always holds whole runs, however
many files they have and however many runs a trigger takes; provider order and the
breaker hold inside a run, and runs are stored in the order they began. A repeated
batch adds nothing, because its URLs are stored already, so the job can be restarted
at any point, also from an empty checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsflow import schemas
from newsflow.operators.articles import new_rows_probed
from newsflow.plans.collector import (
    collect_records,
    run_articles,
    store_articles,
    unique_articles,
)
from newsflow.session import configure, scratch
from newsflow.sinks.writers import read_table
from newsflow.sources.payloads import read_payloads
from newsflow.stocks import ALIASES

# Spark's own setting: sessions are merged before the shuffle, too.
_MERGE_EARLY = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def run_stream(spark: SparkSession, path: str, runs_per_batch: int | None = None) -> DataFrame:
    """Stream of run manifests, one JSON file per finished run."""
    stream = spark.readStream.schema(schemas.RUN_MANIFEST).format("json")
    if runs_per_batch:
        stream = stream.option("maxFilesPerTrigger", runs_per_batch)
    return stream.load(path)


def batch_loader(
    articles_path: str,
    stocks: DataFrame,
    aliases: Mapping[str, Sequence[str]] | DataFrame = ALIASES,
    read: Callable[[SparkSession, list[str]], DataFrame] = read_payloads,
) -> Callable[[DataFrame, int], None]:
    """The function that stores the runs of one micro-batch."""

    def load(batch: DataFrame, _: int) -> None:
        # A streaming session may have adaptive execution off; the batch jobs need it.
        spark = configure(batch.sparkSession)
        # One small row per finished run.
        manifests = batch.collect()
        if not manifests:
            return
        runs = spark.createDataFrame(manifests, schemas.RUN_MANIFEST)
        landed = read(spark, sorted({row["path"] for row in manifests})).drop("started_at")
        payloads = landed.join(runs.select("run_id", "started_at").distinct(), "run_id")
        with scratch(spark):
            unique = unique_articles(run_articles(payloads)).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                stored = read_table(spark, articles_path, schemas.NEWS_ARTICLES)
                records = collect_records(unique, stored, stocks, aliases, new_rows_probed)
                store_articles(spark, articles_path, records)
            finally:
                unique.unpersist()

    return load


def start_ingest(
    stream: DataFrame, checkpoint: str, loader: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    """Process all runs finished so far, then stop."""
    return (
        stream.writeStream.foreachBatch(loader)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def drop_recent_repeats(articles: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Drop URLs repeated within ``delay`` of event time on a stream.

    Keeps whichever copy arrives first, not the copy of the first provider, so it
    may thin out a single provider's stream but does not replace the ordered
    deduplication.
    """
    return articles.withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["url"])


def first_of_repeats(
    articles: DataFrame,
    order: Sequence[str],
    gap: str = "2 hours",
    delay: str = "2 hours",
    time: str = "published_at",
    undated: str | None = None,
    key: str = "url",
) -> DataFrame:
    """Of copies of a URL at most ``gap`` apart in a chain, the first in the given order.

    The same rows on a stream as on a table, whatever the order of arrival: a chain of
    copies is a session whose state holds its first row only, and it is given out once
    the watermark has passed its end, when no copy can join it any more. On a stream rows
    more than ``delay`` behind the newest one are late and are left out; chains that are
    still open stay in the state until later rows close them.

    ``order`` must identify a row within its key, up to equal rows. Rows without a time
    take ``undated``; those that have none then, or no key, are left out. Copies of a hot
    URL are merged before the shuffle as well.
    """
    columns = articles.columns
    at = F.coalesce(time, undated) if undated else F.col(time)
    held = [c for c in columns if c not in (*order, key)]
    # One struct, first by order; NULLs come first, as in a sort.
    row = F.struct(*order, *[F.col(c).alias(c) for c in held])
    timed = articles.select(F.col(key), at.cast("timestamp").alias("_event"), row.alias("_row"))
    timed = timed.filter(F.col(key).isNotNull() & F.col("_event").isNotNull())
    timed = timed.withWatermark("_event", delay)
    timed.sparkSession.conf.set(_MERGE_EARLY, "true")
    first = timed.groupBy(key, F.session_window("_event", gap)).agg(F.min("_row").alias("_row"))
    return first.select(key, "_row.*").select(*columns)
