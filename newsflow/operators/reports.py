"""Counts a run reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.operators.articles import mark_stored
from newsflow.operators.dedup import first_seen
from newsflow.operators.filters import valid_articles
from newsflow.operators.stock_match import stock_symbol, with_match_text
from newsflow.session import exists
from newsflow.stocks import ALIASES


def provider_counts(articles: DataFrame, providers: DataFrame) -> DataFrame:
    """Articles delivered per configured provider, zero for a silent one."""
    counts = articles.groupBy("source_api").agg(F.count("*").alias("articles"))
    return (
        providers.select("source_api")
        .join(counts, "source_api", "left")
        .withColumn("articles", F.coalesce("articles", F.lit(0).cast("bigint")))
    )


# How a run reports the final state of a provider.
LIMIT_HIT = "LIMIT HIT - DISABLED THIS RUN"
ACTIVE = "ACTIVE"


def provider_status(requests: DataFrame, is_limit: Column, providers: DataFrame) -> DataFrame:
    """Final state per configured provider, also a silent one."""
    limited = requests.filter(is_limit).select("provider").distinct()
    names = providers.select(F.col("source_api").alias("provider"))
    hit = names.join(limited.withColumn("_hit", F.lit(True)), "provider", "left")
    return hit.select(
        "provider", F.when(F.col("_hit"), LIMIT_HIT).otherwise(ACTIVE).alias("status"))


def run_funnel(
    articles: DataFrame,
    stored: DataFrame,
    stocks: DataFrame,
    order: Sequence[str],
    aliases: Mapping[str, Sequence[str]] = ALIASES,
) -> DataFrame:
    """Rows left after each step of a collector run, one row per step.

    Everything after deduplication is a flag on one pass and one global
    aggregate, so a single row leaves each task. Texts of articles that are
    stored already are not searched.
    """
    raw = articles.agg(F.count("*").alias("raw"))
    unique = first_seen(valid_articles(articles), ["url"], order)
    marked = with_match_text(mark_stored(unique, stored))
    symbol = F.when(~F.col("is_stored"), stock_symbol(F.col("_match_text"), F.col("symbol"), aliases))
    ids = stocks.select("symbol", F.lit(True).alias("has_stock")).distinct()
    linked = marked.select("is_stored", symbol.alias("symbol")).join(ids, "symbol", "left")

    new = ~F.col("is_stored")
    assigned = F.col("symbol").isNotNull()
    counts = linked.agg(
        F.count("*").alias("unique"),
        F.count_if("is_stored").alias("already_stored"),
        F.count_if(new).alias("new"),
        F.count_if(new & ~assigned).alias("unmatched"),
        F.count_if(assigned).alias("assigned"),
        F.count_if(F.col("has_stock").isNotNull()).alias("inserted"),
    )

    def steps(one_row: DataFrame) -> DataFrame:
        pairs = [F.struct(F.lit(n).alias("step"), F.col(n).alias("rows")) for n in one_row.columns]
        return one_row.select(F.inline(F.array(*pairs)))

    return steps(raw).unionByName(steps(counts))


def load_summary(outcome: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """Counts per symbol and, with NULL as symbol, the grand total.

    The rows are aggregated per symbol first; the rollup then runs on one row
    per symbol instead of doubling every input row.
    """
    per_symbol = outcome.groupBy("symbol").agg(*[c.alias(n) for n, c in counts.items()])
    return per_symbol.rollup("symbol").agg(
        *[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in counts]
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table; no column is read."""
    return _union(
        [
            df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
            for name, df in tables.items()
        ]
    )


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def stored_counts(spark: SparkSession, paths: Mapping[str, str | None]) -> DataFrame:
    """Row count per stored table; a table that is not there, or named, gets NULL."""
    nothing = spark.range(1).select(F.lit(None).cast("bigint").alias("rows"))
    counts = [
        spark.read.parquet(p).agg(F.count("*").alias("rows")) if p and exists(spark, p) else nothing
        for p in paths.values()
    ]
    return _union([c.select(F.lit(n).alias("table_name"), "rows") for n, c in zip(paths, counts)])


def catalog_counts(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """Row count per catalog table; a table that does not exist gets NULL."""
    nothing = spark.range(1).select(F.lit(None).cast("bigint").alias("rows"))
    counts = [
        spark.table(n).agg(F.count("*").alias("rows")) if spark.catalog.tableExists(n) else nothing
        for n in names
    ]
    return _union([c.select(F.lit(n).alias("table_name"), "rows") for n, c in zip(names, counts)])
