"""Deduplication with an explicit order.

One row per key is kept by row number. Spark limits each key before the shuffle
as well, so a task sends one row per key however often a hot key repeats, and
the result does not depend on partitioning. The order columns must identify a
row within its key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first_row(df: DataFrame, keys: Sequence[str], order: list[Column]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(window)).filter("_row = 1").drop("_row")


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the given order."""
    return _first_row(df, keys, [F.asc(c) for c in order])


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key in the given order."""
    return _first_row(df, keys, [F.desc(c) for c in order])


def distinct_urls(articles: DataFrame) -> DataFrame:
    """Distinct URLs that are neither NULL nor empty."""
    return articles.select("url").filter(F.col("url") != "").distinct()
