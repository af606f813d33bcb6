"""Insert-if-absent, upsert and fill-missing as (target, source) -> new target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.operators.articles import new_rows
from newsflow.operators.dedup import last_wins


def _aligned(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source columns in the target's order; columns it lacks are NULL."""
    types = dict(target.dtypes)
    return source.select(
        *[
            F.col(c) if c in source.columns else F.lit(None).cast(types[c]).alias(c)
            for c in target.columns
        ]
    )


def insert_if_absent(target: DataFrame, source: DataFrame, key: str = "url") -> DataFrame:
    """Target plus the source rows whose key it does not hold.

    ``source`` has one row per key. Stored rows are not touched.
    """
    return target.unionByName(_aligned(new_rows(source, target, key), target))


def upsert_last_wins(
    target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Target with the last source row per key in place of its own row.

    Stored and new rows meet in one shuffle: per key the last source row wins over
    the stored one, by one limited row number. NULL keys are keys like others.
    """
    by = {f"_by_{c}": F.col(c) for c in order}
    fresh = source.withColumns(by).withColumn("_new", F.lit(1))
    columns = [*target.columns, "_new", *by]
    types = dict(fresh.dtypes) | dict(target.dtypes)
    stored = target.select(
        *target.columns, F.lit(0).alias("_new"), *[F.lit(None).cast(types[c]).alias(c) for c in by])
    fresh = fresh.select(
        *[F.col(c) if c in fresh.columns else F.lit(None).cast(types[c]).alias(c) for c in columns])
    latest = last_wins(stored.unionByName(fresh), keys, ["_new", *by])
    return latest.select(*target.columns)


def fill_missing(
    target: DataFrame, source: DataFrame, key: str = "url", value: str = "image_url"
) -> DataFrame:
    """Target with NULL values filled from the source row of the same key.

    Values already present stay, and no row is multiplied: a key that the source
    repeats gives its smallest value.
    """
    found = source.filter(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias("_value"))
    filled = F.coalesce(F.col(value), F.col("_value"))
    return target.join(found, key, "left").withColumn(value, filled).select(*target.columns)
