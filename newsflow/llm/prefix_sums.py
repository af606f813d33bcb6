"""Running sums over a total order, without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsflow.session import settled


def running_sums(
    rows: DataFrame, order: Sequence[str], sums: dict[str, str], by: Sequence[str] = (), name: str = "ordered"
) -> DataFrame:
    """Add a running sum of each row and everything before it, per ``by``.

    ``sums`` maps new columns to the columns summed. Rows are dealt by ranges of
    ``by`` and ``order``, so a hot group spreads over many tasks; each range is
    summed on its own and the totals of the ranges before it are added. Ranges are
    written first, so both passes see the same ones. ``order`` should be unique.
    """
    ranged = rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id())
    ranged = settled(ranged, name)
    # One row per range and group: as many as there are tasks, or groups.
    totals = ranged.groupBy("_range", *by).agg(*[F.sum(c).alias(f"_{new}") for new, c in sums.items()])
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = totals.select(
        "_range", *by,
        *[F.coalesce(F.sum(f"_{new}").over(before), F.lit(0)).alias(f"_{new}") for new in sums],
    )
    within = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    summed = ranged.select("*", *[F.sum(c).over(within).alias(f"_in_{new}") for new, c in sums.items()])
    keys = ["_range", *by]
    matches = [summed[k].eqNullSafe(starts[k]) for k in keys]
    joined = summed.join(starts, matches)
    return joined.select(
        *[summed[c] for c in rows.columns],
        *[(summed[f"_in_{new}"] + starts[f"_{new}"]).alias(new) for new in sums],
    )
