"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.session import settled


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest vertex reachable from each vertex of ``edges`` (a, b): (vertex, component).

    Every round a vertex takes the smallest label among itself and its
    neighbours, then that label's own label. Each round is written to the shared
    folder, so the plan does not grow and a lost executor costs one round. Labels
    are partially aggregated, so a vertex with many neighbours is no hot spot.
    """
    forward = edges.select("a", "b").filter("a <> b")
    both = forward.unionByName(forward.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = settled(both.distinct(), name)
    labels = settled(
        both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component"))
        .withColumnRenamed("a", "vertex"),
        name,
    )
    while True:
        seen = both.join(labels.select("vertex", "component"), both["b"] == labels["vertex"])
        own = labels.select(F.col("vertex").alias("a"), "component", F.col("component").alias("was"))
        near = seen.select("a", "component", F.lit(None).cast("long").alias("was")).unionByName(own)
        least = near.groupBy("a").agg(F.min("component").alias("near"), F.max("was").alias("was"))
        jump = labels.select(F.col("vertex").alias("near"), F.col("component").alias("far"))
        stepped = least.join(jump, "near", "left").select(
            F.col("a").alias("vertex"),
            F.least("near", F.coalesce("far", "near")).alias("component"),
            "was",
        )
        labels = settled(stepped, name)
        if labels.filter("component <> was").isEmpty():
            return labels.select("vertex", "component")
