"""Operator 9: sharding by a minimax contiguous partition, in DataFrame functions only.

Documents with equal texts form a group that is never split. Groups are put in one
order, that of their text's hash, and cut into contiguous runs, one per shard, so
that the largest shard is as small as it can be. That capacity is found by search:
a capacity is feasible if filling shards greedily up to it needs no more shards
than there are. Each pass tries many capacities at once; one step of all of them
is an aggregate over the part of the group table where their cuts can fall.

A NULL text has no bytes and is one group with the other NULL texts, apart from
the empty ones. Rows with equal ids and texts are ordered arbitrarily but each gets
a slot of its own. An empty table gives an empty result; shards may be empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm.prefix_sums import running_sums
from newsflow.session import settled

_TRIED = 48  # capacities tried in one pass


def _farthest(groups: DataFrame, at: list[int], capacities: list[int], total: int, largest: int) -> list[int]:
    """The last group end within each capacity of each cut; the cut itself at the end.

    No group is larger than ``largest``, so only ends that close before the
    shortest reach can be wanted.
    """
    reach = [min(a + c, total) for a, c in zip(at, capacities)]
    end = F.col("end_bytes")
    near = groups.filter(end.between(min(reach) - largest, max(reach)))
    row = near.agg(*[F.max(F.when(end <= r, end)).alias(f"c{i}") for i, r in enumerate(reach)]).first()
    return [a if row[i] is None else max(a, row[i]) for i, a in enumerate(at)]


def _greedy(
    groups: DataFrame, capacities: list[int], shards: int, total: int, largest: int
) -> list[list[int]]:
    """The cuts of a greedy filling, for each capacity."""
    at = [0] * len(capacities)
    cuts: list[list[int]] = [[] for _ in capacities]
    for _ in range(shards):
        at = _farthest(groups, at, capacities, total, largest)
        for own, a in zip(cuts, at):
            own.append(a)
    return cuts


def minimax_cuts(groups: DataFrame, shards: int) -> list[int]:
    """Ends of the shards under the smallest feasible capacity.

    ``groups`` has one row per group: ``size`` and ``end_bytes``, the running sum.
    """
    total, largest = groups.agg(F.max("end_bytes"), F.max("size")).first()
    if total is None:
        return [0] * shards
    # A capacity of an even share and one largest group is always enough.
    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest
    cuts = None
    while low < high or cuts is None:
        count = min(_TRIED, high - low + 1)
        tried = sorted({low + (high - low) * i // max(count - 1, 1) for i in range(count)})
        found = _greedy(groups, tried, shards, total, largest)
        feasible = [i for i, own in enumerate(found) if own[-1] >= total]
        best = feasible[0]
        cuts, high = found[best], tried[best]
        low = tried[best - 1] + 1 if best else high
    return cuts


def shard_documents(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Size, shard and gapless slot of every document."""
    text = F.col(text_col).cast("string")
    narrow = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.lit("")).alias("group"),
    ).withColumn("one", F.lit(1).cast("long"))
    sums = {"end_bytes": "size", "end_rows": "one"}
    placed = settled(running_sums(narrow, ["group", "id"], sums, name="by-text"), "placed")
    groups = placed.groupBy("group").agg(F.max("end_bytes").alias("end_bytes"), F.sum("size").alias("size"))
    # Sorted by position, so that a search step reads only where its cuts can fall.
    groups = settled(groups.select("end_bytes", "size").repartitionByRange("end_bytes").sortWithinPartitions("end_bytes"), "groups")
    cuts = minimax_cuts(groups, shards)

    # Cuts are group ends, so a row lies before a cut exactly if its group does.
    shard: Column = F.lit(shards - 1)
    for k in reversed(range(shards - 1)):
        shard = F.when(F.col("end_bytes") <= cuts[k], F.lit(k)).otherwise(shard)
    marked = placed.withColumn("shard", shard)
    # Rows before each shard: at most one row per shard.
    rows = marked.groupBy("shard").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.select("shard", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return marked.join(F.broadcast(starts), "shard").select(
        F.col("id").alias(id_col), "size", "text_crc32",
        F.col("shard").cast("int").alias("shard"),
        (F.col("end_rows") - 1 - F.col("_start")).alias("slot"),
    )
