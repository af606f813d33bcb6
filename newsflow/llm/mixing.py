"""Operator 8: mix sources to target weights, in DataFrame functions only.

Sources, in code point order with NULL last, weigh 5, 2, 1 and so on in turn. The
mix has as many words as all documents together; a source's target is its share by
weight, at most ``MOST_EPOCHS`` times its own words, and what that leaves over is
shared by weight among the others.

Each source's documents are shuffled by a hash of their id and laid end to end,
epoch after epoch, and cut into blocks of equally many words. The mix is a row of
slots. Slot i takes the point frac(i * golden ratio) and belongs to the source in
whose interval of cumulative targets that point falls, so every stretch of the mix
is close to the targets; the k-th slot of a source holds its k-th block. Running
numbers are made over ranges, so a hot source is spread over many tasks.

A NULL text has no words. Documents without words are never taken. Rows with equal
ids are laid side by side, each with its own share. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsflow.llm.prefix_sums import running_sums
from newsflow.session import settled

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
_MOST_BLOCK = 4096  # words
_SLOTS = 1 << 17  # blocks are cut smaller until there are about as many
_CELLS = 1 << 16
_GOLDEN = 2654435769  # 2^32 / golden ratio, odd

WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame) -> DataFrame:
    """Target words of each source, from (source, source_size): one row per source.

    The level L with sum(min(cap, L * weight)) = total is found from running sums
    in the order in which sources reach their caps.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(w) for w in WEIGHTS])
    number = F.row_number().over(by_name) - 1
    rows = sources.withColumn("number", number.cast("long")).withColumn(
        "weight", F.element_at(turn, (F.col("number") % len(WEIGHTS) + 1).cast("int")).cast("long"))
    rows = rows.withColumn("cap", F.col("source_size") * MOST_EPOCHS)
    everything = Window.partitionBy(F.lit(0))
    by_cap = everything.orderBy(F.col("cap") / F.col("weight"), "number")
    earlier = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    rows = rows.withColumn("level", left / weights)
    # The first source that its level does not fill sets the level of all after it.
    open_ = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    first_open = F.first(open_, ignorenulls=True).over(
        by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("cap").cast("double"), first_open * F.col("weight"))
    return rows.select("source", "number", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _source_of(slots: DataFrame, sources: DataFrame, total: float) -> DataFrame:
    """Slots with the source in whose interval of cumulative targets their point falls.

    Points and intervals meet in equal cells: a source has a row for each cell it
    overlaps, so this is an equality join however many sources there are.
    """
    running = Window.partitionBy(F.lit(0)).orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    high = F.least(F.sum("target").over(running) / total, F.lit(1.0))
    intervals = sources.filter("target > 0").select("number", high.alias("high"))
    low = F.coalesce(F.lag("high").over(Window.partitionBy(F.lit(0)).orderBy("number")), F.lit(0.0))
    last = F.max("number").over(Window.partitionBy(F.lit(0)))
    intervals = intervals.select(
        "number", low.alias("low"), F.when(F.col("number") == last, 1.0).otherwise(F.col("high")).alias("high"))
    first_cell = F.floor(F.col("low") * _CELLS)
    last_cell = F.least(F.floor(F.col("high") * _CELLS), F.lit(_CELLS - 1))
    cells = intervals.withColumn("cell", F.explode(F.sequence(first_cell, last_cell)))
    points = slots.withColumn("cell", F.floor(F.col("point") * _CELLS))
    inside = (F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))
    return points.join(cells, "cell").filter(inside).select("slot", "number")


def slots_of(spark: SparkSession, sources: DataFrame, total: int, block: int) -> DataFrame:
    """The schedule: slot, source number, and rank among the slots of its source."""
    count = -(-total // block)
    turned = (F.col("id") % (1 << 31)) * _GOLDEN % (1 << 32)
    slots = spark.range(count).select(F.col("id").alias("slot"), (turned / float(1 << 32)).alias("point"))
    owned = _source_of(slots, sources, float(total)).withColumn("one", F.lit(1).cast("long"))
    ranked = running_sums(owned, ["slot"], {"rank": "one"}, by=["number"], name="slots")
    return ranked.select("slot", "number", (F.col("rank") - 1).alias("block"))


def version_of(text: Column) -> Column:
    """What tells documents of one id apart."""
    return F.xxhash64(text.cast("string"))


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Id, source, number of words and version (a hash of the text) of each document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), version_of(F.col(text_col)).alias("version"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> tuple[DataFrame, DataFrame]:
    """The mix as pieces, and its totals per document.

    Pieces: slot, source, id, epoch, and the words [first_word, first_word + words)
    of the document that the slot takes; within a slot by ``place``. Totals: id,
    size, source, source_size, target, taken (words over all epochs), copies
    (epochs that take any of it) and version (:func:`version_of` its text).
    """
    spark = docs.sparkSession
    narrow = settled(measured(docs, id_col, text_col, source_col), "sizes")
    sources = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = settled(targets(sources), "targets")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    block = max(1, min(_MOST_BLOCK, total // _SLOTS))

    numbered = narrow.join(sources, narrow["source"].eqNullSafe(sources["source"])).select(
        "id", "size", "version", "number", F.md5(F.col("id").cast("string")).alias("shuffled"))
    laid = settled(running_sums(
        numbered.filter("size > 0"), ["shuffled", "id", "size", "version"], {"end": "size"}, by=["number"], name="laid"), "laid")

    slots = settled(slots_of(spark, sources, total, block), "schedule")
    taken_blocks = slots.groupBy("number").agg(F.max("block").alias("last_block"))
    # Written, so that its real size decides how the hot source's rows meet it.
    sized = settled(sources.join(taken_blocks, "number").select("number", "source_size", "last_block"), "sized")
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(MOST_EPOCHS - 1).cast("long")))
    start = F.col("epoch") * F.col("source_size") + F.col("end") - F.col("size")
    placed = (
        laid.join(sized, "number")
        .withColumn("epoch", epochs)
        .withColumn("place", start)
        .filter(F.floor(F.col("place") / block) <= F.col("last_block"))
    )
    blocks = F.sequence(F.floor(F.col("place") / block), F.floor((F.col("place") + F.col("size") - 1) / block))
    cut = placed.withColumn("block", F.explode(blocks))
    low = F.greatest(F.col("block") * block, F.col("place"))
    high = F.least((F.col("block") + 1) * block, F.col("place") + F.col("size"))
    pieces = cut.join(slots, ["number", "block"]).select(
        "slot", "number", "id", "end", "size", "version", "epoch", low.alias("place"),
        (low - F.col("place")).alias("first_word"), (high - low).alias("words"))
    pieces = settled(pieces, "pieces")

    per_doc = pieces.groupBy("number", "end", "id", "size", "version").agg(
        F.sum("words").alias("taken"), (F.max("epoch") + 1).alias("copies"))
    own = laid.select("number", "end", "id", "size", "version")
    untaken = own.join(per_doc.select("number", "end"), ["number", "end"], "left_anti").unionByName(
        numbered.filter("size = 0").select("number", F.lit(0).cast("long").alias("end"), "id", "size", "version"))
    none = F.lit(0).cast("long")
    everything = per_doc.unionByName(untaken.withColumns({"taken": none, "copies": none}))
    totals = everything.join(sources, "number").select(
        F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", "taken", "copies",
        "version")
    named = pieces.join(sources.select("number", F.col("source").alias(source_col)), "number").select(
        "slot", source_col, F.col("id").alias(id_col), "epoch", "place", "first_word", "words")
    return named, totals
