"""From raw documents to packed token rows: quality, near duplicates, leaks, mix, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir). The
result of each stage is written to the shared folder and read again as the next
stage's documents. All but the last stage return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm import decontamination, mixing, ngram_join, packing, quality_model
from newsflow.llm.prefix_sums import running_sums
from newsflow.session import settled


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_model.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return ngram_join.one_per_group(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those it does not take go.

    The mix cuts a source's last block, so one document per source may be taken in
    part; it stays whole. Rows are told apart by id, source and text. Of rows equal in
    all three, some may be taken once more than the others: they are numbered for it.
    """
    key = ["doc_id", "source", "version"]
    _, totals = mixing.mix(docs)
    copies = totals.groupBy(*key).agg(F.sum("copies").alias("sum"), F.count("*").alias("rows"))
    taken = settled(copies.filter("sum > 0").select(
        *[F.col(k).alias(f"taken_{k}") for k in key], F.expr("sum div rows").alias("copies"),
        (F.col("sum") % F.col("rows")).alias("more")), "copies")
    # Columns of any name are kept apart, in one struct, from those used here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", F.col("row.doc_id"), F.col("row.source"), mixing.version_of(F.col("row.text")).alias("version"))
    same = (
        F.col("doc_id").eqNullSafe(F.col("taken_doc_id")) & F.col("source").eqNullSafe(F.col("taken_source"))
        & (F.col("version") == F.col("taken_version"))
    )
    even = rows.join(taken.filter("more = 0"), same)
    # Where the mix ends inside a group of equal rows: one group per source at most.
    split = rows.join(taken.filter("more > 0"), same).withColumns(
        {"at": F.monotonically_increasing_id(), "one": F.lit(1).cast("long")})
    split = running_sums(split, ["at"], {"rank": "one"}, by=key, name="equal-rows")
    more = F.when(F.col("rank") <= F.col("more"), 1).otherwise(0)
    split = split.withColumn("copies", F.col("copies") + more).filter("copies > 0")
    both = even.select("row", "copies").unionByName(split.select("row", "copies"))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return both.select("row", each).select("row.*")


def packed_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return packing.pack_tokens(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("source mix", source_mix),
    ("token ids", packed_tokens),
]

# Model training, shingle hashing and tokenizing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
