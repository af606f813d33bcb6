"""Parquet writers for the stored tables.

Tables are directories. Appends add files and never rewrite stored rows. Upserts
and fills rewrite only the partitions they touch, from a complete copy beside the
table. A writer that fails while it replaces partitions leaves that copy, and the
next writer finishes from it before it reads the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.operators.articles import new_rows
from newsflow.session import exists, remove
from newsflow.sinks.merge import fill_missing, upsert_last_wins


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The stored table, or an empty one before the first write."""
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def with_new_ids(rows: DataFrame, stored: DataFrame, id_col: str = "id") -> DataFrame:
    """Number the rows above the highest stored id.

    Ids are unique and growing, not dense: each task numbers its own rows, so no
    row has to pass through a single place.
    """
    highest = stored.agg(F.max(id_col)).first()[0] or 0
    return rows.withColumn(id_col, F.monotonically_increasing_id() + F.lit(highest + 1))


def _conform(rows: DataFrame, schema: T.StructType) -> DataFrame:
    columns = [
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema
    ]
    return rows.select(*columns)


def append_new(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    schema: T.StructType,
    key: str = "url",
    id_col: str | None = "id",
    partition: str | None = None,
    known_new: bool = False,
) -> None:
    """Append the source rows whose key is not stored; a repeated call adds nothing.

    ``source`` has one row per key. ``known_new`` tells that it was already
    reduced to new keys. With ``partition`` the rows are gathered per partition
    value first, so each value gets few files; a large value is split.
    """
    stored = read_table(spark, path, schema)
    fresh = source if known_new else new_rows(source, stored, key)
    if partition:
        fresh = fresh.hint("rebalance", partition)
    if id_col:
        fresh = with_new_ids(fresh, stored, id_col)
    writer = _conform(fresh, schema).write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def _replace_partitions(
    spark: SparkSession, path: str, rows: DataFrame, schema: T.StructType, partition: str
) -> None:
    """Put ``rows`` in place of the partitions they belong to."""
    _conform(rows, schema).hint("rebalance", partition).write.mode("overwrite").parquet(_staged(path))
    finish_replacement(spark, path, schema, partition)


def _staged(path: str) -> str:
    return path.rstrip("/") + "__next"


def finish_replacement(
    spark: SparkSession, path: str, schema: T.StructType, partition: str
) -> None:
    """Replace partitions from the staged copy, if there is a complete one.

    Replacing is idempotent, so after a failure at any point it is simply repeated.
    """
    staged = _staged(path)
    if not exists(spark, f"{staged}/_SUCCESS"):
        return
    (
        spark.read.schema(schema)
        .parquet(staged)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )
    remove(spark, staged)


def _touched(stored: DataFrame, values: DataFrame, partition: str) -> DataFrame:
    """Stored rows of the partitions that occur in ``values``.

    The partition values, one per directory, become a filter, so Spark lists and
    reads only those directories.
    """
    found = [row[0] for row in values.select(partition).distinct().collect()]
    column = F.col(partition)
    named = column.isin([v for v in found if v is not None])
    return stored.filter(named | column.isNull() if None in found else named)


def upsert_partitions(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    schema: T.StructType,
    keys: Sequence[str],
    order: Sequence[str],
    partition: str,
) -> None:
    """Upsert, last source row wins; ``partition`` is one of the keys."""
    finish_replacement(spark, path, schema, partition)
    stored = read_table(spark, path, schema)
    affected = _touched(stored, source, partition)
    merged = upsert_last_wins(affected, source, keys, order)
    _replace_partitions(spark, path, merged, schema, partition)


def fill_partitions(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    schema: T.StructType,
    partition: str,
    key: str = "url",
    value: str = "image_url",
) -> None:
    """Fill NULL values from ``source``; partitions without a row to fill stay as they are."""
    finish_replacement(spark, path, schema, partition)
    stored = read_table(spark, path, schema)
    found = source.filter(F.col(value).isNotNull())
    to_fill = stored.filter(F.col(value).isNull()).join(found.select(key), key, "left_semi")
    affected = _touched(stored, to_fill, partition)
    _replace_partitions(spark, path, fill_missing(affected, found, key, value), schema, partition)
