"""Articles against stored tables: new rows, stock ids and the stored record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_rows(candidates: DataFrame, stored: DataFrame, key: str = "url") -> DataFrame:
    """Candidates whose key is not stored yet.

    Only the key column of the stored table is read. After a deduplication by
    the same key the candidates are already partitioned for this join.
    """
    return candidates.join(stored.select(key), key, "left_anti")


def new_rows_probed(
    candidates: DataFrame, stored: DataFrame, key: str = "url"
) -> DataFrame:
    """Same result as :func:`new_rows` for a small batch against a large table.

    The batch keys first reduce the stored keys with a semi join. Spark
    broadcasts the batch keys when they are small, or filters the stored scan
    with a Bloom filter, so the stored table is not shuffled for each batch.
    ``candidates`` is read twice and should be persisted.
    """
    known = stored.select(key).join(candidates.select(key), key, "left_semi")
    return candidates.join(known, key, "left_anti")


def mark_stored(
    candidates: DataFrame, stored: DataFrame, key: str = "url", flag: str = "is_stored"
) -> DataFrame:
    """Candidates with a flag telling whether their key is stored."""
    known = stored.select(key).distinct().withColumn(flag, F.lit(True))
    return candidates.join(known, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def stock_ids(stocks: DataFrame) -> DataFrame:
    """One ``stock_id`` per symbol, the largest of a repeated one."""
    return stocks.groupBy("symbol").agg(F.max("id").alias("stock_id"))


def attach_stock_id(articles: DataFrame, stocks: DataFrame, how: str = "inner") -> DataFrame:
    """Add ``stock_id`` by symbol; articles of unknown symbols are dropped, or kept by a left join.

    A symbol that stands in ``stocks`` several times never multiplies an article.
    """
    return articles.join(stock_ids(stocks), "symbol", how)


def missing_symbols(required: DataFrame, stocks: DataFrame) -> DataFrame:
    """Required symbols that have no row in ``stocks``."""
    return required.select("symbol").join(stocks.select("symbol"), "symbol", "left_anti")


def require_symbols(required: DataFrame, stocks: DataFrame) -> None:
    """Raise when a required symbol is absent. ``required`` is the configured master."""
    absent = sorted(row["symbol"] for row in missing_symbols(required, stocks).collect())
    if absent:
        raise RuntimeError("stocks missing from the stock table: " + ", ".join(absent))


def article_record(articles: DataFrame) -> DataFrame:
    """The record stored in ``news_articles`` and its day; the body text stays empty."""
    return articles.select(
        F.col("stock_id").cast("bigint").alias("stock_id"),
        "symbol",
        "title",
        "description",
        F.lit(None).cast("string").alias("text"),
        "source",
        "url",
        "published_at",
        "source_api",
        F.to_date("published_at").alias("published_day"),
    )


def stock_dim(stocks: DataFrame) -> DataFrame:
    """The two columns of the stock table every join needs."""
    return stocks.select("id", "symbol")


def stock_lookup(symbols: DataFrame, master: DataFrame) -> DataFrame:
    """Master data per requested symbol, NULL for an unknown one."""
    return symbols.select("symbol").join(master, "symbol", "left")
