"""Resumable load of CSV history into the stored tables.

Each load parses its files once, decides the fate of every row once, keeps both as
written tables in the shared folder, and then appends and reports from them. The
tables are removed when the load ends; reports are small local tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow import schemas
from newsflow.functions.times import loose_utc
from newsflow.operators.articles import (
    article_record,
    attach_stock_id,
    mark_stored,
    require_symbols,
    stock_ids,
)
from newsflow.operators.dedup import first_seen
from newsflow.operators.filters import with_url
from newsflow.operators.reports import load_summary, stored_counts, table_counts
from newsflow.operators.sentiment import (
    attach_news_id,
    daily_date,
    daily_record,
    sentiment_record,
)
from newsflow.plans.collector import store_articles
from newsflow.session import kept, scratch, settled
from newsflow.sinks.writers import append_new, read_table, upsert_partitions
from newsflow.sources.csv_files import CsvScan, read_symbol_csv
from newsflow.stocks import SYMBOLS, stock_master

ROW_ORDER = ("symbol_rank", "file_path", "row_pos")
ROW, INSERTED, SKIPPED, MISSING, ERROR = "row", "inserted", "skipped", "missing", "error"


@dataclass(frozen=True)
class Tables:
    """Paths of the stored tables. The price table is only counted."""

    news_articles: str
    news_sentiment: str
    daily_sentiment: str
    stock_prices: str | None = None


def first_per_url(rows: DataFrame, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    """One row per URL, first in symbol order, with all symbols that carry the URL.

    ``symbols`` holds each configured symbol at most once. The winner is a limited
    row number and the copies are narrow distinct pairs, so only one wide row per URL
    leaves a task, and both sides are partitioned by URL.
    """
    usable = with_url(rows)
    copies = usable.select("url", "symbol").distinct().groupBy("url").agg(
        F.collect_list("symbol").alias("symbols"))
    return first_seen(usable, ["url"], order).join(copies, "url")


def news_outcome(rows: DataFrame, stored: DataFrame, stocks: DataFrame | None = None) -> DataFrame:
    """First row per URL with the fate of every symbol's copy.

    A copy is inserted when the URL is not stored and its symbol comes first;
    every other symbol's copy is skipped. With ``stocks``, rows of symbols that have no
    stock are left out before the first row is chosen, so what counts as inserted is
    what is stored; each URL without a known symbol is an error.
    """
    if stocks is None:
        marked = mark_stored(first_per_url(rows), stored, "url")
        status = F.when(F.col("is_stored"), SKIPPED).otherwise(INSERTED)
        return marked.withColumn("status", status).drop("is_stored")
    known = rows.join(stock_ids(stocks).select("symbol", F.lit(False).alias("unknown")), "symbol", "left")
    known = known.withColumn("unknown", F.coalesce("unknown", F.lit(True)))
    order = ("unknown", *ROW_ORDER)
    marked = mark_stored(first_per_url(known, order), stored, "url")
    status = F.when(F.col("is_stored"), SKIPPED).when(F.col("unknown"), ERROR).otherwise(INSERTED)
    return marked.withColumn("status", status).drop("is_stored", "unknown")


def sentiment_outcome(rows: DataFrame, articles: DataFrame, stored: DataFrame) -> DataFrame:
    """First row per URL with its article id and the fate of every symbol's copy."""
    matched = attach_news_id(first_per_url(rows), articles)
    marked = mark_stored(matched, stored, "news_id")
    status = (
        F.when(F.col("news_id").isNull(), MISSING)
        .when(F.col("is_stored"), SKIPPED)
        .otherwise(INSERTED)
    )
    return marked.withColumn("status", status).drop("is_stored")


def outcome_counts(rows: DataFrame, outcome: DataFrame) -> DataFrame:
    """Rows, inserted, skipped and missing per symbol, and the grand total.

    Rows are counted before anything is dropped; rows without URL and repeats
    inside one symbol are in no other count.
    """
    copy = F.explode("symbols").alias("copy_symbol")
    fates = outcome.select("symbol", "status", copy).select(
        F.col("copy_symbol").alias("symbol"),
        F.when(
            (F.col("status") == INSERTED) & (F.col("copy_symbol") != F.col("symbol")), SKIPPED
        )
        .otherwise(F.col("status"))
        .alias("kind"),
    )
    return kind_counts(rows.select("symbol", F.lit(ROW).alias("kind")).unionByName(fates))


def kind_counts(events: DataFrame) -> DataFrame:
    """Counts per symbol and in total from (symbol, kind) rows."""
    names = {"rows": ROW, "inserted": INSERTED, "skipped": SKIPPED, "missing": MISSING, "errors": ERROR}
    return load_summary(events, {n: F.count_if(F.col("kind") == kind) for n, kind in names.items()})


def _with_errors(counts: DataFrame, scan: CsvScan) -> DataFrame:
    """Add the number of files that were unreadable or passed over to the grand total."""
    unreadable = F.lit(len(scan.unreadable) + len(scan.passed_over)).cast("bigint")
    errors = F.col("errors") + F.when(F.col("symbol").isNull(), unreadable).otherwise(0)
    return counts.withColumn("errors", errors)


def news_records(winners: DataFrame, stocks: DataFrame) -> DataFrame:
    """Article records of CSV rows; free-form times are parsed to UTC."""
    parsed = winners.withColumn("published_at", loose_utc(F.col("published_at")))
    return article_record(attach_stock_id(parsed, stocks))


def load_news(
    spark: SparkSession,
    path: str,
    tables: Tables,
    stocks: DataFrame,
    symbols: Sequence[str] = SYMBOLS,
) -> DataFrame:
    """Load the news CSVs; returns the counts."""
    with scratch(spark):
        scan = read_symbol_csv(spark, path, schemas.NEWS_CSV, symbols)
        stored = read_table(spark, tables.news_articles, schemas.NEWS_ARTICLES)
        outcome = settled(news_outcome(scan.rows, stored, stocks), "news-load")
        records = news_records(outcome.filter(F.col("status") == INSERTED), stocks)
        store_articles(spark, tables.news_articles, records)
        return kept(_with_errors(outcome_counts(scan.rows, outcome), scan))


def load_sentiment(
    spark: SparkSession, path: str, tables: Tables, symbols: Sequence[str] = SYMBOLS
) -> DataFrame:
    """Load the article sentiment CSVs; returns the counts."""
    with scratch(spark):
        scan = read_symbol_csv(spark, path, schemas.SENTIMENT_CSV, symbols, "_sentiment")
        articles = read_table(spark, tables.news_articles, schemas.NEWS_ARTICLES)
        stored = read_table(spark, tables.news_sentiment, schemas.NEWS_SENTIMENT)
        outcome = settled(sentiment_outcome(scan.rows, articles, stored), "sentiment-load")
        records = sentiment_record(outcome.filter(F.col("status") == INSERTED))
        append_new(
            spark,
            tables.news_sentiment,
            records,
            schemas.NEWS_SENTIMENT,
            key="news_id",
            id_col=None,
            known_new=True,
        )
        return kept(_with_errors(outcome_counts(scan.rows, outcome), scan))


def load_daily(
    spark: SparkSession,
    path: str,
    tables: Tables,
    stocks: DataFrame,
    symbols: Sequence[str] = SYMBOLS,
) -> DataFrame:
    """Upsert the daily sentiment CSVs; returns the counts.

    A row with an unreadable date is an error, one without a date is ignored.
    """
    with scratch(spark):
        scan = read_symbol_csv(spark, path, schemas.DAILY_CSV, symbols, "_daily_sentiment")
        linked = attach_stock_id(scan.rows, stocks)
        order = ("file_path", "row_pos")
        records = settled(daily_record(linked, carried=order), "daily-load")
        upsert_partitions(
            spark,
            tables.daily_sentiment,
            records,
            schemas.DAILY_SENTIMENT,
            keys=("stock_id", "sentiment_date"),
            order=order,
            partition="sentiment_date",
        )
        date = F.col("published_date")
        fate = F.when(daily_date(date).isNotNull(), INSERTED).when(date.isNotNull(), ERROR)
        events = scan.rows.select("symbol", F.explode(F.array(F.lit(ROW), fate)).alias("kind"))
        return kept(_with_errors(kind_counts(events), scan))


def run_load(
    spark: SparkSession,
    news_path: str,
    sentiment_path: str,
    daily_path: str,
    tables: Tables,
    stocks: DataFrame,
) -> dict[str, DataFrame]:
    """Load news, then sentiment, then daily sentiment; returns all counts.

    Sentiment needs the articles of the news load, so the order matters.
    """
    require_symbols(stock_master(spark), stocks)
    reports = {
        "news": load_news(spark, news_path, tables, stocks),
        "sentiment": load_sentiment(spark, sentiment_path, tables),
        "daily": load_daily(spark, daily_path, tables, stocks),
    }
    names = ("stock_prices", "news_articles", "news_sentiment", "daily_sentiment")
    stored = stored_counts(spark, {name: getattr(tables, name) for name in names})
    reports["tables"] = table_counts({"stocks": stocks}).unionByName(stored)
    return reports
