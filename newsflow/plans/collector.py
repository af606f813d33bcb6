"""Collector: landed responses to stored articles.

The steps run in the order that keeps the costly ones small: validity, then
deduplication by URL, then the stored-URL check on the same partitioning, and
only then the text search for stocks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow import schemas
from newsflow.operators.articles import (
    article_record,
    attach_stock_id,
    new_rows,
    require_symbols,
)
from newsflow.operators.dedup import first_seen
from newsflow.operators.filters import valid_articles
from newsflow.operators.reports import ACTIVE, LIMIT_HIT
from newsflow.operators.stock_match import assign_stock
from newsflow.session import scratch, settled
from newsflow.sinks.writers import append_new, read_table
from newsflow.sources.payloads import (
    drop_after_limit,
    is_limit_response,
    limit_cutoffs,
    normalize,
)
from newsflow.stocks import ALIASES, PROVIDERS, stock_master

LOOKBACK_HOURS = 2
RUN_START = schemas.RUNS[0]


@dataclass(frozen=True)
class RunReport:
    """Rows after each step of a run, rows per provider and each provider's final state.

    ``assigned`` are the new articles that name a stock, ``unmatched`` those that do not.
    """

    raw: int
    unique: int
    new: int
    assigned: int
    unmatched: int
    inserted: int
    per_provider: dict[str, int]
    status: dict[str, str]


def limit_flag(check_phrases: bool = True):
    """Limit test on the landed columns."""
    return is_limit_response(F.col("status"), F.col("body"), F.col("provider"), check_phrases)


def run_articles(
    payloads: DataFrame,
    as_of: datetime | None = None,
    hours: int = LOOKBACK_HOURS,
    cutoffs: DataFrame | None = None,
    check_phrases: bool = True,
) -> DataFrame:
    """Articles a run delivers: before any provider limit, inside the window.

    Without ``as_of`` no window is applied. ``cutoffs`` may bring known limit
    positions; by default they are taken from the payloads.
    """
    if cutoffs is None:
        cutoffs = limit_cutoffs(payloads, limit_flag(check_phrases))
    window = None
    if as_of is not None:
        end = F.lit(as_of)
        window = (end - F.expr(f"INTERVAL {int(hours)} HOURS"), end)
    return normalize(drop_after_limit(payloads, cutoffs), window)


def unique_articles(articles: DataFrame, order: Sequence[str] = schemas.RUN_ORDER) -> DataFrame:
    """Valid articles, first seen per URL, in each run where the runs' starts are known."""
    known = [c for c in order if c in articles.columns]
    keys = ["url", "run_id"] if RUN_START in known else ["url"]
    return first_seen(valid_articles(articles), keys, known)


def collect_records(
    unique: DataFrame,
    stored: DataFrame,
    stocks: DataFrame,
    aliases: Mapping[str, Sequence[str]] | DataFrame = ALIASES,
    pick_new: Callable[[DataFrame, DataFrame], DataFrame] = new_rows,
) -> DataFrame:
    """Records to store for the unique articles of a run, or of several.

    A later run stores an article that earlier ones met but could not link, as it
    would if the runs were collected one after the other.
    """
    return linked_records(assign_stock(pick_new(unique, stored), aliases), stocks)


def linked_records(assigned: DataFrame, stocks: DataFrame) -> DataFrame:
    """Records of articles that name a stock, the first run's of each URL."""
    linked = attach_stock_id(assigned, stocks)
    if RUN_START in linked.columns:
        linked = first_seen(linked, ["url"], schemas.RUNS)
    return article_record(linked)


def store_articles(spark: SparkSession, path: str, records: DataFrame) -> None:
    """Append records that are known to be new, laid out by day."""
    append_new(
        spark,
        path,
        records,
        schemas.NEWS_ARTICLES,
        partition=schemas.ARTICLE_DAY,
        known_new=True,
    )


def run_collector(
    spark: SparkSession,
    payloads: DataFrame,
    articles_path: str,
    stocks: DataFrame,
    as_of: datetime | None = None,
    check_phrases: bool = True,
    aliases: Mapping[str, Sequence[str]] | DataFrame = ALIASES,
) -> RunReport:
    """Collect one batch of landed responses into the article table.

    Without ``check_phrases`` only the status decides about a provider's limit,
    and no body is searched for it. Each step is written out before the next one: the
    bodies are parsed once, texts are searched once, and the report counts single
    columns of what the steps wrote. The stored table is read for its URLs and highest id only.
    """
    require_symbols(stock_master(spark), stocks)
    stored = read_table(spark, articles_path, schemas.NEWS_ARTICLES)
    with scratch(spark):
        cutoffs = settled(limit_cutoffs(payloads, limit_flag(check_phrases)), "cutoffs")
        articles = settled(run_articles(payloads, as_of, cutoffs=cutoffs), "articles")
        unique = settled(unique_articles(articles), "unique")
        fresh = settled(new_rows(unique, stored), "fresh")
        assigned = settled(assign_stock(fresh, aliases), "assigned")
        records = settled(linked_records(assigned, stocks), "records")
        store_articles(spark, articles_path, records)
        # Several runs may deliver one URL, so URLs are counted.
        urls = {name: step.select("url").distinct().count() for name, step in
                (("unique", unique), ("new", fresh), ("assigned", assigned), ("inserted", records))}
        # At most one row per provider.
        counts = dict(map(tuple, articles.groupBy("source_api").count().collect()))
        limited = {row[0] for row in cutoffs.select("provider").distinct().collect()}
    return RunReport(
        raw=sum(counts.values()),
        **urls,
        unmatched=urls["new"] - urls["assigned"],
        per_provider={p: counts.get(p, 0) for p in PROVIDERS},
        status={p: LIMIT_HIT if p in limited else ACTIVE for p in PROVIDERS},
    )
