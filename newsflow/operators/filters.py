"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_window(ts: Column, start: Column, end: Column) -> Column:
    """True inside the closed window; an unknown time is kept."""
    return ts.isNull() | ts.between(start, end)


def present(*columns: str) -> Column:
    """True where every named column is neither NULL nor empty."""
    condition = F.col(columns[0]) != ""
    for name in columns[1:]:
        condition = condition & (F.col(name) != "")
    return condition


def valid_articles(articles: DataFrame) -> DataFrame:
    """Articles the collector keeps: URL and title present."""
    return articles.filter(present("url", "title"))


def with_url(rows: DataFrame) -> DataFrame:
    """Rows the CSV load keeps: URL present, the title may be missing."""
    return rows.filter(present("url"))


def without_image(articles: DataFrame) -> DataFrame:
    """URL and title of stored articles that have a URL but no image."""
    return articles.filter(F.col("image_url").isNull() & F.col("url").isNotNull()).select(
        "url", "title"
    )
