"""The news page: one page of the feed and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame

from newsflow import schemas
from newsflow.operators.feed import feed_projection, news_page, page_summary


def feed_page(
    articles: DataFrame, page: object = 1, limit: object = 100
) -> tuple[DataFrame, DataFrame]:
    """Rows of the page and its one-row summary, from the stored article table."""
    rows = feed_projection(news_page(articles, page, limit, day=schemas.ARTICLE_DAY))
    return rows, page_summary(rows, page, limit)
