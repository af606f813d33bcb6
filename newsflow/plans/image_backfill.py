"""Fill missing image links of stored articles from crawled pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from newsflow import schemas
from newsflow.operators.images import backfill_counts, extract_images
from newsflow.session import kept, scratch, settled
from newsflow.sinks.writers import fill_partitions, finish_replacement, read_table


def run_backfill(
    spark: SparkSession, articles_path: str, pages: DataFrame, order: Sequence[str] = ()
) -> DataFrame:
    """Fill image links in the article table; returns the counts.

    The extracted links are kept as a written table, so pages are searched once.
    Only the days with an article to fill are rewritten. ``order`` names the columns
    that order the captures of a page.
    """
    finish_replacement(spark, articles_path, schemas.NEWS_ARTICLES, schemas.ARTICLE_DAY)
    articles = read_table(spark, articles_path, schemas.NEWS_ARTICLES)
    with scratch(spark):
        links = settled(extract_images(articles, pages, order), "images")
        fill_partitions(
            spark, articles_path, links, schemas.NEWS_ARTICLES, partition=schemas.ARTICLE_DAY
        )
        return kept(backfill_counts(links))
