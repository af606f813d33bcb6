"""Daily sentiment, computed from the stored articles and their sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow import schemas
from newsflow.operators.sentiment import daily_sentiment
from newsflow.session import scratch, settled
from newsflow.sinks.writers import finish_replacement, read_table, upsert_partitions


def scored_articles(articles: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Stored articles with their sentiment. Ids are unique on both sides."""
    dated = articles.select(F.col("id").alias("news_id"), "stock_id", "symbol", "published_at")
    return dated.join(sentiment, "news_id")


def run_daily_rollup(
    spark: SparkSession, articles_path: str, sentiment_path: str, daily_path: str
) -> None:
    """Compute the daily table and upsert the rows that changed, by stock and day."""
    articles = read_table(spark, articles_path, schemas.NEWS_ARTICLES)
    sentiment = read_table(spark, sentiment_path, schemas.NEWS_SENTIMENT)
    keys = ("stock_id", "sentiment_date")
    with scratch(spark):
        rolled = settled(daily_sentiment(scored_articles(articles, sentiment)), "rollup")
        finish_replacement(spark, daily_path, schemas.DAILY_SENTIMENT, "sentiment_date")
        stored = read_table(spark, daily_path, schemas.DAILY_SENTIMENT)
        same = [rolled[c].eqNullSafe(stored[c]) for c in schemas.DAILY_SENTIMENT.names]
        upsert_partitions(
            spark,
            daily_path,
            rolled.join(stored, same, "left_anti"),
            schemas.DAILY_SENTIMENT,
            keys=keys,
            order=("symbol",),
            partition="sentiment_date",
        )
