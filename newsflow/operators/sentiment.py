"""Sentiment: match to articles, build records, roll up per stock and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow import schemas
from newsflow.functions.clean import null_if_na, to_count, to_double
from newsflow.functions.times import loose_utc

# Fixed value: the model whose scores are loaded.
SENTIMENT_MODEL = "ProsusAI/finbert"


def attach_news_id(sentiment: DataFrame, articles: DataFrame) -> DataFrame:
    """Add the id of the article with the same URL, NULL when there is none.

    ``articles`` holds one row per URL. An id of 0 counts as no article.
    """
    ids = articles.select("url", F.col("id").alias("news_id"))
    matched = sentiment.join(ids, "url", "left")
    return matched.withColumn("news_id", F.nullif("news_id", F.lit(0).cast("bigint")))


def sentiment_record(matched: DataFrame) -> DataFrame:
    """The record stored in ``news_sentiment``, from matched text columns."""
    scores = ("positive_score", "neutral_score", "negative_score", "sentiment_score")
    return matched.filter(F.col("news_id").isNotNull()).select(
        F.col("news_id").cast("bigint").alias("news_id"),
        null_if_na(F.col("sentiment_label")).alias("sentiment_label"),
        *[to_double(F.col(c).cast("string")).alias(c) for c in scores],
        F.lit(SENTIMENT_MODEL).alias("model"),
    )


def daily_date(text: Column) -> Column:
    """Day of a daily row, NULL unless the whole value is a date or a date and time."""
    return F.to_date(loose_utc(null_if_na(text)))


def daily_record(daily: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """The record stored in ``daily_sentiment``; rows without a readable date are dropped.

    Expects ``stock_id``, ``symbol`` and the text columns of the daily CSV.
    ``carried`` names further columns to keep.
    """
    dated = daily.withColumn("sentiment_date", daily_date(F.col("published_date").cast("string")))
    return dated.filter(F.col("sentiment_date").isNotNull()).select(
        F.col("stock_id").cast("bigint").alias("stock_id"),
        "symbol",
        "sentiment_date",
        *[to_count(F.col(c).cast("string")).alias(c) for c in schemas.DAILY_COUNTS],
        *[to_double(F.col(c).cast("string")).alias(c) for c in schemas.DAILY_SCORES],
        *carried,
    )


def _share(label: str) -> Column:
    return F.count_if(F.lower("sentiment_label") == label)


# Sums and counts of the averaged scores.
_AVERAGED = {
    "average_positive": "positive_score",
    "average_neutral": "neutral_score",
    "average_negative": "negative_score",
    "average_sentiment": "sentiment_score",
}


def daily_sentiment(scored: DataFrame) -> DataFrame:
    """Roll scored articles up to one row per stock and day.

    A stock that changed its symbol during the day gets that of its latest article.

    Expects ``stock_id, symbol, published_at, sentiment_label`` and the four
    scores. ``sentiment_balance`` is (positive - negative) / all articles;
    ``sentiment_score`` is always an input. Articles without a time belong to no
    day and are left out. Articles are aggregated by hash, per symbol too, before they
    are shuffled; only the few symbols of a stock and day are then compared in order.
    """
    dated = scored.filter(F.col("published_at").isNotNull())
    keys = ["stock_id", "sentiment_date"]
    counts = ("article_count", "positive_articles", "neutral_articles", "negative_articles")
    by_symbol = dated.groupBy("stock_id", F.to_date("published_at").alias("sentiment_date"), "symbol").agg(
        F.max("published_at").alias("latest"),
        F.count("*").alias("article_count"),
        _share("positive").alias("positive_articles"),
        _share("neutral").alias("neutral_articles"),
        _share("negative").alias("negative_articles"),
        *[F.sum(score).alias(f"{name}_sum") for name, score in _AVERAGED.items()],
        *[F.count(score).alias(f"{name}_count") for name, score in _AVERAGED.items()],
    )
    rolled = by_symbol.groupBy(*keys).agg(
        F.max(F.struct("latest", "symbol"))["symbol"].alias("symbol"),
        *[F.sum(name).alias(name) for name in counts],
        *[
            F.try_divide(F.sum(f"{name}_sum"), F.sum(f"{name}_count")).alias(name)
            for name in _AVERAGED
        ],
    )
    balance = (F.col("positive_articles") - F.col("negative_articles")) / F.col("article_count")
    return rolled.withColumn("sentiment_balance", balance)
