"""Fixed schemas of stored tables, landed payloads and CSV inputs."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT, _WHOLE, _SCORE = T.StringType(), T.LongType(), T.DoubleType()
_TIME, _DATE, _INT = T.TimestampType(), T.DateType(), T.IntegerType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


STOCKS = _table(id=_WHOLE, symbol=_TEXT)

# The article table is laid out by day, so that filling images rewrites days, not
# the table, and counting per day reads no column. Articles without a time share
# one partition.
ARTICLE_DAY = "published_day"
NEWS_ARTICLES = _table(
    id=_WHOLE,
    stock_id=_WHOLE,
    symbol=_TEXT,
    title=_TEXT,
    description=_TEXT,
    text=_TEXT,
    source=_TEXT,
    url=_TEXT,
    published_at=_TIME,
    source_api=_TEXT,
    image_url=_TEXT,
    published_day=_DATE,
)

NEWS_SENTIMENT = _table(
    news_id=_WHOLE,
    sentiment_label=_TEXT,
    positive_score=_SCORE,
    neutral_score=_SCORE,
    negative_score=_SCORE,
    sentiment_score=_SCORE,
    model=_TEXT,
)

DAILY_SENTIMENT = _table(
    stock_id=_WHOLE,
    symbol=_TEXT,
    sentiment_date=_DATE,
    article_count=_WHOLE,
    positive_articles=_WHOLE,
    neutral_articles=_WHOLE,
    negative_articles=_WHOLE,
    average_positive=_SCORE,
    average_neutral=_SCORE,
    average_negative=_SCORE,
    average_sentiment=_SCORE,
    sentiment_balance=_SCORE,
)

# One landed provider response. ``seq`` is the request order within a run.
LANDED_PAYLOAD = _table(
    run_id=_TEXT, provider=_TEXT, symbol=_TEXT, seq=_WHOLE, status=_INT, body=_TEXT
)

# One finished run: when it began and where its responses have landed. It is
# written last, so a run whose manifest is there is complete.
RUN_MANIFEST = _table(run_id=_TEXT, started_at=_TIME, path=_TEXT)
# First limit response of a provider in a run.
LIMIT_CUTOFFS = _table(run_id=_TEXT, provider=_TEXT, cutoff=_WHOLE)

# Every field any provider puts on an article. Fields a provider does not use
# stay NULL, so all four shapes parse with one item type. Epoch times are read
# as DOUBLE: whole and fractional seconds parse, text becomes NULL.
_LINK = _table(url=_TEXT)
FEED_ITEM = _table(
    title=_TEXT,
    headline=_TEXT,
    summary=_TEXT,
    description=_TEXT,
    source=_TEXT,
    url=_TEXT,
    time_published=_TEXT,
    datetime=_SCORE,
    published_at=_TEXT,
    content=_table(
        title=_TEXT,
        summary=_TEXT,
        description=_TEXT,
        pubDate=_TEXT,
        provider=_table(displayName=_TEXT),
        canonicalUrl=_LINK,
        clickThroughUrl=_LINK,
    ),
)
FEED_LIST = T.ArrayType(FEED_ITEM)
FEED_OBJECT = _table(feed=FEED_LIST, data=FEED_LIST)

# Column names of the per-symbol CSV files.
NEWS_CSV = ("url", "title", "description", "source", "published_at", "source_api")
SENTIMENT_CSV = (
    "url",
    "sentiment_label",
    "positive_score",
    "neutral_score",
    "negative_score",
    "sentiment_score",
)
DAILY_COUNTS = (
    "article_count",
    "positive_articles",
    "neutral_articles",
    "negative_articles",
)
DAILY_SCORES = (
    "average_positive",
    "average_neutral",
    "average_negative",
    "average_sentiment",
    "sentiment_balance",
)
DAILY_CSV = ("published_date",) + DAILY_COUNTS + DAILY_SCORES

# Columns that order runs, and the articles of runs. Names say nothing about time,
# so the start comes first where it is known.
RUNS = ("started_at", "run_id")
RUN_ORDER = (*RUNS, "provider_rank", "seq", "pos")
