"""The part each given table plays.

The tables hold no news, so documents stand for articles, their 20 sources for
stock symbols, their four languages for the providers, labels for what is
stored already, events for request logs and sentiment rows, and pages for
crawled pages. Every role covers its whole table and whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.session import configure, settled
from newsflow.stocks import ALPHA_VANTAGE, FINNHUB, MARKETAUX, PROVIDERS, YFINANCE

LANGUAGES = ("en", "fr", "de", "es")
SYMBOLS = tuple(f"src{n}" for n in range(20))
ALIASES = {
    "src0": ("ezado", "Worthless"),
    "src1": ("heitz", "ungen"),
    "src2": ("Copyright", "License"),
    "src3": ("schung",),
    "src4": ("mento",),
    "src5": ("keit",),
    "src6": ("ción",),
    "src7": ("eaux",),
    "src8": ("ingly",),
}
ARTICLE_URL = "https://news.example.com/a/"
DOC_URL = "https://news.example.com/d/"
ORDER = ("provider_rank", "symbol_rank", "doc_id")
RUN_DOCUMENTS = 50
LIMITED_RUN = 4
LIMITED_PLACE = 13


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table."""
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_url(text: Column) -> Column:
    """Equal texts get equal URLs."""
    return F.concat(F.lit(ARTICLE_URL), F.md5(text))


def doc_url(number: Column) -> Column:
    return F.concat(F.lit(DOC_URL), number.cast("string"))


def doc_time(doc_id: Column) -> Column:
    """One document per minute from the start of 2024."""
    return F.timestamp_seconds(F.lit(1704067200) + doc_id * 60)


def time_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def _run_of(doc_id: Column) -> Column:
    return F.floor(doc_id / RUN_DOCUMENTS).cast("bigint")


def source_number(source: Column) -> Column:
    return F.substr(source, F.lit(4)).cast("int")


def articles(documents: DataFrame) -> DataFrame:
    """Documents as delivered articles."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LANGUAGES]), F.col("lang"))
    return documents.select(
        "doc_id",
        (rank - 1).cast("int").alias("provider_rank"),
        source_number(F.col("source")).alias("symbol_rank"),
        F.element_at(F.array(*[F.lit(p) for p in PROVIDERS]), rank.cast("int")).alias("source_api"),
        F.col("source").alias("symbol"),
        F.concat(F.lit("Story "), F.col("doc_id").cast("string")).alias("title"),
        F.col("text").alias("description"),
        "source",
        text_url(F.col("text")).alias("url"),
        doc_time(F.col("doc_id")).alias("published_at"),
    )


def stored_articles(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents as the stored article table, one row per URL."""
    labelled = documents.join(labels.select("doc_id"), "doc_id", "left_semi")
    return labelled.groupBy(text_url(F.col("text")).alias("url")).agg(
        F.min("doc_id").alias("id")
    )


def stocks(documents: DataFrame) -> DataFrame:
    """Document sources as the stock table.

    Written out, like the stored table it stands for, so that its size is known.
    """
    symbols = documents.select("source").distinct().select(
        source_number(F.col("source")).cast("bigint").alias("id"),
        F.col("source").alias("symbol"),
    )
    return settled(symbols, "stocks")


def alias_table(benchmark: DataFrame) -> DataFrame:
    """Benchmark items as stocks, whose aliases are their words of eight letters and more."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\w{8,}"), F.lit(0)))
    rows = benchmark.select(F.col("item_id").alias("rank"), words.alias("alias")).distinct()
    return settled(rows.withColumn("symbol", F.concat(F.lit("item"), F.col("rank").cast("string"))), "aliases")


def event_symbols(events: DataFrame) -> DataFrame:
    """Event users as requested symbols; most of them are not in the stock table."""
    return events.withColumn("symbol", F.concat(F.lit("src"), F.col("user_id").cast("string")))


def requests(events: DataFrame) -> DataFrame:
    """Events as provider responses, some of them limit responses."""
    kind = F.col("event_type")
    return events.select(
        "event_id",
        "ts",
        "user_id",
        kind.alias("provider"),
        F.when(kind == "error", 429).otherwise(200).alias("status"),
        F.when(kind == "signup", '{"Note": "API call frequency"}')
        .when(kind == "view", "quota, not JSON")
        .otherwise(F.col("props"))
        .alias("body"),
    )


def sentiment_rows(events: DataFrame) -> DataFrame:
    """Events as article sentiment, as text, keyed by document URL."""
    kind, value = F.col("event_type"), F.col("value")
    return events.select(
        "event_id",
        doc_url(F.col("event_id")).alias("url"),
        F.when(kind == "purchase", "positive")
        .when(kind == "error", "negative")
        .when(kind == "view", "NA")
        .otherwise("neutral")
        .alias("sentiment_label"),
        value.cast("string").alias("positive_score"),
        F.when(kind == "click", "n/a").otherwise(value.cast("string")).alias("neutral_score"),
        F.when(kind == "signup", "bad").otherwise(value.cast("string")).alias("negative_score"),
        value.cast("string").alias("sentiment_score"),
    )


def scored_articles(events: DataFrame, stocks: int = 20) -> DataFrame:
    """Events as stored, scored articles of ``stocks`` stocks."""
    kind = F.col("event_type")
    stock = F.col("user_id") % stocks
    return events.select(
        "event_id",
        stock.alias("stock_id"),
        F.concat(F.lit("src"), stock.cast("string")).alias("symbol"),
        F.col("ts").alias("published_at"),
        F.when(kind == "purchase", "positive")
        .when(kind == "error", "negative")
        .otherwise("neutral")
        .alias("sentiment_label"),
        F.col("value").alias("positive_score"),
        (F.col("value") / 2).alias("neutral_score"),
        (F.col("value") / 4).alias("negative_score"),
        (F.col("value") - 100).alias("sentiment_score"),
    )


def daily_rows(events: DataFrame) -> DataFrame:
    """Events as daily sentiment CSV rows, as text."""
    kind, value = F.col("event_type"), F.col("value").cast("string")
    stock = F.col("user_id") % 20
    return events.select(
        "event_id",
        stock.alias("stock_id"),
        F.concat(F.lit("src"), stock.cast("string")).alias("symbol"),
        F.when(kind == "view", "").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias(
            "published_date"
        ),
        value.alias("article_count"),
        F.concat(F.lit("-"), value).alias("positive_articles"),
        F.when(kind == "error", "none").otherwise(value).alias("neutral_articles"),
        F.when(kind == "click", "inf").otherwise("1e3").alias("negative_articles"),
        value.alias("average_positive"),
        F.when(kind == "signup", "NaN").otherwise(value).alias("average_neutral"),
        F.when(kind == "error", "x").otherwise(value).alias("average_negative"),
        value.alias("average_sentiment"),
        F.lit("0.5").alias("sentiment_balance"),
    )


def _feed_items(provider: str) -> Column:
    """Body of a response with two items: the document, and one with a bad time."""
    doc_id, text, source = F.col("doc_id"), F.col("text"), F.col("source")
    title = F.concat(F.lit("Story "), doc_id.cast("string"))
    url = text_url(text)
    other = F.concat(url, F.lit("/b"))
    ts = doc_time(doc_id)
    if provider == ALPHA_VANTAGE:
        def item(u, t):
            return F.struct(title.alias("title"), text.alias("summary"), source.alias("source"),
                            u.alias("url"), t.alias("time_published"))
        items = F.array(item(url, F.date_format(ts, "yyyyMMdd'T'HHmmss")), item(other, F.lit("never")))
        return F.to_json(F.struct(items.alias("feed")))
    if provider == FINNHUB:
        def item(u, t):
            return F.struct(title.alias("headline"), text.alias("summary"), source.alias("source"),
                            u.alias("url"), t.alias("datetime"))
        return F.to_json(F.array(item(url, F.unix_seconds(ts)), item(other, F.lit(0).cast("bigint"))))
    if provider == MARKETAUX:
        def item(u, t):
            return F.struct(title.alias("title"), text.alias("description"), source.alias("source"),
                            u.alias("url"), t.alias("published_at"))
        items = F.array(
            item(url, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")), item(other, F.lit("never"))
        )
        return F.to_json(F.struct(items.alias("data")))

    def item(canonical, click, summary, t):
        content = F.struct(
            title.alias("title"), summary.alias("summary"), text.alias("description"), t.alias("pubDate"),
            F.struct(source.alias("displayName")).alias("provider"),
            F.struct(canonical.alias("url")).alias("canonicalUrl"),
            F.struct(click.alias("url")).alias("clickThroughUrl"),
        )
        return F.struct(content.alias("content"))

    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    blank = F.lit("")
    return F.to_json(F.array(
        item(url, blank, text, iso), item(blank, other, blank, F.lit("never")), item(blank, blank, text, iso)
    ))


def landed(documents: DataFrame, provider: str | None = None) -> DataFrame:
    """Documents as landed responses, of one provider or of the one their language stands for."""
    if provider is not None:
        name, body = F.lit(provider), _feed_items(provider)
    else:
        name = F.element_at(
            F.array(*[F.lit(p) for p in PROVIDERS]),
            F.array_position(F.array(*[F.lit(x) for x in LANGUAGES]), F.col("lang")).cast("int"),
        )
        body = F.when(F.col("lang") == "en", _feed_items(ALPHA_VANTAGE))
        body = body.when(F.col("lang") == "fr", _feed_items(FINNHUB))
        body = body.when(F.col("lang") == "de", _feed_items(MARKETAUX))
        body = body.otherwise(_feed_items(YFINANCE))
    return documents.select(
        F.lit("run").alias("run_id"),
        name.alias("provider"),
        F.col("source").alias("symbol"),
        F.col("doc_id").alias("seq"),
        F.lit(200).alias("status"),
        body.alias("body"),
    )


def _run_start(run: Column) -> Column:
    return doc_time(run * RUN_DOCUMENTS)


def in_runs(documents: DataFrame) -> DataFrame:
    """Documents as landed responses of many runs, ``RUN_DOCUMENTS`` ids each, with the run's day.

    In every fourth run the response in place 13 signals a limit. Copies of a text stand
    in several runs, under one URL.
    """
    payloads = landed(documents).withColumn("run", _run_of(F.col("seq")))
    limited = (F.col("run") % LIMITED_RUN == 0) & (F.col("seq") % RUN_DOCUMENTS == LIMITED_PLACE)
    return payloads.withColumns({
        "run_id": F.concat(F.lit("run-"), F.col("run").cast("string")),
        "status": F.when(limited, 429).otherwise(F.col("status")),
        "day": F.to_date(_run_start(F.col("run"))),
    }).drop("run")


def run_manifests(documents: DataFrame, landing: str) -> DataFrame:
    """A manifest per run of :func:`in_runs`, whose responses land in the folder of its day."""
    run, start = F.col("run").cast("string"), _run_start(F.col("run"))
    began = F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return documents.select(_run_of(F.col("doc_id")).alias("run")).distinct().select(
        F.concat(F.lit("run-"), run).alias("run_id"),
        began.alias("started_at"),
        F.concat(F.lit(f"{landing}/day="), F.to_date(start).cast("string")).alias("path"),
    )


def tagged_pages(pages: DataFrame) -> DataFrame:
    """Pages with a social image tag whose form depends on the shape of the URL.

    Anchored URLs get an absolute path, query URLs a host-relative link with an
    entity, ``.html`` URLs a bare relative path, folder URLs an absolute link in
    upper case; the others get a tag inside a comment, which must not count.
    """
    url, number = F.col("url"), F.col("page_id").cast("string")

    def tag(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    head = (
        F.when(url.endswith("#top"), tag('<meta property="og:image" content="/img/', number, '.jpg">'))
        .when(F.contains(url, F.lit("?")),
              tag("<META NAME='twitter:image' CONTENT='//cdn.example.com/", number, ".png?w=1&amp;h=2'>"))
        .when(url.endswith(".html"), tag("<meta content=../pic/", number, ".gif name=og:image:url>"))
        .when(url.endswith("/"),
              tag('<META PROPERTY="OG:IMAGE:SECURE_URL" CONTENT=" https://img.example.org/', number, ' ">'))
        .otherwise(tag('<!-- <meta property="og:image" content="/no/', number, '.jpg"> -->'))
    )
    return pages.select("page_id", "url", F.concat(head, F.col("html")).alias("html"))


def page_articles(pages: DataFrame) -> DataFrame:
    """Pages as stored articles; ``.html`` pages have an image already."""
    return pages.select(
        F.col("page_id").alias("id"),
        "url",
        F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"),
        F.when(F.col("url").endswith(".html"), F.lit("https://old.example.com/kept.png")).alias(
            "image_url"
        ),
    )
