"""One callable per operator: (spark, table folder) -> DataFrame."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsflow import schemas
from newsflow.functions import clean, text, times, urls
from newsflow.operators import articles as art
from newsflow.operators import dedup, feed, filters, images, reports, sentiment, stock_match
from newsflow.plans import collector, csv_load
from newsflow.plans import daily_rollup as rollup_job
from newsflow.session import settled, shared_path
from newsflow.sinks import merge
from newsflow.sinks.writers import append_new, read_table
from newsflow.sources import csv_files, payloads
from newsflow.stocks import ALPHA_VANTAGE, FINNHUB, MARKETAUX, YFINANCE, provider_table
from newsflow.streaming import ingest
from workload import roles
from workload.roles import table

AS_OF = "2024-01-30 12:00:00"
TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _articles(spark: SparkSession, d: str) -> DataFrame:
    return roles.articles(_docs(spark, d))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return roles.stored_articles(_docs(spark, d), table(spark, d, "labels"))


def _unique(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_seen(filters.valid_articles(_articles(spark, d)), ["url"], roles.ORDER)


def _csv_rows(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d).select(
        "url",
        "symbol",
        "doc_id",
        "symbol_rank",
        F.col("symbol").alias("file_path"),
        F.col("doc_id").alias("row_pos"),
    )


def _shown(df: DataFrame) -> DataFrame:
    """Times as text and scores rounded, for comparison."""
    columns = []
    for name, kind in df.dtypes:
        if kind.startswith("timestamp"):
            columns.append(roles.time_text(F.col(name)).alias(name))
        elif kind == "date":
            columns.append(F.col(name).cast("string").alias(name))
        elif kind == "double":
            columns.append(F.round(name, 9).alias(name))
        else:
            columns.append(F.col(name))
    return df.select(*columns)


# --- sources -----------------------------------------------------------------


def stock_dim(spark, d):
    return art.stock_dim(roles.stocks(_docs(spark, d)))


def stock_lookup(spark, d):
    wanted = roles.event_symbols(table(spark, d, "events")).select("symbol").distinct()
    return art.stock_lookup(wanted, roles.stocks(_docs(spark, d)))


def null_image_rows(spark, d):
    return filters.without_image(roles.page_articles(table(spark, d, "pages")))


def payload_parse(spark, d):
    items = payloads.parse_items(roles.landed(_docs(spark, d)))
    item = F.col("item")
    link = F.coalesce(
        item["url"],
        clean.null_if_blank(item["content"]["canonicalUrl"]["url"]),
        item["content"]["clickThroughUrl"]["url"],
    )
    return items.select(
        "provider", "symbol", "seq", "pos", "status", F.coalesce(link, F.lit("")).alias("link")
    )


def _normalized(provider, spark, d):
    return _shown(payloads.normalize(roles.landed(_docs(spark, d), provider)))


def csv_scan(spark, d):
    """Write the documents as per-symbol CSV files and read them back."""
    path = shared_path(spark, "csv")
    rows = _articles(spark, d).select(
        "url", "title", "description", "source",
        roles.time_text(F.col("published_at")).alias("published_at"), "source_api", "symbol",
    )
    rows.write.partitionBy("symbol").csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    scan = csv_files.read_symbol_csv(spark, path, schemas.NEWS_CSV, roles.SYMBOLS)
    return _shown(
        scan.rows.withColumn("published_at", times.loose_utc(F.col("published_at"))).drop(
            "file_path", "row_pos"
        )
    )


def _landed_csv(spark, rows, columns):
    """Rows written per symbol, half with an unnamed index column, half in another column order."""
    path = shared_path(spark, "csv")
    even, layouts = F.col("event_id") % 2 == 0, []
    layouts.append(rows.filter(even).select("symbol", F.col("event_id").alias(""), *columns))
    layouts.append(rows.filter(~even).select("symbol", *reversed(columns)))
    for layout in layouts:
        layout.write.mode("append").partitionBy("symbol").csv(path, header=True, escape='"')
    return csv_files.read_symbol_csv(spark, path, columns, roles.SYMBOLS).rows


def csv_scan_broken(spark, d):
    """A third of the documents in whole files, a third in files with shifted cells, a third with an open quote.

    The broken files give no rows. The last row of a file leaves its quote open.
    """
    path = shared_path(spark, "csv")
    rows = _articles(spark, d).select("doc_id", "symbol", "url", "source", "source_api")
    title = F.when(F.col("doc_id") % 3 == 1, "Breaking, news").otherwise("News")
    ends = (F.col("doc_id") % 3 == 2) & (F.col("doc_id") == F.max("doc_id").over(Window.partitionBy("symbol", "part")))
    source_api = F.concat(F.when(ends, '"').otherwise(""), F.col("source_api"))
    rows = rows.withColumn("part", F.col("doc_id") % 3).select(
        "symbol", "part", "doc_id",
        F.concat_ws(",", "url", title, F.col("doc_id").cast("string"), "source", F.lit(""), source_api).alias(
            ",".join(schemas.NEWS_CSV)))
    for part in range(3):
        # A separator and a quote that no value holds: the lines are written as they are.
        own = rows.filter(F.col("part") == part).repartition("symbol").sortWithinPartitions("symbol", "doc_id")
        own.drop("part", "doc_id").write.mode("append").partitionBy("symbol").csv(
            path, header=True, sep="\u0001", quote="\u0002")
    scan = csv_files.read_symbol_csv(spark, path, schemas.NEWS_CSV, roles.SYMBOLS)
    return scan.rows.select(F.col("description").cast("bigint").alias("doc_id"), "symbol", "symbol_rank", "url")


def load_news_job(spark, d):
    """The documents loaded as CSV history: what the report says was inserted, and what is stored.

    Every stock stands twice in the stock table, but one that does not stand there at all.
    """
    path, home = shared_path(spark, "csv"), shared_path(spark, "load")
    rows = _articles(spark, d).select(*[c for c in schemas.NEWS_CSV if c != "published_at"], "symbol",
                                      roles.time_text(F.col("published_at")).alias("published_at"))
    rows.write.partitionBy("symbol").csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    stocks = roles.stocks(_docs(spark, d)).filter("symbol <> 'src19'")
    stocks = stocks.unionByName(stocks.withColumn("id", F.col("id") + 1000))
    tables = csv_load.Tables(f"{home}/articles", f"{home}/sentiment", f"{home}/daily")
    report = csv_load.load_news(spark, path, tables, stocks, roles.SYMBOLS)
    stored = read_table(spark, tables.news_articles, schemas.NEWS_ARTICLES).groupBy("symbol").agg(
        F.count("*").alias("stored"), F.countDistinct("url").alias("urls"))
    return report.filter("inserted > 0").select("symbol", "inserted").join(stored, "symbol")


def csv_scan_sentiment(spark, d):
    rows = roles.sentiment_rows(table(spark, d, "events"))
    symbol = F.concat(F.lit("src"), (F.col("event_id") % 20).cast("string"))
    read = _landed_csv(spark, rows.withColumn("symbol", symbol), schemas.SENTIMENT_CSV)
    scores = [F.round(clean.to_double(F.col(c)), 9).alias(c) for c in schemas.SENTIMENT_CSV[2:]]
    return read.select("symbol", "symbol_rank", "url", "sentiment_label", *scores)


def csv_scan_daily(spark, d):
    rows = roles.daily_rows(table(spark, d, "events")).drop("stock_id")
    read = _landed_csv(spark, rows, schemas.DAILY_CSV)
    return _shown(sentiment.daily_record(art.attach_stock_id(read, roles.stocks(_docs(spark, d)))))


# --- records and projections ---------------------------------------------------


def article_record(spark, d):
    linked = art.attach_stock_id(_articles(spark, d), roles.stocks(_docs(spark, d)))
    return _shown(art.article_record(linked))


def sentiment_record(spark, d):
    rows = roles.sentiment_rows(table(spark, d, "events"))
    return _shown(sentiment.sentiment_record(_matched(rows, spark, d)))


def _matched(rows, spark, d):
    articles = _docs(spark, d).select(
        F.col("doc_id").alias("id"), roles.doc_url(F.col("doc_id")).alias("url")
    )
    return sentiment.attach_news_id(rows, articles)


def daily_record(spark, d):
    rows = roles.daily_rows(table(spark, d, "events"))
    return _shown(sentiment.daily_record(rows, carried=("event_id",)))


def feed_projection(spark, d):
    pages = roles.page_articles(table(spark, d, "pages"))
    rows = pages.withColumns(
        {
            "symbol": F.lit(None).cast("string"),
            "description": F.lit(""),
            "source": F.lit("crawl"),
            "published_at": F.col("id"),
            "source_api": F.lit("pages"),
            "image_url": F.when(F.col("url").endswith("/"), "").otherwise(
                F.concat("url", F.lit(" ~*é%+"))
            ),
        }
    )
    return feed.feed_projection(rows)


def feed_display(spark, d):
    kind = F.col("event_type")
    rows = table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("url"),
        F.when(kind == "click", "").when(kind != "view", kind).alias("source"),
        F.when(kind == "click", "log").alias("source_api"),
        F.when(kind != "error", F.col("props")).otherwise("").alias("title"),
        F.when(kind != "signup", kind).alias("description"),
        F.when(kind != "purchase", F.col("user_id").cast("string")).alias("symbol"),
        F.col("ts").alias("published_at"),
    )
    return feed.feed_display(rows, F.lit(AS_OF).cast("timestamp_ntz"))


def age_label(spark, d):
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    label = times.age_label(F.col("ts"), as_of)
    return table(spark, d, "events").select("event_id", label.alias("age"))


# --- filters -------------------------------------------------------------------


def lookback_window(spark, d):
    start, end = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-15 00:00:00", "2024-01-15 02:00:00"))
    events = table(spark, d, "events")
    return events.filter(filters.in_window(F.col("ts"), start, end)).select("event_id", "event_type")


def _with_gaps(events: DataFrame) -> DataFrame:
    """Events as articles, some without title or URL."""
    kind = F.col("event_type")
    return events.select(
        "event_id",
        F.when(kind == "error", "").when(kind != "signup", F.col("props")).alias("title"),
        F.when(kind == "click", "").when(kind != "view", F.col("props")).alias("url"),
    )


def valid_articles(spark, d):
    return filters.valid_articles(_with_gaps(table(spark, d, "events"))).select("event_id")


def url_present(spark, d):
    return filters.with_url(_with_gaps(table(spark, d, "events"))).select("event_id")


def _limit():
    return payloads.is_limit_response(F.col("status"), F.col("body"))


def limit_responses(spark, d):
    return roles.requests(table(spark, d, "events")).select("event_id", _limit().alias("is_limit"))


def provider_breaker(spark, d):
    requests = roles.requests(table(spark, d, "events"))
    group, order = ["user_id"], ["ts", "event_id"]
    is_limit = payloads.is_limit_response(F.col("status"), F.col("body"), check_phrases=False)
    cutoffs = payloads.limit_cutoffs(requests, is_limit, group, order)
    return payloads.drop_after_limit(requests, cutoffs, group, order).select("event_id", "user_id")


def admissible_url(spark, d):
    number = F.col("page_id")
    url = F.col("url")
    address = F.concat(
        F.lit("https://"), (number % 256).cast("string"), F.lit("."),
        (F.length("url") % 256).cast("string"), F.lit(".7.1:8443/x.png"),
    )
    candidates = F.array(
        url, F.regexp_replace(url, "^http:", "https:"), address, F.lit("https://[::1]/a.png"),
        F.concat(F.lit("https://user@LOCALHOST./"), number.cast("string")),
        F.concat(F.lit("https://"), number.cast("string"), F.lit("/a.png")), F.lit("not a url"),
    )
    rows = table(spark, d, "pages").select("page_id", F.posexplode(candidates).alias("pos", "link"))
    return rows.withColumn("admissible", urls.admissible_image_url(F.col("link")))


# --- joins ----------------------------------------------------------------------


def attach_stock_id(spark, d):
    events = roles.event_symbols(table(spark, d, "events")).select("event_id", "symbol")
    return art.attach_stock_id(events, roles.stocks(_docs(spark, d)))


def missing_symbols(spark, d):
    wanted = roles.event_symbols(table(spark, d, "events")).select("symbol").distinct()
    return art.missing_symbols(wanted, roles.stocks(_docs(spark, d)))


def new_articles(spark, d):
    return art.new_rows(_unique(spark, d), _stored(spark, d)).select("url", "doc_id", "symbol")


def new_articles_probed(spark, d):
    fresh = art.new_rows_probed(_unique(spark, d), _stored(spark, d))
    return fresh.select("url", "doc_id", "symbol")


def load_skip_counts(spark, d):
    outcome = csv_load.news_outcome(_csv_rows(spark, d), _stored(spark, d))
    return outcome.groupBy("status").agg(F.count("*").alias("urls"))


def sentiment_match(spark, d):
    rows = roles.sentiment_rows(table(spark, d, "events"))
    return _matched(rows, spark, d).select("event_id", "news_id")


def new_sentiment(spark, d):
    rows = roles.sentiment_rows(table(spark, d, "events"))
    candidates = _matched(rows, spark, d).filter(F.col("news_id").isNotNull())
    stored = table(spark, d, "labels").select(F.col("doc_id").alias("news_id"))
    return art.new_rows(candidates, stored, "news_id").select("news_id", "sentiment_label")


def stock_association(spark, d):
    fresh = art.new_rows(_unique(spark, d), _stored(spark, d))
    assigned = stock_match.assign_stock(fresh, roles.ALIASES)
    return assigned.select("url", "doc_id", "symbol")


def stock_association_large(spark, d):
    """Stocks of the unique articles by a dictionary that grows with the benchmark table."""
    aliases = roles.alias_table(table(spark, d, "benchmark"))
    return stock_match.assign_stock(_unique(spark, d), aliases).select("url", "doc_id", "symbol")


def all_stock_matches(spark, d):
    matches = stock_match.all_stock_matches(_articles(spark, d), roles.ALIASES)
    return matches.select("doc_id", "match_rank", "match_symbol")


# --- deduplication ---------------------------------------------------------------


def dedup_first_seen(spark, d):
    return _shown(_unique(spark, d))


def dedup_csv(spark, d):
    picked = csv_load.first_per_url(_csv_rows(spark, d))
    return picked.select("url", "symbol", "doc_id", F.size("symbols").alias("copies"))


def dedup_last_wins(spark, d):
    records = sentiment.daily_record(roles.daily_rows(table(spark, d, "events")), ("event_id",))
    return _shown(dedup.last_wins(records, ["stock_id", "sentiment_date"], ["event_id"]))


def distinct_urls(spark, d):
    return dedup.distinct_urls(_with_gaps(table(spark, d, "events")))


# --- aggregations -----------------------------------------------------------------


def provider_counts(spark, d):
    names = ("click", "error", "purchase", "signup", "view", "refund")
    providers = provider_table(spark, names)
    events = table(spark, d, "events").withColumnRenamed("event_type", "source_api")
    return reports.provider_counts(events, providers)


def provider_status(spark, d):
    providers = provider_table(spark, ("click", "error", "purchase", "signup", "view", "refund"))
    return reports.provider_status(roles.requests(table(spark, d, "events")), _limit(), providers)


def run_funnel(spark, d):
    docs = _docs(spark, d)
    return reports.run_funnel(
        roles.articles(docs), _stored(spark, d), roles.stocks(docs), roles.ORDER, roles.ALIASES
    )


def load_summary_rollup(spark, d):
    rows = _csv_rows(spark, d)
    return csv_load.outcome_counts(rows, csv_load.news_outcome(rows, _stored(spark, d)))


def sentiment_load_summary(spark, d):
    rows = _csv_rows(spark, d)
    labelled = _docs(spark, d).join(table(spark, d, "labels"), "doc_id")
    known = labelled.groupBy(roles.text_url(F.col("text")).alias("url")).agg(
        (F.max("doc_id") + 1).alias("id"), F.max_by("quality", "doc_id").alias("quality")
    )
    stored = known.filter("quality = 1").select(F.col("id").alias("news_id"))
    return csv_load.outcome_counts(rows, csv_load.sentiment_outcome(rows, known, stored))


def table_counts(spark, d):
    return reports.table_counts({name: table(spark, d, name) for name in TABLES})


def daily_sentiment(spark, d):
    return _shown(sentiment.daily_sentiment(roles.scored_articles(table(spark, d, "events"))))


def daily_rollup(spark, d):
    """The rollup job, run twice, over stocks that change their symbol at noon."""
    scored = roles.scored_articles(table(spark, d, "events"))
    later = F.when(F.hour("published_at") >= 12, F.concat("symbol", F.lit("x"))).otherwise(F.col("symbol"))
    rows = scored.withColumns({
        "symbol": later, "id": F.col("event_id") + 1, "news_id": F.col("event_id") + 1,
        "published_at": F.col("published_at").cast("timestamp"),
    })
    home = shared_path(spark, "rollup")
    for name, schema, key in (("articles", schemas.NEWS_ARTICLES, "id"), ("sentiment", schemas.NEWS_SENTIMENT, "news_id")):
        append_new(spark, f"{home}/{name}", rows, schema, key=key, id_col=None, known_new=True)
    for _ in range(2):
        rollup_job.run_daily_rollup(spark, f"{home}/articles", f"{home}/sentiment", f"{home}/daily")
    return _shown(read_table(spark, f"{home}/daily", schemas.DAILY_SENTIMENT))


# --- feed ---------------------------------------------------------------------------


def _page(spark, d, **how):
    rows = feed.news_page(table(spark, d, "orders"), time="o_orderdate", tie="o_orderkey", **how)
    return rows.select("o_orderkey", roles.time_text(F.col("o_orderdate")).alias("o_orderdate"))


def news_page(spark, d):
    return _page(spark, d, page=3, limit=100)


def news_page_deep(spark, d):
    return _page(spark, d, page=120, limit=100)


def news_page_meta(spark, d):
    return feed.page_summary(_page(spark, d, page=3, limit=100), 3, 100)


def latest_six(spark, d):
    rows = feed.latest(table(spark, d, "orders"), "o_orderdate", "o_orderkey")
    return rows.select("o_orderkey", roles.time_text(F.col("o_orderdate")).alias("o_orderdate"))


# --- set operations -------------------------------------------------------------------


def union_providers(spark, d):
    def item(name, key, value):
        return table(spark, d, name).select(F.col(key).alias("item"), F.col(value).alias("body"))

    return payloads.union_providers(
        {
            ALPHA_VANTAGE: item("documents", "doc_id", "text"),
            FINNHUB: item("conversations", "conv_id", "text"),
            MARKETAUX: item("pages", "page_id", "html"),
            YFINANCE: item("events", "event_id", "props"),
        }
    )


# --- scalar functions --------------------------------------------------------------------


def clean_values(spark, d):
    kind, value = F.col("event_type"), F.col("value").cast("string")
    raw = (
        F.when(kind == "click", value)
        .when(kind == "view", F.concat(value, F.lit("d")))
        .when(kind == "error", "NaN")
        .when(kind == "purchase", F.concat(F.lit(" -"), value))
        .otherwise("")
    )
    rows = table(spark, d, "events").select("event_id", raw.alias("raw"))
    return rows.select(
        "event_id",
        clean.null_if_na(F.col("raw")).alias("value"),
        clean.to_double(F.col("raw")).alias("score"),
        clean.to_count(F.col("raw")).alias("whole"),
        clean.first_present(F.col("raw"), F.lit("none")).alias("shown"),
    )


def parse_times(spark, d):
    ts = F.col("ts").cast("timestamp")
    rows = table(spark, d, "events").select(
        "event_id",
        F.date_format(ts, "yyyyMMdd'T'HHmmss").alias("compact"),
        F.unix_seconds(ts).alias("epoch"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'").alias("iso"),
        F.date_format(ts, "'Mon, 'd MMM yyyy HH:mm:ss 'GMT'").alias("rfc"),
        F.when(F.col("event_type") == "error", "soon")
        .otherwise(F.date_format(ts, "M/d/yyyy H:mm"))
        .alias("slashed"),
    )
    micros = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return rows.select(
        "event_id",
        F.date_format(times.compact_utc(F.col("compact")), micros).alias("compact_ts"),
        F.date_format(times.epoch_utc(F.col("epoch")), micros).alias("epoch_ts"),
        F.date_format(times.iso_utc(F.col("iso")), micros).alias("iso_ts"),
        F.date_format(times.loose_utc(F.col("rfc")), micros).alias("rfc_ts"),
        F.date_format(times.loose_utc(F.col("slashed")), micros).alias("slashed_ts"),
    )


def request_window(spark, d):
    window = times.request_window(F.col("ts")).alias("w")
    return table(spark, d, "events").select("event_id", window).select("event_id", "w.*")


def url_parts(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select(
        "page_id",
        urls.https_host(url).alias("host"),
        urls.percent_encode(url).alias("encoded"),
        urls.is_web_url(url).alias("is_web"),
    )


def resolve_url(spark, d):
    url = F.col("url")
    refs = ("/a/b.png", "//cdn.example.com/c.png", "pic.png", "../up.png", "https://o.example.com/x?y=1")
    links = F.array(*[urls.resolve_url(url, F.lit(r)) for r in refs])
    return table(spark, d, "pages").select("page_id", F.posexplode(links).alias("pos", "link"))


def short_title(spark, d):
    return _docs(spark, d).select("doc_id", text.short_title(F.col("text")).alias("title"))


# --- images ------------------------------------------------------------------------------


def _images(spark, d):
    pages = table(spark, d, "pages")
    return images.extract_images(roles.page_articles(pages), roles.tagged_pages(pages))


def image_extract(spark, d):
    return _images(spark, d)


def backfill_counts(spark, d):
    return images.backfill_counts(_images(spark, d))


def fill_missing_image(spark, d):
    pages = table(spark, d, "pages")
    return merge.fill_missing(
        roles.page_articles(pages), images.page_images(roles.tagged_pages(pages))
    )


# --- sinks ---------------------------------------------------------------------------------


def insert_if_absent(spark, d):
    target = _stored(spark, d).select("id", "url", F.lit("stored").alias("title"))
    return merge.insert_if_absent(target, _unique(spark, d).select("url", "title"))


def upsert_daily(spark, d):
    events = table(spark, d, "events")
    target = sentiment.daily_sentiment(roles.scored_articles(events, stocks=40))
    source = sentiment.daily_record(roles.daily_rows(events), ("event_id",))
    merged = merge.upsert_last_wins(target, source, ["stock_id", "sentiment_date"], ["event_id"])
    return _shown(merged)


# --- jobs -------------------------------------------------------------------------------------


def collector_run(spark, d):
    """Landed responses to records of new articles, counted per stock."""
    docs = _docs(spark, d)
    unique = collector.unique_articles(collector.run_articles(roles.landed(docs)))
    records = collector.collect_records(
        unique, _stored(spark, d), roles.stocks(docs), roles.ALIASES
    )
    return records.groupBy("stock_id", "symbol", "source_api").agg(
        F.count("*").alias("articles"),
        roles.time_text(F.min("published_at")).alias("first_published"),
        roles.time_text(F.max("published_at")).alias("last_published"),
    )


def stream_ingest_runs(spark, d):
    """The documents land as the responses of many runs, which the stream stores in a fresh table.

    A limit ends its provider's share of its run only, so what is stored grows with the table.
    """
    docs = _docs(spark, d)
    home = shared_path(spark, "stream")
    landing = roles.in_runs(docs).hint("rebalance", "day")
    landing.write.partitionBy("day").json(f"{home}/landing")
    roles.run_manifests(docs, f"{home}/landing").coalesce(1).write.json(f"{home}/runs")
    loader = ingest.batch_loader(f"{home}/articles", roles.stocks(docs), roles.ALIASES)
    stream = ingest.run_stream(spark, f"{home}/runs")
    ingest.start_ingest(stream, f"{home}/checkpoint", loader).awaitTermination()
    stored = read_table(spark, f"{home}/articles", schemas.NEWS_ARTICLES)
    return _shown(stored.drop("id", "text", "image_url", "published_day"))


def stream_dedup(spark, d):
    """Ordered deduplication of a stream of articles that arrive up to five hours out of order.

    They land in two parts, each taken by a stream that goes on from the checkpoint; a row
    from the far future lands last and closes what is open.
    """
    home = shared_path(spark, "dedup")
    late = F.pmod(F.xxhash64("doc_id"), F.lit(300))
    rows = _articles(spark, d).drop("description", "title").withColumn("part", (F.col("doc_id") + late) >= 5000)
    rows = settled(rows, "arrivals")
    found = rows.drop("part").limit(0)
    columns = {"url": F.lit("end"), "published_at": F.lit("9000-01-01 00:00:00").cast("timestamp")}
    end = spark.range(1).select(*[
        columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in found.schema])
    for landing in (rows.filter("NOT part").drop("part"), rows.filter("part").drop("part"), end):
        landing.write.mode("append").parquet(f"{home}/landing")
        stream = spark.readStream.schema(found.schema).parquet(f"{home}/landing")
        first = ingest.first_of_repeats(stream, roles.ORDER, gap="1 day", delay="6 hours")
        query = first.writeStream.format("parquet").option("checkpointLocation", f"{home}/checkpoint")
        query.trigger(availableNow=True).start(f"{home}/first").awaitTermination()
    stored = spark.read.schema(found.schema).parquet(f"{home}/first")
    return _shown(stored.filter("url <> 'end'"))


def queries() -> dict:
    found = [
        stock_dim, stock_lookup, null_image_rows, payload_parse, csv_scan,
        article_record, sentiment_record, daily_record, feed_projection, feed_display, age_label,
        lookback_window, valid_articles, url_present, limit_responses, provider_breaker,
        admissible_url, attach_stock_id, missing_symbols, new_articles, new_articles_probed,
        load_skip_counts, sentiment_match, new_sentiment, stock_association, stock_association_large, all_stock_matches,
        dedup_first_seen, dedup_csv, dedup_last_wins, distinct_urls, provider_counts,
        provider_status, run_funnel, load_summary_rollup, sentiment_load_summary, table_counts,
        daily_sentiment, news_page, news_page_deep, news_page_meta, latest_six, union_providers,
        clean_values, parse_times, request_window, url_parts, resolve_url, short_title,
        image_extract, backfill_counts, fill_missing_image, insert_if_absent, upsert_daily,
        collector_run, stream_ingest_runs, stream_dedup, csv_scan_broken, load_news_job, csv_scan_sentiment, csv_scan_daily,
        daily_rollup,
    ]
    named = {q.__name__: q for q in found}
    named["normalize_feed_compact_ts"] = partial(_normalized, ALPHA_VANTAGE)
    named["normalize_feed_epoch"] = partial(_normalized, FINNHUB)
    named["normalize_feed_plain"] = partial(_normalized, MARKETAUX)
    named["normalize_feed_nested"] = partial(_normalized, YFINANCE)
    return named
