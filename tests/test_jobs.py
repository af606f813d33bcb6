"""Sinks, jobs and the stream, end to end on small folders."""

from __future__ import annotations

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from newsflow import schemas
from newsflow.operators.dedup import distinct_urls
from newsflow.plans import collector, csv_load, daily_rollup, image_backfill, news_page
from newsflow.sinks import merge, writers
from newsflow.stocks import ALPHA_VANTAGE, FINNHUB, MARKETAUX, SYMBOLS, YFINANCE
from newsflow.streaming import ingest
from workload import queries as workload_queries
from workload import roles


@pytest.fixture
def stocks(spark):
    return spark.createDataFrame([(i + 1, s) for i, s in enumerate(SYMBOLS)], schemas.STOCKS)


def stored(spark, path, *columns):
    rows = writers.read_table(spark, str(path), schemas.NEWS_ARTICLES).collect()
    return sorted(tuple(r[c] for c in columns) for r in rows)


# --- sinks --------------------------------------------------------------------------


def test_insert_if_absent_twice_is_once(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2)], "url string, n int")
    source = spark.createDataFrame([("b", 20), ("c", 30)], "url string, n int")
    once = merge.insert_if_absent(target, source)
    twice = merge.insert_if_absent(once, source)
    want = [("a", 1), ("b", 2), ("c", 30)]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == want


def test_upsert_twice_is_once_and_last_row_wins(spark):
    target = spark.createDataFrame([(1, "d1", 1), (2, "d1", 2)], "k int, d string, n int")
    source = spark.createDataFrame(
        [(2, "d1", 20, 0), (2, "d1", 21, 1), (3, "d1", 30, 0)], "k int, d string, n int, pos int"
    )
    once = merge.upsert_last_wins(target, source, ["k", "d"], ["pos"])
    twice = merge.upsert_last_wins(once, source, ["k", "d"], ["pos"])
    want = [(1, "d1", 1), (2, "d1", 21), (3, "d1", 30)]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == want


def test_fill_keeps_present_values(spark):
    target = spark.createDataFrame([("a", None), ("b", "old"), ("c", None)], "url string, image_url string")
    source = spark.createDataFrame([("a", "new"), ("b", "new"), ("c", None)], "url string, image_url string")
    got = merge.fill_missing(target, source)
    assert sorted((r["url"], r["image_url"]) for r in got.collect()) == [("a", "new"), ("b", "old"), ("c", None)]


def test_upsert_rewrites_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "daily")

    def rows(*triples):
        df = spark.createDataFrame(
            [(s, dt.date(2024, 1, d), n, i) for i, (s, d, n) in enumerate(triples)],
            "stock_id bigint, sentiment_date date, article_count bigint, pos int",
        )
        return df

    def upsert(df):
        writers.upsert_partitions(
            spark, path, df, schemas.DAILY_SENTIMENT, ["stock_id", "sentiment_date"], ["pos"], "sentiment_date"
        )

    upsert(rows((1, 1, 10), (2, 1, 20), (1, 2, 30)))
    untouched = sorted((tmp_path / "daily" / "sentiment_date=2024-01-02").iterdir())
    for _ in range(2):
        upsert(rows((2, 1, 21), (2, 1, 22), (1, 3, 40)))
    table = writers.read_table(spark, path, schemas.DAILY_SENTIMENT)
    got = sorted((r["sentiment_date"].day, r["stock_id"], r["article_count"]) for r in table.collect())
    assert got == [(1, 1, 10), (1, 2, 22), (2, 1, 30), (3, 1, 40)]
    assert sorted((tmp_path / "daily" / "sentiment_date=2024-01-02").iterdir()) == untouched


def test_append_gives_new_ids_and_repeats_add_nothing(spark, tmp_path):
    path = str(tmp_path / "articles")
    df = spark.createDataFrame([(f"u{i}", f"T{i}") for i in range(100)], "url string, title string")
    for part in (df.filter("url < 'u5'"), df, df):
        writers.append_new(spark, path, part, schemas.NEWS_ARTICLES)
    table = writers.read_table(spark, path, schemas.NEWS_ARTICLES)
    got = table.agg(F.count("*"), F.countDistinct("url"), F.countDistinct("id"), F.min("id")).first()
    assert tuple(got)[:3] == (100, 100, 100) and got[3] >= 1


# --- collector ----------------------------------------------------------------------------


def feed(provider, symbol, seq, items, status=200, run="r1"):
    body = {"feed": items} if provider == ALPHA_VANTAGE else {"data": items} if provider == MARKETAUX else items
    return (run, provider, symbol, seq, status, json.dumps(body))


def run_one():
    """Repeats across providers, symbols and inside a payload, and one limit hit."""
    return [
        feed(ALPHA_VANTAGE, "NVDA", 0, [
            {"title": "", "url": "u1", "summary": "no title"},
            {"title": "Plain", "url": "u2", "summary": "Tesla", "time_published": "20240115T100000"},
            {"title": "Again", "url": "u2", "summary": "Apple"},
        ]),
        feed(ALPHA_VANTAGE, "AAPL", 1, [{"title": "Later", "url": "u3", "summary": "rain"}]),
        feed(ALPHA_VANTAGE, "MSFT", 2, [{"Note": "quota"}]),
        feed(ALPHA_VANTAGE, "AMZN", 3, [{"title": "Lost", "url": "u9", "summary": ""}]),
        feed(FINNHUB, "AMD", 0, [
            {"headline": "First with title", "url": "u1", "summary": "", "datetime": 1705311000},
            {"headline": "Third copy", "url": "u2", "summary": "", "datetime": 0},
        ]),
        feed(MARKETAUX, "XXX", 0, [{"title": "Unknown stock", "url": "u4", "description": "rain"}]),
        feed(YFINANCE, "WMT", 0, [
            {"content": {"title": "Old", "canonicalUrl": {"url": "u5"}, "pubDate": "2024-01-15T00:00:00Z"}},
            {"content": {"title": "New", "canonicalUrl": {"url": "u6"}, "pubDate": "2024-01-15T11:00:00Z"}},
        ]),
    ]


EXPECTED = [
    ("u1", "AMD", "First with title", FINNHUB),
    ("u2", "TSLA", "Plain", ALPHA_VANTAGE),
    ("u3", "AAPL", "Later", ALPHA_VANTAGE),
    ("u6", "WMT", "New", YFINANCE),
]


def test_collector_run_and_replay(spark, stocks, tmp_path):
    path = str(tmp_path / "articles")
    payloads = spark.createDataFrame(run_one(), schemas.LANDED_PAYLOAD)
    for _ in range(2):
        collector.run_collector(spark, payloads, path, stocks, dt.datetime(2024, 1, 15, 12))
        assert stored(spark, path, "url", "symbol", "title", "source_api") == EXPECTED
    ids = dict(stored(spark, path, "symbol", "stock_id"))
    assert ids == {s: SYMBOLS.index(s) + 1 for s in ("AMD", "TSLA", "AAPL", "WMT")}
    assert stored(spark, path, "url", "text", "image_url")[0] == ("u1", None, None)


def test_collector_needs_all_stocks(spark, stocks, tmp_path):
    payloads = spark.createDataFrame(run_one(), schemas.LANDED_PAYLOAD)
    with pytest.raises(RuntimeError, match="TXN"):
        collector.run_collector(spark, payloads, str(tmp_path / "a"), stocks.filter("symbol <> 'TXN'"))


# --- stream ------------------------------------------------------------------------------------


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    names = schemas.LANDED_PAYLOAD.names
    (folder / name).write_text("".join(json.dumps(dict(zip(names, r))) + "\n" for r in rows))


def manifest(folder, run, hour, path):
    folder.mkdir(exist_ok=True)
    row = {"run_id": run, "started_at": f"2024-01-15T{hour:02}:00:00Z", "path": str(path)}
    (folder / f"{run}.json").write_text(json.dumps(row) + "\n")


@pytest.mark.parametrize("cut", [1, 3, 100])
def test_stream_equals_batch_and_replays_add_nothing(spark, stocks, tmp_path, cut):
    """However a run's responses are cut into files, and whatever has landed before its end."""
    landing, articles = tmp_path / "landing", str(tmp_path / "articles")
    loader = ingest.batch_loader(articles, stocks)

    def run(checkpoint):
        stream = ingest.run_stream(spark, str(tmp_path / "runs"))
        ingest.start_ingest(stream, str(tmp_path / checkpoint), loader).awaitTermination()
        return stored(spark, articles, "url", "symbol", "title", "source_api")

    rows = run_one()
    for at in range(0, len(rows), cut):
        land(landing, f"{at}.json", rows[at : at + cut])
    (tmp_path / "runs").mkdir()
    assert run("c1") == []
    manifest(tmp_path / "runs", "r1", 10, landing)
    want = sorted(EXPECTED + [("u5", "WMT", "Old", YFINANCE)])
    assert run("c1") == want
    assert run("c1") == want
    assert run("c2") == want

    batch = str(tmp_path / "batch")
    collector.run_collector(spark, spark.createDataFrame(rows, schemas.LANDED_PAYLOAD), batch, stocks)
    assert stored(spark, batch, "url", "symbol", "title", "source_api") == want


@pytest.mark.parametrize("runs_per_batch", [None, 1])
def test_runs_are_stored_in_order_of_their_start(spark, stocks, tmp_path, runs_per_batch):
    """The later run-10 keeps its article only because run-9 could not link it."""
    articles = str(tmp_path / "articles")
    runs = {
        "run-9": (9, [feed(FINNHUB, "", 0, [{"headline": "x", "url": "u1", "summary": "rain"}], run="run-9"),
                      feed(FINNHUB, "AMD", 1, [{"headline": "early", "url": "u2", "summary": ""}], run="run-9")]),
        "run-10": (10, [feed(ALPHA_VANTAGE, "NVDA", 0, [{"title": "late", "url": "u2"}, {"title": "linked", "url": "u1"}], run="run-10")]),
    }
    for name, (hour, rows) in runs.items():
        land(tmp_path / name, "a.json", rows)
        manifest(tmp_path / "runs", name, hour, tmp_path / name)
        os.utime(tmp_path / "runs" / f"{name}.json", (hour, hour))
    stream = ingest.run_stream(spark, str(tmp_path / "runs"), runs_per_batch)
    ingest.start_ingest(stream, str(tmp_path / "c"), ingest.batch_loader(articles, stocks)).awaitTermination()
    assert stored(spark, articles, "url", "symbol", "title") == [("u1", "NVDA", "linked"), ("u2", "AMD", "early")]


def test_collector_reports_its_run(spark, stocks, tmp_path):
    payloads = spark.createDataFrame(run_one(), schemas.LANDED_PAYLOAD)
    path = str(tmp_path / "articles")
    report = collector.run_collector(spark, payloads, path, stocks, dt.datetime(2024, 1, 15, 12))
    assert (report.raw, report.unique, report.new, report.inserted) == (8, 5, 5, 4)
    # u4 keeps the symbol it was requested for, which has no stock.
    assert (report.assigned, report.unmatched) == (5, 0)
    assert report.per_provider == {ALPHA_VANTAGE: 4, FINNHUB: 2, MARKETAUX: 1, YFINANCE: 1}
    assert [report.status[p][:5] for p in (ALPHA_VANTAGE, FINNHUB)] == ["LIMIT", "ACTIV"]
    again = collector.run_collector(spark, payloads, path, stocks, dt.datetime(2024, 1, 15, 12))
    assert (again.raw, again.new, again.assigned, again.unmatched, again.inserted) == (8, 1, 1, 0, 0)


def test_collector_counts_articles_that_name_no_stock(spark, stocks, tmp_path):
    items = [{"headline": "Tesla", "url": "u1", "datetime": 0}, {"headline": "Rain", "url": "u2", "datetime": 0}]
    payloads = spark.createDataFrame([feed(FINNHUB, "", 0, items)], schemas.LANDED_PAYLOAD)
    report = collector.run_collector(spark, payloads, str(tmp_path / "articles"), stocks)
    assert (report.new, report.assigned, report.unmatched, report.inserted) == (2, 1, 1, 1)


def test_repeated_captures_do_not_multiply_articles(spark, stocks, tmp_path):
    path = str(tmp_path / "articles")
    rows = spark.createDataFrame([("u1", "A"), ("u2", "B")], "url string, title string")
    rows = rows.withColumn(schemas.ARTICLE_DAY, F.lit("2024-01-15").cast("date"))
    writers.append_new(spark, path, rows, schemas.NEWS_ARTICLES, partition=schemas.ARTICLE_DAY)
    tag = '<meta property="og:image" content="https://i.example.com/{}.png">'
    pages = spark.createDataFrame(
        [("u1", 3, tag.format(3)), ("u1", 2, tag.format(2)), ("u1", 1, ""), ("u2", 1, "")],
        "url string, at int, html string")
    report = image_backfill.run_backfill(spark, path, pages, order=["at"]).first()
    assert (report["updated"], report["not_found"]) == (1, 1)
    assert stored(spark, path, "url", "image_url") == [("u1", "https://i.example.com/2.png"), ("u2", None)]


def test_a_stopped_swap_is_finished_by_the_next_writer(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "daily")
    keys, schema = ["stock_id", "sentiment_date"], schemas.DAILY_SENTIMENT

    def upsert(*rows):
        df = spark.createDataFrame([(s, dt.date(2024, 1, d), n) for s, d, n in rows],
                                   "stock_id bigint, sentiment_date date, article_count bigint")
        writers.upsert_partitions(spark, path, df, schema, keys, ["article_count"], "sentiment_date")

    upsert((1, 1, 10), (2, 1, 20))
    finish = writers.finish_replacement
    with monkeypatch.context() as patch:
        calls = []
        patch.setattr(writers, "finish_replacement", lambda *a: finish(*a) if not calls.append(a) and len(calls) == 1 else None)
        upsert((1, 1, 11))
    upsert((3, 2, 30))
    table = writers.read_table(spark, path, schema)
    assert sorted((r["stock_id"], r["article_count"]) for r in table.collect()) == [(1, 11), (2, 20), (3, 30)]


def test_recent_repeats_are_dropped_from_a_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    moment = dt.datetime(2024, 1, 15, 12)
    rows = [("u1", moment), ("u1", moment + dt.timedelta(minutes=5)), ("u2", moment)]
    df = spark.createDataFrame(rows, "url string, published_at timestamp")
    df.write.parquet(folder)
    stream = ingest.drop_recent_repeats(spark.readStream.schema(df.schema).parquet(folder))
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "c"))
        .option("path", str(tmp_path / "out"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert sorted(r["url"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["u1", "u2"]


# --- CSV load and backfill ----------------------------------------------------------------------


def test_csv_load_is_resumable_and_images_are_filled(spark, stocks, tmp_path):
    news, scores = tmp_path / "news", tmp_path / "scores"
    news.mkdir(), scores.mkdir()
    header = "url,title,description,source,published_at,source_api\n"
    (news / "NVDA.csv").write_text(
        header + "https://h/1,T1,D,S,2024-01-15T09:00:00Z,api\nhttps://h/1,T1b,D,S,,\n,T0,D,S,,\n"
    )
    (news / "AMD.csv").write_text(header + "https://h/1,T1c,D,S,,\nhttps://h/2,NA,D,S,junk,api\n")
    (news / "TXN.csv").write_text("")
    label = "url,sentiment_label,positive_score,neutral_score,negative_score,sentiment_score\n"
    (scores / "NVDA_sentiment.csv").write_text(label + "https://h/1,positive,0.5,bad,,nan\nhttps://h/9,x,1,1,1,1\n")
    (scores / "AMD_sentiment.csv").write_text(label + "https://h/1,negative,0,0,0,0\n")
    day = ",".join(schemas.DAILY_CSV) + "\n"
    (scores / "NVDA_daily_sentiment.csv").write_text(
        day + "2024-01-15,3,1,1,1,.1,.2,.3,.4,.5\n2024-01-15,4,1,1,1,.1,.2,.3,.4,.5\n,1,1,1,1,1,1,1,1,1\n2024-02-30,1,1,1,1,1,1,1,1,1\n"
    )
    tables = csv_load.Tables(*(str(tmp_path / n) for n in ("articles", "sentiment", "daily")))

    def load():
        reports = csv_load.run_load(spark, str(news), str(scores), str(scores), tables, stocks)
        names = ("rows", "inserted", "skipped", "missing", "errors")
        return {
            job: {r["symbol"]: tuple(r[n] for n in names) for r in df.collect()}
            for job, df in reports.items()
            if job != "tables"
        }, {r["table_name"]: r["rows"] for r in reports["tables"].collect()}

    counts, sizes = load()
    assert counts["news"] == {"NVDA": (3, 1, 0, 0, 0), "AMD": (2, 1, 1, 0, 0), None: (5, 2, 1, 0, 1)}
    assert counts["sentiment"] == {"NVDA": (2, 1, 0, 1, 0), "AMD": (1, 0, 1, 0, 0), None: (3, 1, 1, 1, 0)}
    assert counts["daily"] == {"NVDA": (4, 2, 0, 0, 1), None: (4, 2, 0, 0, 1)}
    want = {"stocks": 20, "stock_prices": None, "news_articles": 2, "news_sentiment": 1, "daily_sentiment": 1}
    assert sizes == want
    moment = dt.datetime(2024, 1, 15, 9)
    assert stored(spark, tables.news_articles, "url", "symbol", "title", "published_at") == [
        ("https://h/1", "NVDA", "T1", moment),
        ("https://h/2", "AMD", None, None),
    ]
    daily = writers.read_table(spark, tables.daily_sentiment, schemas.DAILY_SENTIMENT).first()
    assert (daily["stock_id"], daily["article_count"], daily["sentiment_balance"]) == (1, 4, 0.5)

    counts, sizes = load()
    assert counts["news"][None] == (5, 0, 3, 0, 1)
    assert counts["sentiment"][None] == (3, 0, 2, 1, 0)
    assert sizes == want

    daily_rollup.run_daily_rollup(spark, tables.news_articles, tables.news_sentiment, tables.daily_sentiment)
    daily = writers.read_table(spark, tables.daily_sentiment, schemas.DAILY_SENTIMENT).collect()
    assert [(r["stock_id"], r["article_count"], r["average_positive"], r["sentiment_balance"]) for r in daily] == [
        (1, 1, 0.5, 1.0)
    ]

    pages = spark.createDataFrame(
        [("https://h/1", "<meta property=og:image content=/i.png>"), ("https://h/2", "<p>none</p>")],
        "url string, html string",
    )
    found = image_backfill.run_backfill(spark, tables.news_articles, pages)
    assert tuple(found.first()) == (1, 1)
    assert stored(spark, tables.news_articles, "url", "image_url") == [
        ("https://h/1", "https://h/i.png"),
        ("https://h/2", None),
    ]
    assert len({r[0] for r in stored(spark, tables.news_articles, "id")}) == 2

    table = writers.read_table(spark, tables.news_articles, schemas.NEWS_ARTICLES)
    rows, summary = news_page.feed_page(table, 1, 2)
    assert [r["url"] for r in rows.collect()] == ["https://h/2", "https://h/1"]
    assert tuple(summary.first()) == (1, 2, 2, True)
    assert distinct_urls(table).count() == 2


def test_first_of_repeats_is_the_same_for_any_arrival(spark, tmp_path):
    """Shuffled files in many batches against the plain chains: a hot URL, ties, undated rows, no URL."""
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(900):
        url = "hot" if rng.random() < 1 / 3 else rng.choice(["", None, *[f"u{n}" for n in range(60)]])
        at = start + dt.timedelta(minutes=rng.randrange(3000))
        rows.append((url, None if i % 9 == 0 else at, at, rng.randrange(3), i, f"id{i}"))
    schema = "url string, published_at timestamp, began timestamp, rank int, pos int, _row string"
    want = []
    for url in {r[0] for r in rows} - {None}:
        chain, last = [], None
        for row in sorted((r for r in rows if r[0] == url), key=lambda r: r[2]):
            if last is not None and row[2] - last > dt.timedelta(minutes=30):
                want.append(min(chain, key=lambda r: r[3:5])[-1])
                chain = []
            chain.append(row)
            last = row[2]
        want.append(min(chain, key=lambda r: r[3:5])[-1])
    how = {"order": ["rank", "pos"], "gap": "30 minutes", "undated": "began"}
    batch = ingest.first_of_repeats(spark.createDataFrame(rows, schema), **how)
    assert batch.columns == ["url", "published_at", "began", "rank", "pos", "_row"]
    assert sorted(r["_row"] for r in batch.collect()) == sorted(want)

    # In files of any order; the delay covers all of the disorder. The last file closes all chains.
    rng.shuffle(rows)
    landing = str(tmp_path / "landing")
    end = [("end", dt.datetime(2100, 1, 1), dt.datetime(2100, 1, 1), 0, 0, "end")]
    for part in (rows[:300], rows[300:600], rows[600:], end):
        spark.createDataFrame(part, schema).coalesce(2).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
        first = ingest.first_of_repeats(stream, delay="3 days", **how)
        query = first.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint"))
        query.trigger(availableNow=True).start(str(tmp_path / "first")).awaitTermination()
    got = spark.read.schema(schema).parquet(str(tmp_path / "first")).filter("url <> 'end'")
    assert sorted(r["_row"] for r in got.collect()) == sorted(want)


def test_runs_of_a_day_land_in_one_folder(spark, tmp_path):
    """2,000 documents are 40 runs of 50 minutes, which began on two days."""
    docs = spark.range(2000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 1500).alias("text"),
        F.lit("fr").alias("lang"), F.lit("src1").alias("source"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    manifests = roles.run_manifests(docs, "/landing").collect()
    assert len({m["run_id"] for m in manifests}) == len(manifests) == 40
    assert {m["path"] for m in manifests} == {"/landing/day=2024-01-01", "/landing/day=2024-01-02"}
    got = workload_queries.stream_ingest_runs(spark, str(tmp_path))
    # Every fourth run ends at place 13; the copies in later runs are stored already, unless it was cut there.
    kept = {n % 1500 for n in range(2000) if n // 50 % 4 or n % 50 < 13}
    assert got.count() == 2 * len(kept)
    assert got.select("url").distinct().count() == 2 * len(kept)
