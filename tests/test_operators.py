"""Table operators on edge rows, and against brute force."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from newsflow import stocks
from newsflow.operators import articles as art
from newsflow.operators import alias_index, dedup, feed, filters, images, reports, sentiment, stock_match

ARTICLE = "url string, title string, description string, symbol string"


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# --- deduplication ------------------------------------------------------------


def copies(seed, n=4000):
    """Random copies; one URL holds a third of them."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        url = "hot" if rng.random() < 1 / 3 else f"u{rng.randrange(400)}"
        rows.append((url, rng.randrange(4), rng.randrange(20), i, f"text {i}"))
    return rows


@pytest.mark.parametrize("partitions", [1, 7, 32])
def test_first_seen_equals_brute_force_for_any_partitioning(spark, partitions):
    rows = copies(3)
    best = {}
    for row in rows:
        if row[0] not in best or row[1:4] < best[row[0]][1:4]:
            best[row[0]] = row
    df = spark.createDataFrame(rows, "url string, provider int, symbol int, pos int, body string")
    got = dedup.first_seen(df.repartition(partitions), ["url"], ["provider", "symbol", "pos"])
    assert sorted(tuple(r) for r in got.collect()) == sorted(best.values())


def test_last_wins_equals_brute_force(spark):
    rows = copies(4)
    last = {}
    for row in rows:
        if (row[0], row[1]) not in last or row[3] > last[row[0], row[1]][3]:
            last[row[0], row[1]] = row
    df = spark.createDataFrame(rows, "url string, provider int, symbol int, pos int, body string")
    got = dedup.last_wins(df.repartition(5), ["url", "provider"], ["pos"])
    assert sorted(tuple(r) for r in got.collect()) == sorted(last.values())


def test_copy_without_title_does_not_win(spark):
    rows = [("u", None, 0), ("u", "", 1), ("u", "T", 2), ("", "T", 3), (None, "T", 4)]
    df = spark.createDataFrame(rows, "url string, title string, pos int")
    got = dedup.first_seen(filters.valid_articles(df), ["url"], ["pos"])
    assert values(got, "url", "pos") == [("u", 2)]
    assert values(filters.with_url(df), "pos") == [(0,), (1,), (2,)]


# --- stocks ---------------------------------------------------------------------


def assigned(spark, rows, **how):
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], ARTICLE)
    got = stock_match.assign_stock(df, **how).collect()
    return {int(r["url"]): r["symbol"] for r in got}


def test_stock_association(spark):
    rows = [
        ("Metal prices", None, "TXN"),
        (None, "artificial intelligence", "TXN"),
        ("rising costs", "", "TXN"),
        ("GOOG falls", "Alphabet", "GOOG"),
        ("weather", "rain", "GOOG"),
        ("Tesla and NVIDIA", "", "WMT"),
        ("Texas", "Instruments", None),
        ("weather", "rain", ""),
        ("weather", None, None),
        ("", "FACEBOOK", None),
        (None, None, "AMD"),
    ]
    assert assigned(spark, rows) == {
        0: "META",
        1: "INTC",
        2: "COST",
        3: "GOOGL",
        4: "GOOG",
        5: "NVDA",
        6: "TXN",
        9: "META",
        10: "AMD",
    }


def test_whole_words_only_on_request(spark):
    rows = [("Metal prices", None, "TXN"), ("Meta, again", None, "TXN"), ("costs", "Intel", "TXN")]
    assert assigned(spark, rows, whole_words=True) == {0: "TXN", 1: "META", 2: "INTC"}


def test_all_matches_in_rank_order(spark):
    df = spark.createDataFrame([("u", "Tesla, Google", "nvidia", "X"), ("v", "rain", "", "X")], ARTICLE)
    got = stock_match.all_stock_matches(df)
    assert values(got, "match_rank", "match_symbol") == [(0, "NVDA"), (4, "GOOGL"), (5, "GOOG"), (8, "TSLA")]
    first = {r["url"]: r["symbol"] for r in stock_match.assign_stock(df).collect()}
    assert first == {"u": "NVDA", "v": "X"}


def dictionary(spark, aliases):
    rows = [(name, alias, rank) for rank, (name, names) in enumerate(aliases.items()) for alias in names]
    return spark.createDataFrame(rows, "symbol string, alias string, rank int")


@pytest.mark.parametrize("whole_words", [False, True])
def test_indexed_aliases_equal_literal_ones(spark, monkeypatch, whole_words):
    """Long texts, aliases at the seams of pieces, of one character, with regex signs and outside the basic plane."""
    monkeypatch.setattr(alias_index, "PIECE", 8)
    rng = random.Random(3)
    pieces = ["ab", "abc", "b", "bcd", "xyz.", "yz", "Éa", "\U0001f600q", " ", "\n", "bank of x", "bank of y"]
    for _ in range(2):
        aliases = {f"s{i}": [p.upper() for p in rng.sample(pieces[:8] + pieces[10:], 2)] for i in range(4)}
        rows = [(str(i), "".join(rng.choices(pieces, k=rng.randrange(0, 30))) or None, rng.choice(["", None, "k abc"]),
                 rng.choice(["own", "", None])) for i in range(300)]
        df = spark.createDataFrame(rows, ARTICLE)
        want = stock_match.assign_stock(df, aliases, whole_words)
        got = stock_match.assign_stock(df, dictionary(spark, aliases), whole_words)
        assert got.columns == want.columns
        assert values(got, "url", "symbol") == values(want, "url", "symbol")


def test_index_without_broadcast_and_its_edges(spark):
    df = spark.createDataFrame([("u", "x" * 5000 + "needle" + "y" * 3000, "", "own"), ("v", None, None, None)], ARTICLE)
    names = {"hay": ["", "needles"], "far": ["XNEEDLEY", None]}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert values(stock_match.assign_stock(df, dictionary(spark, names)), "url", "symbol") == [("u", "far")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert values(stock_match.assign_stock(df, dictionary(spark, {}) ), "url", "symbol") == [("u", "own")]
    with pytest.raises(ValueError):
        stock_match.assign_stock(df, dictionary(spark, {"s": ["z" * 300]}))


def test_literal_aliases_are_bounded(spark):
    df = spark.createDataFrame([("u", "a", "b", "own")], ARTICLE)
    many = {"s": [f"name {i}" for i in range(stock_match.MOST_LITERALS + 1)]}
    for match in (stock_match.assign_stock, stock_match.all_stock_matches):
        with pytest.raises(ValueError):
            match(df, many)


def test_stock_master(spark):
    master = stocks.stock_master(spark)
    assert master.count() == 20 and stocks.alias_table(spark).count() == 45
    wanted = spark.createDataFrame([("AAPL",), ("INFY",)], "symbol string")
    assert values(art.stock_lookup(wanted, master).fillna("-", ["name"]), "symbol", "name") == [
        ("AAPL", "Apple"),
        ("INFY", "-"),
    ]
    assert [r["source_api"] for r in stocks.provider_table(spark).orderBy("provider_rank").collect()] == list(
        stocks.PROVIDERS
    )


def test_missing_symbols_stop_the_run(spark):
    master = stocks.stock_master(spark)
    table = master.filter("symbol not in ('TXN', 'AMD')").withColumn("id", F.col("symbol_rank"))
    with pytest.raises(RuntimeError, match="AMD, TXN"):
        art.require_symbols(master, table)
    art.require_symbols(master, master.withColumn("id", F.col("symbol_rank")))


# --- stored tables -----------------------------------------------------------------


def test_new_rows_both_ways(spark):
    rng = random.Random(5)
    new = [(f"u{i}", i) for i in rng.sample(range(2000), 900)]
    old = [(f"u{i}",) for i in rng.sample(range(2000), 700)] * 2 + [(None,)]
    candidates = spark.createDataFrame(new, "url string, n int")
    stored = spark.createDataFrame(old, "url string")
    want = sorted((u, n) for u, n in new if (u,) not in set(old))
    assert values(art.new_rows(candidates, stored), "url", "n") == want
    assert values(art.new_rows_probed(candidates, stored), "url", "n") == want
    marked = art.mark_stored(candidates, stored)
    assert values(marked.filter("not is_stored"), "url", "n") == want
    assert marked.count() == len(new)


def test_sentiment_match(spark):
    articles = spark.createDataFrame([(0, "zero"), (7, "u7")], "id bigint, url string")
    rows = [("zero", "positive"), ("u7", "NA"), ("other", "x")]
    scores = "'1.5' positive_score, 'bad' neutral_score, null negative_score, 'nan' sentiment_score"
    df = spark.createDataFrame(rows, "url string, sentiment_label string").selectExpr("*", *scores.split(", "))
    matched = sentiment.attach_news_id(df, articles)
    assert {r["url"]: r["news_id"] for r in matched.collect()} == {"zero": None, "u7": 7, "other": None}
    (record,) = sentiment.sentiment_record(matched).collect()
    assert tuple(record) == (7, None, 1.5, None, None, None, "ProsusAI/finbert")


def test_daily_record_and_rollup(spark):
    rows = [(3, "A", "2024-01-15", "12.7"), (3, "A", None, "1"), (3, "A", "", "1"), (3, "A", "NA", "1")]
    df = spark.createDataFrame(rows, "stock_id int, symbol string, published_date string, article_count string")
    for name in ("positive_articles", "neutral_articles", "negative_articles"):
        df = df.withColumn(name, F.lit("abc"))
    for name in ("average_positive", "average_neutral", "average_negative", "average_sentiment", "sentiment_balance"):
        df = df.withColumn(name, F.lit("0.25"))
    (record,) = sentiment.daily_record(df).collect()
    assert tuple(record)[:7] == (3, "A", dt.date(2024, 1, 15), 12, 0, 0, 0)

    moment = dt.datetime(2024, 1, 15, 23, 59)
    scored = spark.createDataFrame(
        [
            (1, "A", moment, "positive", 0.5),
            (1, "A", moment, "Negative", 1.5),
            (1, "A", moment, "positive", None),
            (1, "A", None, "positive", 9.0),
        ],
        "stock_id int, symbol string, published_at timestamp, sentiment_label string, positive_score double",
    )
    for name in ("neutral_score", "negative_score", "sentiment_score"):
        scored = scored.withColumn(name, F.col("positive_score"))
    (day,) = sentiment.daily_sentiment(scored).collect()
    assert (day["article_count"], day["positive_articles"], day["negative_articles"]) == (3, 2, 1)
    assert day["average_positive"] == 1.0
    assert day["sentiment_balance"] == pytest.approx(1 / 3)


# --- images ---------------------------------------------------------------------------


def test_images_only_for_articles_without_one(spark):
    stored = spark.createDataFrame(
        [("https://h/a", "T", None), ("https://h/b", "T", "kept"), ("https://h/c", None, None), (None, "T", None)],
        "url string, title string, image_url string",
    )
    tag = "<meta property='og:image' content='{}'>"
    pages = spark.createDataFrame(
        [("https://h/a", tag.format("x.png")), ("https://h/b", tag.format("y.png")), ("https://h/d", tag.format("z"))],
        "url string, html string",
    )
    found = images.extract_images(stored, pages)
    assert {r["url"]: r["image_url"] for r in found.collect()} == {
        "https://h/a": "https://h/x.png",
        "https://h/c": None,
    }
    assert tuple(images.backfill_counts(found).first()) == (1, 1)


# --- feed -------------------------------------------------------------------------------


def timeline(spark, n=1000, seed=1):
    """Articles with many equal times, some without a time, a third in one second."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rng.random() < 1 / 3:
            moment = dt.datetime(2024, 1, 10, 12)
        elif rng.random() < 0.05:
            moment = None
        else:
            moment = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(30_000))
        rows.append((f"u{i:05d}", moment))
    df = spark.createDataFrame(rows, "url string, published_at timestamp")
    newest = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] - dt.datetime(2020, 1, 1)).total_seconds() if r[1] else 0, r[0]))
    return df, [url for url, _ in newest]


@pytest.mark.parametrize("page,limit", [(1, 100), (2, 7), (10, 100), (11, 100), (50, 100), (3, 6)])
@pytest.mark.parametrize("sorted_rows", [0, 50, 100_000])
def test_pages_equal_brute_force(spark, page, limit, sorted_rows):
    df, newest = timeline(spark)
    got = feed.news_page(df.repartition(5), page, limit, sorted_rows=sorted_rows).collect()
    assert [r["url"] for r in got] == newest[(page - 1) * limit : page * limit]


@pytest.mark.parametrize("page,limit", [(1, 100), (4, 100), (10, 100), (11, 100), (3, 6)])
def test_pages_of_a_table_laid_out_by_day(spark, tmp_path, page, limit):
    df, newest = timeline(spark)
    path = str(tmp_path / "t")
    df.withColumn("published_day", F.to_date("published_at")).write.partitionBy("published_day").parquet(path)
    got = feed.news_page(spark.read.parquet(path), page, limit, day="published_day", sorted_rows=50)
    assert [r["url"] for r in got.collect()] == newest[(page - 1) * limit : page * limit]
    if page == 3:
        text = got._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnull(published_day" in text


def test_page_bounds():
    assert feed.page_bounds() == (1, 100)
    assert feed.page_bounds(0, 0) == (1, 1)
    assert feed.page_bounds("3", "500") == (3, 100)
    assert feed.page_bounds(-4, 7) == (1, 7)
    for bad in [("x", 1), (1, "y"), (None, 1), ("1.5", 1)]:
        with pytest.raises(ValueError):
            feed.page_bounds(*bad)


def test_a_full_last_page_announces_another(spark):
    df, _ = timeline(spark, n=10)
    for page, limit, count, more in [(2, 5, 5, True), (3, 5, 0, False), (2, 7, 3, False)]:
        summary = feed.page_summary(feed.news_page(df, page, limit), page, limit).first()
        assert tuple(summary) == (page, limit, count, more)


def test_feed_projection_and_display(spark):
    moment = dt.datetime(2024, 1, 15, 12)
    rows = [
        ("A", "T", "D", "S", "u", moment, "api", "https://i/ü?a=1"),
        (None, "", None, "", "v", None, "api", ""),
        (None, None, None, None, "w", moment, "", None),
    ]
    df = spark.createDataFrame(
        rows,
        "symbol string, title string, description string, source string, url string,"
        " published_at timestamp, source_api string, image_url string",
    )
    links = {r["url"]: r["image_proxy_url"] for r in feed.feed_projection(df).collect()}
    assert links == {"u": "/api/news-image?url=https%3A%2F%2Fi%2F%C3%BC%3Fa%3D1", "v": None, "w": None}
    shown = feed.feed_display(df, F.lit(moment).cast("timestamp"))
    assert values(shown, "url", "byline", "headline", "teaser", "symbol") == [
        ("u", "Just now • S", "T", "D", "A"),
        ("v", "Time unavailable • api", "Untitled financial news", "", ""),
        ("w", "Just now • Financial News", "Untitled financial news", "", ""),
    ]


# --- reports ------------------------------------------------------------------------------


def test_run_funnel_adds_up(spark):
    rows = [
        ("u1", "Tesla", "", "X", 0),
        ("u1", "other", "", "X", 1),
        ("u2", "rain", "", "", 2),
        ("u3", "rain", "", "Y", 3),
        ("u4", "rain", "", "TSLA", 4),
        ("u5", "", "", "TSLA", 5),
    ]
    df = spark.createDataFrame(rows, ARTICLE + ", pos int")
    stored = spark.createDataFrame([("u4",), ("zz",)], "url string")
    ids = spark.createDataFrame([(1, "TSLA")], "id bigint, symbol string")
    steps = {r["step"]: r["rows"] for r in reports.run_funnel(df, stored, ids, ["pos"]).collect()}
    assert steps == {
        "raw": 6,
        "unique": 4,
        "already_stored": 1,
        "new": 3,
        "unmatched": 1,
        "assigned": 2,
        "inserted": 1,
    }


def test_counts_of_absent_tables(spark):
    spark.range(3).createOrReplaceTempView("here")
    got = {r["table_name"]: r["rows"] for r in reports.catalog_counts(spark, ["here", "nowhere"]).collect()}
    assert got == {"here": 3, "nowhere": None}


def test_leaving_out_implied_aliases_changes_nothing(spark):
    rng = random.Random(9)
    pieces = ["ab", "abc", "b", "bcd", "xyz", "yz", "q", " "]
    for _ in range(4):
        aliases = {f"s{i}": [p.upper() for p in rng.sample(pieces[:7], rng.randrange(1, 4))] for i in range(5)}
        texts = ["".join(rng.choices(pieces + ["k"], k=rng.randrange(0, 5))) for _ in range(400)]
        want = []
        for t in texts:
            hits = [s for s, names in aliases.items() if any(n.lower() in t for n in names)]
            want.append((hits[0] if hits else "own", len(hits)))
        df = spark.createDataFrame([(str(i), t, "", "own") for i, t in enumerate(texts)], ARTICLE)
        first = {int(r["url"]): r["symbol"] for r in stock_match.assign_stock(df, aliases).collect()}
        every = {int(r["url"]): r["count"] for r in stock_match.all_stock_matches(df, aliases).groupBy("url").count().collect()}
        assert [(first[i], every.get(i, 0)) for i in range(len(texts))] == want


def test_page_among_many_undated_rows(spark, monkeypatch):
    """40,000 rows without a time and with URLs alike: the driver sees the page's groups and a constant."""
    rows = spark.range(40_000).select(
        F.lit(None).cast("timestamp").alias("published_at"),
        F.format_string("https://news.example.com/the-same-beginning/%06d", (F.col("id") * 7919) % 40_000).alias("url"),
    ).repartition(8)
    seen, collect = [], type(rows).collect

    def counted(df):
        found = collect(df)
        seen.append(len(found))
        return found

    monkeypatch.setattr(type(rows), "collect", counted)
    page = feed.news_page(rows, 350, 100, sorted_rows=50)
    monkeypatch.undo()
    want = [f"https://news.example.com/the-same-beginning/{n:06d}" for n in range(34_900, 35_000)]
    assert [r["url"] for r in page.collect()] == want
    assert max(seen) <= feed.FIRST_GROUPS


def test_page_past_the_groups_looked_at_first(spark, monkeypatch):
    """Whatever the number of groups looked at first, the page is the same."""
    rows = spark.range(3000).select(
        F.timestamp_seconds((F.col("id") * 31) % 700 * 3600).alias("published_at"),
        F.format_string("u%05d", "id").alias("url"))
    pages = {(n, k): None for n in (1, 7, 60) for k in (1, 5)}
    for first in (1, 3, 1000):
        monkeypatch.setattr(feed, "FIRST_GROUPS", first)
        for number, size in pages:
            got = [r["url"] for r in feed.news_page(rows, number, 10 * size, sorted_rows=20).collect()]
            assert pages[number, size] in (None, got)
            pages[number, size] = got
    everything = [r["url"] for r in rows.orderBy(F.desc("published_at"), "url").collect()]
    for (number, size), got in pages.items():
        assert got == everything[(number - 1) * 10 * size : number * 10 * size]


def test_a_repeated_symbol_multiplies_no_article(spark):
    articles = spark.createDataFrame([("NVDA", "u1"), ("AMD", "u2"), ("XYZ", "u3")], "symbol string, url string")
    stocks = spark.createDataFrame([(1, "NVDA"), (7, "NVDA"), (2, "AMD")], "id bigint, symbol string")
    got = sorted((r["url"], r["stock_id"]) for r in art.attach_stock_id(articles, stocks).collect())
    assert got == [("u1", 7), ("u2", 2)]
