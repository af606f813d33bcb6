"""Landed responses: shapes, limits, breaker and the four normalisers."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from newsflow import schemas
from newsflow.sources import payloads
from newsflow.stocks import ALPHA_VANTAGE, FINNHUB, MARKETAUX, YFINANCE


def landed(spark, rows):
    """rows: (provider, symbol, seq, status, body or object)"""
    records = [
        ("run", p, s, n, status, body if isinstance(body, (str, type(None))) else json.dumps(body))
        for p, s, n, status, body in rows
    ]
    return spark.createDataFrame(records, schemas.LANDED_PAYLOAD)


def articles(spark, rows, window=None):
    out = payloads.normalize(landed(spark, rows), window).orderBy("provider_rank", "seq", "pos")
    return [r.asDict() for r in out.collect()]


def news(url, **fields):
    return {"title": "T", "url": url, **fields}


def test_wrong_shapes_give_no_rows(spark):
    rows = [
        (ALPHA_VANTAGE, "A", 0, 200, {"feed": {"title": "T"}}),
        (ALPHA_VANTAGE, "A", 1, 200, {"other": []}),
        (ALPHA_VANTAGE, "A", 2, 200, [news("u")]),
        (MARKETAUX, "A", 3, 200, {"data": "text"}),
        (FINNHUB, "A", 4, 200, {"headline": "T", "url": "u"}),
        (FINNHUB, "A", 5, 200, [1, 2]),
        (FINNHUB, "A", 6, 200, "not json"),
        (FINNHUB, "A", 7, 200, [{"headline": "T", "url": "u"}, 5]),
        (YFINANCE, "A", 8, 200, {"content": {}}),
        (YFINANCE, "A", 9, 200, None),
        ("Unknown", "A", 10, 200, [news("u")]),
        (FINNHUB, "A", 11, 200, []),
    ]
    assert articles(spark, rows) == []


def test_compact_time_provider(spark):
    body = {
        "feed": [
            {"title": "T", "summary": "S", "source": "P", "url": "u1", "time_published": "20240115T093000"},
            {"title": "T", "url": "u2", "time_published": "yesterday"},
            {"url": "u3"},
        ]
    }
    got = articles(spark, [(ALPHA_VANTAGE, "NVDA", 4, 200, body)])
    assert got[0] == {
        "run_id": "run",
        "provider_rank": 0,
        "seq": 4,
        "pos": 0,
        "source_api": ALPHA_VANTAGE,
        "symbol": "NVDA",
        "title": "T",
        "description": "S",
        "source": "P",
        "url": "u1",
        "published_at": dt.datetime(2024, 1, 15, 9, 30),
    }
    assert [(r["pos"], r["title"], r["published_at"]) for r in got[1:]] == [(1, "T", None), (2, None, None)]


def test_epoch_provider(spark):
    times = [1705311000, 0, None, 1e18, "1705311000", -86400]
    body = [{"headline": f"T{i}", "summary": "S", "url": f"u{i}", "datetime": t} for i, t in enumerate(times)]
    got = articles(spark, [(FINNHUB, "A", 0, 200, body)])
    moment = dt.datetime(2024, 1, 15, 9, 30)
    assert [r["published_at"] for r in got] == [moment, None, None, None, None, dt.datetime(1969, 12, 31)]
    assert got[0]["title"] == "T0" and got[0]["description"] == "S"


def test_plain_provider(spark):
    body = {"data": [news("u", description="D", source="P", published_at="2024-01-15T09:30:00.000000Z")]}
    (got,) = articles(spark, [(MARKETAUX, "A", 0, 200, body)])
    assert (got["description"], got["source"], got["published_at"]) == (
        "D",
        "P",
        dt.datetime(2024, 1, 15, 9, 30),
    )


def nested(url=None, click=None, **content):
    if url is not None:
        content["canonicalUrl"] = {"url": url}
    if click is not None:
        content["clickThroughUrl"] = {"url": click}
    return {"content": content}


def test_nested_provider(spark):
    body = [
        nested("u0", title="T", summary="S", description="D", pubDate="2024-01-15T09:30:00Z",
               provider={"displayName": "P"}),
        nested("", "u1", title="T", summary="", description="D", pubDate="junk", provider="text"),
        nested("", ""),
        {"content": "text"},
        {},
        {"content": {"canonicalUrl": "text", "clickThroughUrl": {"url": "u5"}}},
    ]
    got = articles(spark, [(YFINANCE, "A", 0, 200, body)])
    assert [(r["pos"], r["url"], r["description"], r["source"]) for r in got] == [
        (0, "u0", "S", "P"),
        (1, "u1", "D", None),
        (5, "u5", None, None),
    ]


def test_window_is_closed_keeps_unknown_times_and_spares_other_providers(spark):
    end = dt.datetime(2024, 1, 15, 12)
    start = end - dt.timedelta(hours=2)
    tick = dt.timedelta(microseconds=1)
    moments = [start, end, start - tick, end + tick]
    body = [nested(f"u{i}", pubDate=t.isoformat() + "Z") for i, t in enumerate(moments)]
    body.append(nested("u4", pubDate="junk"))
    old = {"feed": [news("old", time_published="20200101T000000")]}
    window = (F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    got = articles(spark, [(YFINANCE, "A", 1, 200, body), (ALPHA_VANTAGE, "A", 0, 200, old)], window)
    assert [r["url"] for r in got] == ["old", "u0", "u1", "u4"]


def test_limit_responses(spark):
    cases = [
        (FINNHUB, 429, "{}", True),
        (FINNHUB, 401, "[]", True),
        (FINNHUB, 403, "{}", True),
        (FINNHUB, 429, "busy", False),
        (FINNHUB, 200, '{"Note": "Thank you for using Alpha Vantage!"}', True),
        (FINNHUB, 200, '{"a": "RATE_LIMIT"}', True),
        (FINNHUB, 200, '[{"headline": "Import quota raised"}]', True),
        (FINNHUB, 200, '[{"headline": "Rates"}]', False),
        (FINNHUB, 500, "{}", False),
        (FINNHUB, 200, None, False),
        (YFINANCE, 429, "{}", False),
    ]
    rows = landed(spark, [(p, "A", i, s, b) for i, (p, s, b, _) in enumerate(cases)])
    hit = payloads.is_limit_response(F.col("status"), F.col("body"), F.col("provider"))
    got = [r["hit"] for r in rows.select("seq", hit.alias("hit")).orderBy("seq").collect()]
    assert got == [c[3] for c in cases]


def test_phrase_check_can_be_left_out(spark):
    rows = landed(spark, [(FINNHUB, "A", 0, 200, '{"a": "quota"}'), (FINNHUB, "A", 1, 429, "{}")])
    hit = payloads.is_limit_response(F.col("status"), F.col("body"), check_phrases=False)
    assert [r[0] for r in rows.orderBy("seq").select(hit).collect()] == [False, True]


def test_breaker_drops_the_limit_response_and_all_later_ones(spark):
    plan = [(FINNHUB, n, 429 if n in (3, 6) else 200) for n in range(8)]
    plan += [(MARKETAUX, n, 200) for n in range(4)] + [(YFINANCE, n, 429) for n in range(2)]
    rows = landed(spark, [(p, "A", n, s, "{}") for p, n, s in plan])
    hit = payloads.is_limit_response(F.col("status"), F.col("body"), F.col("provider"))
    kept = payloads.drop_after_limit(rows, payloads.limit_cutoffs(rows, hit))
    got = sorted((r["provider"], r["seq"]) for r in kept.collect())
    assert got == sorted(
        [(FINNHUB, n) for n in range(3)] + [(MARKETAUX, n) for n in range(4)] + [(YFINANCE, n) for n in range(2)]
    )


def test_breaker_counts_runs_separately(spark):
    rows = landed(spark, [(FINNHUB, "A", 0, 429, "{}"), (FINNHUB, "A", 1, 200, "{}")])
    other = rows.withColumn("run_id", F.lit("next")).withColumn("status", F.lit(200))
    both = rows.unionByName(other)
    hit = payloads.is_limit_response(F.col("status"), F.col("body"), F.col("provider"))
    kept = payloads.drop_after_limit(both, payloads.limit_cutoffs(both, hit))
    assert sorted((r["run_id"], r["seq"]) for r in kept.collect()) == [("next", 0), ("next", 1)]


def test_reading_landed_files(spark, tmp_path):
    rows = landed(spark, [(FINNHUB, "A", 0, 200, [{"headline": "T", "url": "u"}])])
    rows.write.json(str(tmp_path / "in"))
    back = payloads.read_payloads(spark, str(tmp_path / "in"))
    assert back.schema.names == schemas.LANDED_PAYLOAD.names
    assert payloads.normalize(back).count() == 1


def test_bodies_of_unlimited_providers_are_not_searched(spark):
    rows = landed(spark, [(YFINANCE, "A", 0, 200, "{}"), (YFINANCE, "A", 1, 429, "{}"), (FINNHUB, "A", 2, 200, '"quota"'),
                          (FINNHUB, "A", 3, 200, "{}"), (None, "A", 4, 429, "{}")])
    provider = F.col("provider")
    body = F.when(provider == YFINANCE, F.raise_error(F.lit("searched"))).otherwise(F.col("body"))
    hit = payloads.is_limit_response(F.col("status"), body, provider)
    assert payloads.limit_cutoffs(rows, hit).collect() == [("run", FINNHUB, 2)]
