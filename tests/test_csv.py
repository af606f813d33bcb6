"""Per-symbol CSV files: quoting, missing values, layouts, unreadable files, counts."""

from __future__ import annotations

import csv
import io
import os

import pytest
from pyspark.sql import functions as F

from newsflow import schemas
from newsflow.plans import csv_load
from newsflow.session import shared_dir
from newsflow.sources import csv_files
from newsflow.sources.csv_files import read_symbol_csv

HEADER = "url,title,description,source,published_at,source_api\n"


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode() if isinstance(text, str) else text)


def read(spark, folder, **how):
    return read_symbol_csv(spark, str(folder), schemas.NEWS_CSV, **how)


def test_quoting_missing_values_and_symbols(spark, tmp_path):
    write(
        tmp_path,
        "NVDA.csv",
        HEADER
        + 'u1,"He said ""buy"", twice","line one\nline two",NA,2024-01-15,api\n'
        + "u2,nan,,None,,\n"
        + '"",T,D,S,,\n',
    )
    write(tmp_path, "AMD.csv", HEADER + "u9, padded ,d,s,t,a\n")
    got = {r["url"]: r for r in read(spark, tmp_path).rows.collect()}
    first = got["u1"]
    assert first["symbol"] == "NVDA"
    assert first["title"] == 'He said "buy", twice'
    assert first["description"] == "line one\nline two"
    assert first["source"] is None
    assert [got["u2"][c] for c in schemas.NEWS_CSV[1:]] == [None] * 5
    assert got[None]["title"] == "T"
    assert got["u9"]["symbol"] == "AMD" and got["u9"]["title"] == " padded "


def test_columns_are_matched_by_name(spark, tmp_path):
    write(tmp_path, "NVDA.csv", HEADER + "u1,T1,D1,S1,t,a\n")
    write(tmp_path, "AMD.csv", "title,url,source\nT2,u2,S2\n")
    write(tmp_path, "TXN.csv", "extra,title,url\nx,T3,u3\n")
    got = {r["url"]: (r["symbol"], r["title"], r["source"]) for r in read(spark, tmp_path).rows.collect()}
    assert got == {"u1": ("NVDA", "T1", "S1"), "u2": ("AMD", "T2", "S2"), "u3": ("TXN", "T3", None)}
    pruned = read(spark, tmp_path).rows.select("title")
    assert sorted(r[0] for r in pruned.collect()) == ["T1", "T2", "T3"]


def test_folders_of_part_files(spark, tmp_path):
    write(tmp_path, "NVDA.csv/part-0.csv", HEADER + "u1,T,D,S,t,a\n")
    write(tmp_path, "NVDA.csv/part-1.csv", HEADER + "u2,T,D,S,t,a\n")
    write(tmp_path, "symbol=AMD/part-0.csv", HEADER + "u3,T,D,S,t,a\n")
    rows = read(spark, tmp_path).rows
    assert sorted((r["url"], r["symbol"]) for r in rows.collect()) == [
        ("u1", "NVDA"),
        ("u2", "NVDA"),
        ("u3", "AMD"),
    ]


def test_a_part_file_with_another_layout_is_read_by_name(spark, tmp_path):
    write(tmp_path, "NVDA.csv/part-0.csv", HEADER + "u1,T,D,S,t,a\n")
    write(tmp_path, "NVDA.csv/part-1.csv", "title,url,description,source,published_at,source_api\nT,u2,D,S,t,a\n")
    assert sorted(r["url"] for r in read(spark, tmp_path).rows.collect()) == ["u1", "u2"]


def test_index_column_padded_names_and_passed_over_files(spark, tmp_path):
    write(tmp_path, "NVDA.csv", ",url, title ,url\n0,u1,T1,x\n1,u2,T2,x\n")
    write(tmp_path, "AMD.csv.gz", b"\x1f\x8b")
    write(tmp_path, "XYZ.csv.gz", b"\x1f\x8b")
    write(tmp_path, "_SUCCESS", "")
    scan = read(spark, tmp_path)
    assert sorted((r["url"], r["title"]) for r in scan.rows.collect()) == [("u1", "T1"), ("u2", "T2")]
    assert [f.rsplit("/", 1)[1] for f in scan.passed_over] == ["AMD.csv.gz"] and scan.unreadable == ()


def test_storage_errors_are_raised(spark, tmp_path, monkeypatch):
    write(tmp_path, "NVDA.csv", HEADER + "u1,T,D,S,t,a\n")
    real = csv_files._list_files
    monkeypatch.setattr(csv_files, "_list_files", lambda *a: [*real(*a), f"file:{tmp_path}/AMD.csv"])
    with pytest.raises(Exception, match="AMD"):
        read(spark, tmp_path)


def test_unreadable_files_are_reported_and_skipped(spark, tmp_path):
    write(tmp_path, "NVDA.csv", HEADER + "u1,T,D,S,t,a\n")
    write(tmp_path, "AMD.csv", "")
    scan = read(spark, tmp_path)
    assert [f.rsplit("/", 1)[1] for f in scan.unreadable] == ["AMD.csv"]
    assert scan.rows.count() == 1


def test_no_files_and_missing_url_column(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert read(spark, tmp_path / "empty").rows.count() == 0
    write(tmp_path / "bad", "NVDA.csv", "title\nT\n")
    write(tmp_path / "bad", "AMD.csv", HEADER + "u,T,D,S,t,a\n")
    scan = read(spark, tmp_path / "bad")
    assert [f.rsplit("/", 1)[1] for f in scan.unreadable] == ["NVDA.csv"]
    assert [r["url"] for r in scan.rows.collect()] == ["u"]


# Body of a file, and whether a CSV library reads it.
BODIES = {
    "too many cells": ("u1,T,D,S,t,a\nu2,T,with, comma,S,t,a\n", False),
    "empty cell too many": ("u1,T,D,S,t,a,\nu2,T,D,S,t,a,\nu3,T,D,S,t,a,,\n", False),
    "open quote in the middle": ('u1,T,D,S,t,a\nu2,T,"open,S,t,a\nu3,T,D,S,t,a\n', False),
    "open quote in the last cell": ('u1,T,D,S,t,a\nu2,T,D,S,t,"open\nu3,T,D,S,t,a\n', False),
    "open quote in the last cell of the last row": ('u1,T,D,S,t,a\nu2,T,D,S,t,"open\n', False),
    "too few cells": ("u1,T\nu2,T,D,S,t,a\n", True),
    "line break in the last cell": ('u1,T,D,S,t,a\nu2,T,D,S,t,"two\nlines"\n', True),
    "line break in the last cell, more rows": ('u1,T,D,S,t,"two\nlines\n"\nu2,T,D,S,t,a\n', True),
    "commas and doubled quotes": ('u1,"T, ""x"", y","D\nE",S,t,a\nu2,T\n', True),
    "a quote inside a cell": ('u1,5" disc,6" disc,S,t,a\nu2,5" disc,6" disc\n', True),
}


@pytest.mark.parametrize("name", BODIES)
def test_malformed_files(spark, tmp_path, name):
    body, readable = BODIES[name]
    write(tmp_path, "NVDA.csv", HEADER + body)
    write(tmp_path, "AMD.csv", HEADER + "good,T,D,S,t,a\n")
    scan = read(spark, tmp_path)
    assert [f.rsplit("/", 1)[1] for f in scan.unreadable] == ([] if readable else ["NVDA.csv"])
    got = scan.rows.filter("symbol = 'NVDA'").count()
    if not readable:
        assert got == 0
    elif name != "a quote inside a cell":
        assert got == len(list(csv.reader(io.StringIO(body))))
    else:
        assert got == 2
    assert [r["url"] for r in scan.rows.filter("symbol = 'AMD'").collect()] == ["good"]


def test_load_leaves_no_tables_and_stores_each_url_once(spark, tmp_path):
    """A repeated stock symbol, an unknown symbol and a broken file: report and table agree."""
    write(tmp_path / "csv", "NVDA.csv", HEADER + "u1,T,D,S,2024-01-15,a\nu2,T,D,S,Jan 15 2024 9:30 PM,a\n")
    write(tmp_path / "csv", "AMD.csv", HEADER + "u1,T,D,S,t,a\nu3,T,D,S,t,a\n")
    write(tmp_path / "csv", "XYZ.csv", HEADER + "u3,T,D,S,t,a\nu4,T,D,S,t,a\n")
    write(tmp_path / "csv", "TSLA.csv", HEADER + "u5,T,D,S,t,a,b\n")
    stocks = spark.createDataFrame([(1, "NVDA"), (9, "NVDA"), (2, "AMD"), (3, "TSLA")], "id bigint, symbol string")
    tables = csv_load.Tables(*[str(tmp_path / n) for n in ("news", "sentiment", "daily")])
    before = set(os.listdir(shared_dir(spark)))
    report = csv_load.load_news(spark, str(tmp_path / "csv"), tables, stocks, ["XYZ", "NVDA", "AMD", "TSLA"])
    assert set(os.listdir(shared_dir(spark))) == before
    got = {r["symbol"]: (r["inserted"], r["skipped"], r["errors"]) for r in report.collect()}
    assert got["NVDA"] == (2, 0, 0) and got["AMD"] == (1, 1, 0)
    # u3 in XYZ is skipped for AMD's, u4 has no stock at all, and one file is broken.
    assert got["XYZ"] == (0, 1, 1) and got[None] == (3, 2, 2)
    stored = spark.read.parquet(tables.news_articles).select(
        "url", "stock_id", F.col("published_at").cast("string").alias("at")).collect()
    assert sorted(map(tuple, stored), key=str) == [
        ("u1", 9, "2024-01-15 00:00:00"), ("u2", 9, "2024-01-15 21:30:00"), ("u3", 2, None)]
    again = csv_load.load_news(spark, str(tmp_path / "csv"), tables, stocks, ["XYZ", "NVDA", "AMD", "TSLA"])
    assert again.filter("symbol IS NULL").first()["inserted"] == 0


def test_suffix_and_symbol_rank(spark, tmp_path):
    write(tmp_path, "NVDA_sentiment.csv", "url,sentiment_label\nu1,positive\n")
    write(tmp_path, "XYZ_sentiment.csv", "url,sentiment_label\nu2,positive\n")
    write(tmp_path, "NVDA_daily_sentiment.csv", "published_date,article_count\n2024-01-15,1\n")
    symbols = ["AMD", "NVDA"]
    sentiment = read_symbol_csv(spark, str(tmp_path), schemas.SENTIMENT_CSV, symbols, "_sentiment")
    got = [(r["symbol"], r["symbol_rank"], r["url"]) for r in sentiment.rows.collect()]
    assert got == [("NVDA", 1, "u1")]
    daily = read_symbol_csv(spark, str(tmp_path), schemas.DAILY_CSV, symbols, "_daily_sentiment")
    assert [(r["symbol"], r["article_count"]) for r in daily.rows.collect()] == [("NVDA", "1")]


def test_rows_keep_file_order(spark, tmp_path):
    body = "".join(f"u{i},T,D,S,t,a\n" for i in range(5000))
    write(tmp_path, "NVDA.csv", HEADER + body)
    rows = read(spark, tmp_path).rows.orderBy("row_pos")
    assert [r["url"] for r in rows.collect()] == [f"u{i}" for i in range(5000)]


def test_load_counts(spark):
    """Brute-force replay of the load, symbol by symbol."""
    rows = [
        ("A", 0, "u1"), ("A", 0, "u1"), ("A", 0, None), ("A", 0, "u2"), ("A", 0, "s1"), ("A", 0, "s1"),
        ("B", 1, "u1"), ("B", 1, "u3"), ("B", 1, "u3"), ("B", 1, "s1"),
        ("C", 2, "u1"), ("C", 2, "u4"), ("C", 2, ""),
    ]
    stored = {"s1", "other"}
    want = {}
    done = set(stored)
    for symbol in "ABC":
        mine = [u for s, _, u in rows if s == symbol]
        urls = list(dict.fromkeys(u for u in mine if u))
        inserted = [u for u in urls if u not in done]
        done.update(inserted)
        want[symbol] = (len(mine), len(inserted), len(urls) - len(inserted))
    df = spark.createDataFrame(
        [(s, r, u, "f", i) for i, (s, r, u) in enumerate(rows)],
        "symbol string, symbol_rank int, url string, file_path string, row_pos int",
    )
    known = spark.createDataFrame([(u,) for u in stored], "url string")
    counts = csv_load.outcome_counts(df, csv_load.news_outcome(df.repartition(4), known))
    got = {r["symbol"]: (r["rows"], r["inserted"], r["skipped"]) for r in counts.collect()}
    total = got.pop(None)
    assert got == want
    assert total == tuple(map(sum, zip(*want.values())))


def test_time_of_csv_rows_is_parsed(spark):
    df = spark.createDataFrame(
        [("NVDA", "u", "T", None, "S", "2024-01-15 09:30:00+00:00", "api")],
        "symbol string, url string, title string, description string, source string,"
        " published_at string, source_api string",
    )
    ids = spark.createDataFrame([(1, "NVDA")], "id bigint, symbol string")
    record = csv_load.news_records(df, ids).withColumn("published_at", F.col("published_at").cast("string")).first()
    assert (record["stock_id"], record["published_at"], record["text"]) == (1, "2024-01-15 09:30:00", None)
