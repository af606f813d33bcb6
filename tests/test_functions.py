"""Column functions on edge values, against the standard library where it has the function."""

from __future__ import annotations

import datetime as dt
import ipaddress
import warnings
from urllib.parse import quote, urljoin

import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsflow.functions import clean, html, text, times, urls


def apply(spark, values, column, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    out = rows.select("i", column(F.col("v")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in out]


def test_missing_value_tokens(spark):
    got = apply(spark, ["NA", "nan", "", "None", "<NA>", "Nan", "x", None], clean.null_if_na)
    assert got == [None, None, None, None, None, "Nan", "x", None]


def test_numbers_from_text(spark):
    raw = ["12.7", "-3.9", "1e3", "abc", "inf", None, "", "nan", "1d", "2F", "0x1p3", " 7 ", "."]
    assert apply(spark, raw, clean.to_count) == [12, -3, 1000, 0, 0, 0, 0, 0, 0, 0, 0, 7, 0]
    scores = apply(spark, raw, clean.to_double)
    assert scores[:4] == [12.7, -3.9, 1000.0, None]
    assert scores[4] == float("inf")
    assert scores[5:] == [None, None, None, None, None, None, 7.0, None]


def test_blank_is_missing(spark):
    rows = spark.createDataFrame([("", "b"), (None, ""), ("a", "b")], "a string, b string")
    got = [r[0] for r in rows.select(clean.first_present(F.col("a"), F.col("b"))).collect()]
    assert got == ["b", None, "a"]


def as_text(column):
    return lambda c: F.date_format(column(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def test_compact_time(spark):
    raw = ["20240115T093000", "20241315T093000", "2024-01-15", "", None, "20240115T0930"]
    got = apply(spark, raw, as_text(times.compact_utc))
    assert got == ["2024-01-15 09:30:00.000000", None, None, None, None, None]


def test_epoch_time(spark):
    raw = [1705311000.0, 0.0, None, 1e15, -1e15, -86400.0, 1705311000.5]
    got = apply(spark, raw, as_text(times.epoch_utc), "double")
    assert got == [
        "2024-01-15 09:30:00.000000",
        None,
        None,
        None,
        None,
        "1969-12-31 00:00:00.000000",
        "2024-01-15 09:30:00.500000",
    ]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_iso_time_does_not_depend_on_the_session_zone(spark, zone):
    raw = [
        "2024-01-15T09:30:00Z",
        "2024-01-15T09:30:00+02:00",
        "2024-01-15 09:30",
        "2024-01-15",
        "2024-01-15T09:30:00.123456",
        "2024",
        "junk",
        "2024-02-30",
        "",
        None,
    ]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = apply(spark, raw, lambda c: F.unix_micros(times.iso_utc(c)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def micros(*parts):
        moment = dt.datetime(*parts, tzinfo=dt.timezone.utc)
        return (moment - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)

    assert got == [
        micros(2024, 1, 15, 9, 30),
        micros(2024, 1, 15, 7, 30),
        micros(2024, 1, 15, 9, 30),
        micros(2024, 1, 15),
        micros(2024, 1, 15, 9, 30, 0, 123456),
        None,
        None,
        None,
        None,
        None,
    ]


def test_loose_time(spark):
    raw = [
        "Mon, 15 Jan 2024 09:30:00 GMT",
        "15 Jan 2024 09:30:00 +0200",
        "Jan 15, 2024",
        "January 15, 2024",
        "1/15/2024 9:30",
        "2024/1/15",
        "20240115",
        "2024-01-15 09:30:00+00:00",
        "soon",
        "15/40/2024",
    ]
    got = apply(spark, raw, as_text(times.loose_utc))
    day = "2024-01-15 "
    assert got == [
        day + "09:30:00.000000",
        day + "07:30:00.000000",
        day + "00:00:00.000000",
        day + "00:00:00.000000",
        day + "09:30:00.000000",
        day + "00:00:00.000000",
        day + "00:00:00.000000",
        day + "09:30:00.000000",
        None,
        None,
    ]


SPELLINGS = [
    "Jan 15, 2024 9:30 AM", "15-Jan-2024", "2024-01-15 9:30", "2024-1-5", "Jan 15 2024", "1/15/2024 9:30 PM",
    "2024.01.15", "Mon Jan 15 09:30:00 2024", "2024-01-15 09:30:00 EST", "15 January 2024",
    "January 15, 2024 9:30 PM", "13/01/2024", "2024-15-01", "15.01.2024", "Jan 2024", "2024-01", "2024",
    "2024-01-15T9:30:00+0530", "Jan 15th, 2024", "Sept 5, 2024", "Monday, January 15, 2024 at 9:30 AM",
    "12:30 AM Jan 15 2024", "12 PM 5 May 2024", "2024/1/5 9 PM", "13:30 PM Jan 15 2024",
    "2024-01-15 09:30:00.5 UTC", "Mon, 15 Jan 2024 09:30:00 -0500", "2024-01-15 24:00", "2024 Jan 15",
    "Jan-15-2024", "2024-Jan-15", "15/Jan/2024 10:00", "2024-01-15 09:30:00 -05:00", "20240115093000",
    "JAN 15, 2024", "2024-02-30", "Feb 30 2024", "Jan Feb 2024", "99/99/2024", "garbage", "may 5 2024",
    "  Jan 15, 2024  ", "29 Feb 2023", "2024-01-15 9:30:15.25 PM +02",
]


def test_spellings_parse_as_a_data_library_does(spark):
    """Every spelling is read as the data library reads it, or as unreadable like there."""
    got = apply(spark, SPELLINGS, as_text(times.loose_utc))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        want = [pd.to_datetime(text, errors="coerce", utc=True) for text in SPELLINGS]
    assert got == [None if t is pd.NaT else t.strftime("%Y-%m-%d %H:%M:%S.%f") for t in want]


def test_ambiguous_dates_are_null(spark):
    """No year, a year of two digits, two clocks, or a word that means nothing here."""
    raw = ["9:30 AM", "1/15/24", "10:00 11:00 Jan 1 2024", "2024-01-15 noon", "Jan 15", "1 2 3 2024", "", None]
    assert apply(spark, raw, as_text(times.loose_utc)) == [None] * len(raw)


def test_age_label_limits(spark):
    now = dt.datetime(2024, 1, 15, 12)
    ages = [0, 59, 60, 3599, 3600, 86399, 86400, 200000, -500]
    moments = [now - dt.timedelta(seconds=s) for s in ages] + [None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(moments)], "i int, t timestamp_ntz")
    label = times.age_label(F.col("t"), F.lit(now).cast("timestamp_ntz"))
    got = [r[0] for r in rows.orderBy("i").select(label).collect()]
    assert got == [
        "Just now",
        "Just now",
        "1 min ago",
        "59 min ago",
        "1 hr ago",
        "23 hr ago",
        "1 days ago",
        "2 days ago",
        "Just now",
        "Time unavailable",
    ]


def test_percent_encoding(spark):
    raw = ["a b~*é%+/x?&=", "https://h.com/ü?q=1#t", "%7E", "", "_-.~", "日本"]
    assert apply(spark, raw, urls.percent_encode) == [quote(v, safe="") for v in raw]


BASES = ["https://h.com/p/q/r.html?x=1#t", "https://h.com", "http://h.com/", "https://h.com/a//b/c"]
REFS = [
    "", "a.png", "/a.png", "//cdn.x/y//z.png", "../up.png", "../../../x.png", "./b/", "?q=1", "#f",
    "https://o.com/a?", "HTTPS://o.com/a/../b", "http://o.com", "data:image/png;base64,AA",
    "/a//b/./c/..", "a/..", "..", ".", "http:rel.png", "/", "a\nb.png", "x//y",
]


@pytest.mark.parametrize("base", BASES)
def test_resolving_equals_the_standard_library(spark, base):
    got = apply(spark, REFS, lambda c: urls.resolve_url(F.lit(base), c))
    assert dict(zip(REFS, got)) == {r: urljoin(base, r) for r in REFS}


def test_admissible_hosts(spark):
    addresses = [f"{a}.{b}.7.1" for a in range(256) for b in (0, 16, 18, 31, 32, 51, 64, 168, 254)]
    addresses += ["203.0.113.9", "198.51.100.1", "192.0.0.8", "192.0.2.4", "203.0.112.1", "1.2.3.4"]
    got = apply(spark, [f"https://{a}/x.png" for a in addresses], urls.admissible_image_url)

    def closed(address):
        ip = ipaddress.ip_address(address)
        return any(
            (ip.is_private, ip.is_loopback, ip.is_link_local, ip.is_reserved, ip.is_multicast)
        )

    assert got == [not closed(a) for a in addresses]


def test_admissible_urls(spark):
    cases = {
        "https://Example.com./a.png": True,
        "https://10.example.com/a.png": True,
        "http://example.com/a.png": False,
        "https://localhost/a": False,
        "https://x.localhost/a": False,
        "https://user:pw@127.0.0.1:8443/": False,
        "https://[::1]/": False,
        "https://2130706433/": False,
        "https://0x7f.1/": False,
        "https:///a.png": False,
        "junk": False,
        "": False,
        None: False,
        "https://a.com/with space.png": True,
    }
    assert apply(spark, list(cases), urls.admissible_image_url) == list(cases.values())


PAGE = "https://h.com/p/q.html?x=1"
H = "https://h.com"
# Page text and the image that must be found.
PAGES = [
    ("<meta property='og:image' content='a.png'>", f"{H}/p/a.png"),
    ("<META PROPERTY=og:image CONTENT=/a.png>", f"{H}/a.png"),
    (
        "<!-- <meta property=og:image content=/x.png> --><meta name=twitter:image content='//c.d/e?a=1&amp;b=2'>",
        "https://c.d/e?a=1&b=2",
    ),
    (
        "<script>'<meta property=og:image content=/x.png>'</script><meta property=og:image:url content=HTTPS://z/y>",
        "https://z/y",
    ),
    ("<meta content='q.png' name='og:image'/>", f"{H}/p/q.png"),
    ("<meta content='  ' name='og:image'/>", PAGE),
    ("<meta content='' name='og:image'/><meta name=og:image content=2.png>", f"{H}/p/2.png"),
    ("<meta property='' name='og:image' content=3.png>", f"{H}/p/3.png"),
    ("<meta property='x' name='og:image' content=3.png>", None),
    (
        "<meta content='property=og:image' property=description><meta property=og:image content='data:x'>"
        "<meta property=og:image content='ok.png'>",
        f"{H}/p/ok.png",
    ),
    ("<meta content='1.png' content='2.png' property='og:image'>", f"{H}/p/2.png"),
    ("<metadata property=og:image content=x.png>", None),
    ("<meta property=og:image content=x&#46;png>", f"{H}/p/x.png"),
    ("<meta property=og:image content=&#x78;&quot;.png>", f'{H}/p/x".png'),
    ("<!-- open <meta property=og:image content=x.png>", None),
    ("<style>open <meta property=og:image content=x.png>", None),
    ("<meta property=og:image content>", None),
    ("<meta property = 'og:image' content = \"a\nb.png\">", f"{H}/p/ab.png"),
    ("no tag", None),
    ("<meta property=og:image content='it>s.png'>", f"{H}/p/it>s.png"),
    ("<meta\nproperty='og:image'\ncontent='new.png'\n>", f"{H}/p/new.png"),
    ("<meta property=og:image content=a.png/>", f"{H}/p/a.png/"),
    ("<meta property='og:image' content='&amp;#39;.png'>", f"{H}/p/&#39;.png"),
    ("<meta property='og:image' content='" + "x" * 200_000 + "'>", f"{H}/p/" + "x" * 200_000),
    ("<meta " + "a=b " * 50_000 + " property='og:image' content='long.png'>", f"{H}/p/long.png"),
    ("x" * 1_600_000 + "<meta property='og:image' content='late.png'>", f"{H}/p/late.png"),
    ("<meta property=og:image content='mailto:x'><meta name=twitter:image:src content=..>", f"{H}/"),
    (None, None),
]


def test_image_extraction(spark):
    got = apply(spark, [p for p, _ in PAGES], lambda c: html.social_image_url(c, F.lit(PAGE)))
    assert got == [image for _, image in PAGES]


def test_short_title(spark):
    assert apply(spark, ["x" * 100, "", None, "a"], text.short_title) == [
        "x" * 90,
        "Untitled",
        "Untitled",
        "a",
    ]
