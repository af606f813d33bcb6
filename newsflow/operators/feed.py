"""The newest-news feed: paging, projection and display defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.functions.clean import first_present, null_if_blank
from newsflow.functions.times import age_label
from newsflow.functions.urls import percent_encode
from newsflow.session import scratch, settled

MAX_PAGE_SIZE = 100
LATEST = 6
# Fixed value: where the feed's image links point.
IMAGE_PROXY = "/api/news-image?url="

# A page is sought until the span that holds it has at most so many rows to sort.
SORTED_ROWS = 10_000
# So many groups are looked at before a page is sought by rank.
FIRST_GROUPS = 1_000
SEEK_UNITS = ("DAY", "HOUR", "MINUTE", "SECOND")
SEEK_PREFIXES = (12, 24, 48, 96)


def page_bounds(page: object = 1, limit: object = MAX_PAGE_SIZE) -> tuple[int, int]:
    """Page number and size, clamped; ``ValueError`` when either is not an integer."""
    try:
        number, size = int(page), int(limit)
    except (TypeError, ValueError):
        raise ValueError("page and limit must be integers") from None
    return max(number, 1), min(max(size, 1), MAX_PAGE_SIZE)


def _holding(
    articles: DataFrame, keys: list[Column], order: list[Column], offset: int, size: int
) -> tuple[list, int, int]:
    """Groups in page order that overlap the page, the rows before them and in them.

    The first ``FIRST_GROUPS`` groups usually hold the page. If not, the page is
    sought by rank: groups are dealt by ranges of their order and written, rows are
    counted per range, and only groups of ranges that overlap the page are summed up.
    So the driver sees ``FIRST_GROUPS`` groups, one row per range, and the groups of
    the page, each of which has a row on it.
    """
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    counts = articles.groupBy(*named).count()
    first = counts.orderBy(*order).limit(FIRST_GROUPS).collect()
    if len(first) < FIRST_GROUPS or sum(row["count"] for row in first) >= offset + size:
        return _overlapping([(tuple(row)[:-1], row["count"]) for row in first], 0, offset, size)
    with scratch(articles.sparkSession):
        ranged = counts.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
        ranged = settled(ranged, "page-groups")
        ranges = ranged.groupBy("_range").agg(F.sum("count").alias("rows")).orderBy("_range").collect()
        held, start, seen = [], 0, 0
        for row in ranges:
            if seen < offset + size and seen + row["rows"] > offset:
                start = start if held else seen
                held.append(row["_range"])
            seen += row["rows"]
        before = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        earlier = {row["_range"]: row["rows"] for row in ranges}
        bases, base = [], start
        for number in held:
            bases += [F.lit(number), F.lit(base)]
            base += earlier[number]
        if not held:
            return [], seen, 0
        reached = F.element_at(F.create_map(*bases), F.col("_range")) + F.sum("count").over(before)
        summed = ranged.filter(F.col("_range").isin(held)).withColumn("_reached", reached)
        found = summed.filter((F.col("_reached") > offset) & (F.col("_reached") - F.col("count") < offset + size))
        rows = found.orderBy("_reached").collect()
        groups = [(tuple(row)[: len(keys)], row["count"]) for row in rows]
        return _overlapping(groups, rows[0]["_reached"] - rows[0]["count"] if rows else seen, offset, size)


def _overlapping(groups: list, start: int, offset: int, size: int) -> tuple[list, int, int]:
    """Of (group, rows) in order, those that overlap the page; ``start`` rows come before them."""
    held, before, inside, seen = [], start, 0, start
    for group, rows in groups:
        if seen >= offset + size:
            break
        if seen + rows > offset:
            held.append(group)
            inside += rows
        else:
            before += rows
        seen += rows
    return held, before, inside


def _among(keys: list[Column], held: list) -> Column:
    """True in the held groups: at most one more than a page has rows."""
    keep = F.lit(False)
    for group in held:
        same = F.lit(True)
        for key, value in zip(keys, group):
            same = same & key.eqNullSafe(F.lit(value))
        keep = keep | same
    return keep


def _seek(
    articles: DataFrame, time: str, tie: str, day: str | None, offset: int, size: int, sorted_rows: int
) -> tuple[DataFrame, int]:
    """Narrow the table to groups that hold the page, and the rows to skip in them.

    Counts rows per day, hour, minute, second and instant, then per beginning of the
    tie column, in what has been found so far, until little is left to sort. So the
    group of rows without a time, which comes first, is narrowed like any other.
    """
    levels: list[list[Column]] = [[F.col(day)]] if day else []
    levels += [[F.date_trunc(unit, time)] for unit in SEEK_UNITS] + [[F.col(time)]]
    tied = F.col(tie).cast("string")
    ascending = dict(articles.dtypes)[tie] == "string"
    prefixes = [F.substring(tied, 1, n) for n in SEEK_PREFIXES] if ascending else []
    levels += [[F.col(time), part] for part in (*prefixes, F.col(tie))]
    for keys in levels:
        order = [F.desc_nulls_first("k0"), *([F.asc("k1")] if len(keys) > 1 else [])]
        held, before, inside = _holding(articles, keys, order, offset, size)
        articles, offset = articles.filter(_among(keys, held)), max(offset - before, 0)
        if inside <= sorted_rows:
            break
    return articles, offset


def news_page(
    articles: DataFrame,
    page: object = 1,
    limit: object = MAX_PAGE_SIZE,
    time: str = "published_at",
    tie: str = "url",
    day: str | None = None,
    sorted_rows: int = SORTED_ROWS,
) -> DataFrame:
    """One page of the newest articles; rows without a time come first.

    ``day`` names the column the table is partitioned by, if it is; then only the
    days that hold the page are read, and counting them reads no column. Every page
    is found in the same way, see :func:`_seek`; only the small span that holds it is
    sorted, as a top-k.
    """
    number, size = page_bounds(page, limit)
    offset = (number - 1) * size
    articles, offset = _seek(articles, time, tie, day, offset, size, sorted_rows)
    newest_first = articles.orderBy(F.desc_nulls_first(time), F.asc(tie))
    return newest_first.offset(offset).limit(size)


def page_summary(rows: DataFrame, page: object = 1, limit: object = MAX_PAGE_SIZE) -> DataFrame:
    """Page number, size, row count and whether another page may follow.

    A full page always announces another one, also when it is the last.
    """
    number, size = page_bounds(page, limit)
    return rows.agg(F.count("*").alias("count")).select(
        F.lit(number).alias("page"),
        F.lit(size).alias("limit"),
        "count",
        (F.col("count") == size).alias("has_next"),
    )


def latest(articles: DataFrame, time: str = "published_at", tie: str = "url") -> DataFrame:
    """The few newest articles of the dashboard."""
    return news_page(articles, 1, LATEST, time, tie)


def feed_projection(articles: DataFrame) -> DataFrame:
    """Feed columns plus the link to the image proxy, NULL without an image."""
    image = null_if_blank(F.col("image_url"))
    return articles.select(
        "symbol",
        "title",
        "description",
        "source",
        "url",
        "published_at",
        "source_api",
        "image_url",
        F.concat(F.lit(IMAGE_PROXY), percent_encode(image)).alias("image_proxy_url"),
    )


def feed_display(articles: DataFrame, as_of: Column) -> DataFrame:
    """What the feed shows for each article: label, headline, teaser and symbol."""
    source = first_present(F.col("source"), F.col("source_api"), F.lit("Financial News"))
    return articles.select(
        "url",
        F.concat_ws(" • ", age_label(F.col("published_at"), as_of), source).alias("byline"),
        first_present(F.col("title"), F.lit("Untitled financial news")).alias("headline"),
        F.coalesce("description", F.lit("")).alias("teaser"),
        F.coalesce("symbol", F.lit("")).alias("symbol"),
        first_present(F.col("source"), F.lit("Financial news")).alias("image_alt"),
    )
