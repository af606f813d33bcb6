"""Landed provider responses: limit detection, breaker, parsing and normalising.

One scan serves all providers: the response body is parsed with the item type
that covers every provider, the items are exploded once, and per-provider rules
are chosen row by row. Nothing here shuffles except the small breaker join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow import schemas
from newsflow.functions.clean import first_present, null_if_blank
from newsflow.functions.text import mentions
from newsflow.functions.times import compact_utc, epoch_utc, iso_utc, loose_utc
from newsflow.operators.filters import in_window
from newsflow.session import settled
from newsflow.stocks import (
    ALPHA_VANTAGE,
    FINNHUB,
    MARKETAUX,
    PROVIDERS,
    UNLIMITED_PROVIDERS,
    WINDOWED_PROVIDERS,
    YFINANCE,
)

# Status codes and phrases by which a provider signals its limit.
LIMIT_STATUS = (401, 403, 429)
LIMIT_PHRASES = (
    "rate limit",
    "rate_limit",
    "quota",
    "limit reached",
    "api call frequency",
    "thank you for using alpha vantage",
    "premium endpoint",
)


def read_payloads(spark: SparkSession, path: str | list[str], fmt: str = "json") -> DataFrame:
    """Landed responses: one record per request, the body as text."""
    return spark.read.schema(schemas.LANDED_PAYLOAD).format(fmt).load(path)


def is_json(body: Column) -> Column:
    """True for a JSON body of any size.

    The fast test refuses repeated keys, ``NaN`` and very large bodies, so objects
    and lists that it refuses are read once more by the lenient reader.
    """
    options = {"allowNonNumericNumbers": "true", "allowSingleQuotes": "false"}
    text = F.btrim(body, F.lit(" \t\r\n"))
    as_object = F.from_json(
        text, "_broken string", options | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    is_object = text.startswith("{") & text.endswith("}") & as_object["_broken"].isNull()
    is_list = text.startswith("[") & text.endswith("]")
    is_list = is_list & F.from_json(text, "array<string>", options).isNotNull()
    return F.coalesce(F.try_parse_json(body).isNotNull() | is_object | is_list, F.lit(False))


def is_limit_response(
    status: Column, body: Column, provider: Column | None = None, check_phrases: bool = True
) -> Column:
    """True where a response says the provider's limit is reached.

    A body that is not JSON never counts: such a response is lost without
    switching the provider off. The phrase test also fires on article text; it
    can be left out, and then the body is only read for the JSON test. Bodies of
    providers without a limit are not searched.
    """
    signal = status.isin(*LIMIT_STATUS)
    if check_phrases:
        # The one-element array binds the lower-cased body, so a filter lowers it
        # once and not once per phrase.
        lowered = F.array(F.lower(body))
        signal = signal | F.exists(lowered, lambda text: mentions(text, LIMIT_PHRASES))
    if provider is not None:
        signal = ~provider.isin(*UNLIMITED_PROVIDERS) & signal
    # A condition of its own: what the JSON test uses several times would otherwise be
    # computed for every body first.
    return F.coalesce(F.when(signal, is_json(body)), F.lit(False))


def limit_cutoffs(
    requests: DataFrame,
    is_limit: Column,
    group: Sequence[str] = ("run_id", "provider"),
    order: Sequence[str] = ("seq",),
) -> DataFrame:
    """Position of the first limit response per group that has one."""
    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return requests.filter(is_limit).groupBy(*group).agg(F.min(position).alias("cutoff"))


def drop_after_limit(
    requests: DataFrame,
    cutoffs: DataFrame,
    group: Sequence[str] = ("run_id", "provider"),
    order: Sequence[str] = ("seq",),
) -> DataFrame:
    """Keep what each group delivered before its first limit response.

    ``cutoffs`` comes from :func:`limit_cutoffs`: a partially aggregated minimum,
    at most one row per (run, provider). It is written out here, so it is joined by
    its real size, not by an estimate taken from the responses: no group is gathered
    in one task and bodies are not shuffled to meet a few positions.
    """
    cutoffs = settled(cutoffs, "cutoffs")
    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    before = F.col("cutoff").isNull() | (position < F.col("cutoff"))
    return requests.join(cutoffs, list(group), "left").filter(before).drop("cutoff")


def parse_items(payloads: DataFrame) -> DataFrame:
    """One row per delivered item, with its position; bodies of the wrong shape give none."""
    body = F.col("body")
    as_object = F.from_json(body, schemas.FEED_OBJECT)
    is_list = body.rlike(r"^\s*\[")
    items = (
        F.when(F.col("provider") == ALPHA_VANTAGE, as_object["feed"])
        .when(F.col("provider") == MARKETAUX, as_object["data"])
        .when(
            F.col("provider").isin(FINNHUB, YFINANCE) & is_list,
            F.from_json(body, schemas.FEED_LIST),
        )
    )
    carried = [c for c in payloads.columns if c != "body"]
    return payloads.select(*carried, F.posexplode(items).alias("pos", "item"))


def normalize(
    payloads: DataFrame, window: tuple[Column, Column] | None = None
) -> DataFrame:
    """Landed responses to canonical articles of all providers, in one pass.

    The result carries ``provider_rank``, ``seq`` and ``pos``, the order in which
    a run meets the articles, and ``started_at`` if the responses have it. ``window`` (start, end) applies to the providers
    that do not filter by time themselves.
    """
    provider = F.col("provider")
    item, content = F.col("item"), F.col("item.content")
    nested = provider == YFINANCE

    title = (
        F.when(nested, content["title"])
        .when(provider == FINNHUB, item["headline"])
        .otherwise(item["title"])
    )
    description = (
        F.when(nested, F.coalesce(null_if_blank(content["summary"]), content["description"]))
        .when(provider == MARKETAUX, item["description"])
        .otherwise(item["summary"])
    )
    source = F.when(nested, content["provider"]["displayName"]).otherwise(item["source"])
    nested_url = first_present(
        content["canonicalUrl"]["url"], content["clickThroughUrl"]["url"]
    )
    url = F.when(nested, nested_url).otherwise(item["url"])
    published = (
        F.when(provider == ALPHA_VANTAGE, compact_utc(item["time_published"]))
        .when(provider == FINNHUB, epoch_utc(item["datetime"]))
        .when(provider == MARKETAUX, loose_utc(item["published_at"]))
        .when(nested, iso_utc(content["pubDate"]))
    )
    rank = F.array_position(F.array(*[F.lit(p) for p in PROVIDERS]), provider) - 1

    articles = (
        parse_items(payloads.filter(provider.isin(*PROVIDERS)))
        .filter(~nested | nested_url.isNotNull())
        .select(
            *[c for c in schemas.RUNS if c in payloads.columns],
            rank.cast("int").alias("provider_rank"),
            "seq",
            "pos",
            provider.alias("source_api"),
            "symbol",
            title.alias("title"),
            description.alias("description"),
            source.alias("source"),
            url.alias("url"),
            published.alias("published_at"),
        )
    )
    if window is None:
        return articles
    windowed = F.col("source_api").isin(*WINDOWED_PROVIDERS)
    return articles.filter(~windowed | in_window(F.col("published_at"), *window))


def union_providers(feeds: dict[str, DataFrame]) -> DataFrame:
    """Bag union of separately read feeds, each marked with its provider and rank."""
    ranked = [
        feed.withColumn("source_api", F.lit(name)).withColumn("provider_rank", F.lit(rank))
        for rank, (name, feed) in enumerate(feeds.items())
    ]
    return reduce(DataFrame.unionByName, ranked)
