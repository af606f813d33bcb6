"""Link articles to stocks through the alias dictionary.

The dictionary is configuration, a few aliases per stock, so it is written into
the plan as literals: matching is a narrow projection next to the scan, with no
join, no shuffle and no row multiplication before the result is known. A dictionary of
more than ``MOST_LITERALS`` aliases is given as a table and matched through an index.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.functions.clean import null_if_blank
from newsflow.functions.text import mentions, needed_aliases, search_text
from newsflow.operators.alias_index import assign_stock_indexed
from newsflow.stocks import ALIASES

MOST_LITERALS = 1000
_TEXT = "_match_text"


def _bounded(aliases: Mapping[str, Sequence[str]]) -> Mapping[str, Sequence[str]]:
    count = sum(map(len, aliases.values()))
    if count > MOST_LITERALS:
        raise ValueError(f"{count} aliases are too many for the plan: give them as a table (symbol, alias, rank)")
    return aliases


def stock_symbol(
    text: Column,
    own: Column,
    aliases: Mapping[str, Sequence[str]] = ALIASES,
    whole_words: bool = False,
) -> Column:
    """First stock with an alias in the lower-cased ``text``, else ``own`` unless blank.

    Mapping order is rank order and the search stops at the first hit. An alias
    that contains one of an earlier stock can never decide and is not looked for.
    """
    symbol, decided = F, []
    for name, names in aliases.items():
        if not whole_words:
            names = needed_aliases(names, decided)
            decided += names
        if names:
            symbol = symbol.when(mentions(text, names, whole_words), name)
    found = F.lit(None).cast("string") if symbol is F else symbol
    return F.coalesce(found, null_if_blank(own))


def with_match_text(articles: DataFrame, name: str = _TEXT) -> DataFrame:
    """Add the lower-cased text that aliases are searched in.

    As a column of its own it is computed once per row, however many aliases
    are looked for.
    """
    return articles.withColumn(name, search_text(F.col("title"), F.col("description")))


def assign_stock(
    articles: DataFrame,
    aliases: Mapping[str, Sequence[str]] | DataFrame = ALIASES,
    whole_words: bool = False,
) -> DataFrame:
    """Give each article the first stock whose alias its title or description contains.

    Without a hit the article keeps the symbol it was requested for; with
    neither it is dropped. Aliases match inside words unless ``whole_words``.
    ``aliases`` may be a table (symbol, alias, rank) of any size; articles are then
    told apart by their URL.
    """
    if isinstance(aliases, DataFrame):
        return assign_stock_indexed(articles, aliases, whole_words=whole_words)
    _bounded(aliases)
    # Articles with a symbol of their own always stay. Testing that first keeps
    # the optimizer from searching every text once more in the filter.
    every_alias = [alias for names in aliases.values() for alias in names]
    text = F.array(search_text(F.col("title"), F.col("description")))
    any_hit = F.exists(text, lambda t: mentions(t, every_alias, whole_words))
    stays = F.coalesce(F.col("symbol") != "", F.lit(False)) | any_hit
    symbol = stock_symbol(F.col(_TEXT), F.col("symbol"), aliases, whole_words)
    # What stays has a symbol. A column that cannot be NULL says so to a later join, which
    # would otherwise search the texts once more, lowered for each alias, to drop NULLs.
    symbol = F.coalesce(symbol, F.lit(""))
    return with_match_text(articles.filter(stays)).withColumn("symbol", symbol).drop(_TEXT)


def all_stock_matches(
    articles: DataFrame,
    aliases: Mapping[str, Sequence[str]] = ALIASES,
    whole_words: bool = False,
) -> DataFrame:
    """One row per article and matching stock, with the rank of the stock.

    An article yields at most one row per stock of the dictionary.
    """
    found = [
        F.when(
            mentions(F.col(_TEXT), names, whole_words),
            F.struct(F.lit(rank).alias("match_rank"), F.lit(name).alias("match_symbol")),
        )
        for rank, (name, names) in enumerate(_bounded(aliases).items())
    ]
    return (
        with_match_text(articles)
        .withColumn("_match", F.explode(F.array_compact(F.array(*found))))
        .select(*articles.columns, "_match.*")
    )
