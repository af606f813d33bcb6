"""Stock matching for dictionaries of any size, through an index of alias q-grams.

The literal form in :mod:`stock_match` writes each alias into the plan. Here the
dictionary is a table. Every alias is indexed under one of its q-grams, the one that
the fewest aliases have. Texts are cut into short overlapping pieces, and the q-grams
of a piece meet the index by equality: Spark broadcasts the index while it is small and
shuffles both sides when it is not. A gram that meets is compared in place, on the
piece it came from, so the text itself never travels, and what is left of an article
is its least rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.functions.clean import null_if_blank
from newsflow.functions.text import search_text
from newsflow.session import settled

GRAM = 4
PIECE = 256  # characters in which an alias may begin
MOST_ALIAS = 256  # an alias is a name; a longer one is an error

_WORDLIKE = r"[\p{L}\p{N}]"


def gram_index(dictionary: DataFrame, gram: int = GRAM) -> DataFrame:
    """One row per alias: its rarest gram, the gram's place in it, and the rank it stands for.

    ``dictionary`` has (symbol, alias, rank), one rank per symbol. Aliases are
    lower-cased; empty and NULL ones are left out; one that several stocks have stands
    for the stock of least rank. Aliases shorter than ``gram`` are their own gram.
    """
    names = (
        dictionary.select(F.lower("alias").alias("alias"), F.col("rank").cast("long").alias("alias_rank"))
        .filter("alias <> '' AND alias_rank IS NOT NULL")
        .groupBy("alias").agg(F.min("alias_rank").alias("alias_rank"))
        .withColumn("alias_size", F.length("alias"))
    )
    last = F.greatest(F.col("alias_size") - gram, F.lit(0))
    cut = names.withColumn("alias_at", F.explode(F.sequence(F.lit(0), last)))
    cut = cut.withColumn("alias_gram", F.substr("alias", F.col("alias_at") + 1, F.lit(gram)))
    # Grams are counted with a partial aggregate: a usual one is not gathered in one task.
    cut = settled(cut, "alias-grams")
    shared = cut.groupBy("alias_gram").agg(F.count("*").alias("sharing"))
    rarest = Window.partitionBy("alias").orderBy("sharing", "alias_at")
    ranked = cut.join(shared, "alias_gram").withColumn("place", F.row_number().over(rarest))
    index = ranked.filter("place = 1").select("alias_gram", "alias_at", "alias", "alias_rank", "alias_size")
    return settled(index, "alias-index")


def _pieces(text: Column, longest: int) -> Column:
    """Overlapping pieces of the text, framed by line ends.

    An alias that begins at one of the characters 2 to ``PIECE`` + 1 of a piece lies in it
    with the characters around it, and each place of the text is such a place of one piece.
    """
    framed = F.concat(F.lit("\n"), text, F.lit("\n"))
    return F.regexp_extract_all(framed, F.lit(rf"(?s)(?=(.{{1,{PIECE + longest + 2}}})).{{1,{PIECE}}}"), F.lit(1))


def _grams(piece: Column, sizes: list[int]) -> Column:
    """The grams of the piece at each of its places, one list per size."""
    return F.array(*[
        F.regexp_extract_all(piece, F.lit(rf"(?s)(?=(.{{{size}}}))."), F.lit(1)) for size in sizes])


def least_ranks(articles: DataFrame, index: DataFrame, key: str = "url", whole_words: bool = False) -> DataFrame:
    """(key, alias_rank): the first stock of each article that mentions one."""
    # At most GRAM different sizes, and one number.
    sizes, longest = index.agg(
        F.collect_set(F.length("alias_gram")), F.coalesce(F.max("alias_size"), F.lit(0))).first()
    if longest > MOST_ALIAS:
        raise ValueError(f"an alias has {longest} characters, more than {MOST_ALIAS}")
    if not sizes:
        return articles.select(key, F.lit(None).cast("long").alias("alias_rank")).limit(0)
    text = search_text(F.col("title"), F.col("description"))
    pieces = articles.select(F.col(key).alias("key"), F.explode(_pieces(text, longest)).alias("piece"))
    lists = pieces.select("key", "piece", F.explode(_grams(F.col("piece"), sorted(sizes))).alias("list"))
    grams = lists.select("key", "piece", F.posexplode("list").alias("at", "alias_gram"))
    start = F.col("at") + 1 - F.col("alias_at")
    here = start.between(2, PIECE + 1) & (F.substr("piece", start, F.col("alias_size")) == F.col("alias"))
    if whole_words:
        around = F.concat(
            F.substr("piece", start - 1, F.lit(1)), F.substr("piece", start + F.col("alias_size"), F.lit(1)))
        here = here & ~around.rlike(_WORDLIKE)
    hits = grams.join(index, "alias_gram").filter(here)
    return hits.groupBy(F.col("key").alias(key)).agg(F.min("alias_rank").alias("alias_rank"))


def assign_stock_indexed(
    articles: DataFrame, dictionary: DataFrame, key: str = "url", whole_words: bool = False
) -> DataFrame:
    """As :func:`stock_match.assign_stock`, with the dictionary as a table (symbol, alias, rank).

    ``key`` identifies an article: after deduplication its URL. Rows that repeat a key
    share what any of them mentions; a row without a key keeps its own symbol.
    """
    ranks = least_ranks(articles, gram_index(dictionary), key, whole_words)
    named = dictionary.select(F.col("rank").cast("long").alias("alias_rank"), F.col("symbol").alias("alias_symbol"))
    found = settled(ranks.join(named.distinct(), "alias_rank").select(key, "alias_symbol"), "alias-hits")
    symbol = F.coalesce("alias_symbol", null_if_blank(F.col("symbol")))
    linked = articles.join(found, key, "left").withColumn("symbol", symbol)
    return linked.filter(F.col("symbol").isNotNull()).select(*articles.columns)
