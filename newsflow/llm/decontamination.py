"""Operator 6: benchmark decontamination with a positional inverted index.

Every benchmark item is cut into windows of ten consecutive words (an item of fewer
words is one window). The corpus counts of the benchmark's words are taken first; a
window with a word the corpus lacks cannot occur and is dropped. The index stores
postings (term, document, position) of the terms that are among the three rarest
of some window. A window's occurrences are then found by intersecting its lists,
rarest first: a posting minus the term's offset in the window is a start, and a
start stays if the next term stands at its own offset from it, exactly or, for a
proximity match, within ``slop`` words. Exact phrase matches are checked word by
word on the documents that are left.

Only DataFrame functions are used. The small sides (windows, terms) are written
tables, so Spark broadcasts them while their real size allows and shuffles them
otherwise. A posting list is never gathered in one row.

A NULL text has no words. Windows that several items share count for each of them.
Rows with equal ids and texts get equal results; equal ids with different texts are
judged apart. Items with a NULL id are searched for but have no id to be counted by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.session import scratch, settled

WINDOW = 10
RAREST = 3

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# What stands between words, ASCII without letters and digits, one by one: Java looks
# such a class up in a table, but tests ranges one after the other through objects that
# the threads of one JVM get in each other's way with.
_BETWEEN = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"


def lowered(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def cut(text: Column) -> Column:
    """Words of the text as they stand."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), _BETWEEN), "")


def words_of(text: Column) -> Column:
    """Words of the text with A-Z lower-cased and nothing else changed."""
    return cut(lowered(text.cast("string")))


def count_words(text: Column) -> Column:
    return F.size(cut(text)).cast("long")


def windows_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """Distinct (item, window): the window as an array of words."""
    rows = items.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    cut = rows.select("item", "w", F.explode(starts).alias("at"))
    return cut.select("item", F.slice("w", F.col("at"), F.lit(width)).alias("window")).distinct()


def term_counts(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """How often the corpus uses each benchmark term, over all documents."""
    terms = settled(windows.select(F.explode("window").alias("term")).distinct(), "terms")
    tokens = docs.select(F.explode(cut(F.col("text"))).alias("word")).select(lowered(F.col("word")).alias("term"))
    return settled(tokens.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("uses")), "uses")


def anchors_of(windows: DataFrame, uses: DataFrame, rarest: int = RAREST) -> DataFrame:
    """Windows that can occur, with their rarest terms as (uses, term, offset), rarest first."""
    distinct = windows.select("window").distinct()
    placed = distinct.select("window", F.posexplode("window").alias("offset", "term"))
    terms = placed.join(uses, "term").groupBy("window").agg(
        F.collect_list(F.struct("uses", "term", "offset")).alias("terms"))
    whole = terms.filter(F.size("terms") == F.size("window"))
    # A term that repeats in the window is taken at its first place only.
    first = F.filter("terms", lambda t: F.array_position("window", t["term"]) == t["offset"] + 1)
    return whole.select("window", F.slice(F.array_sort(first), 1, rarest).alias("anchors"))


def postings_of(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """The index: (term, id, version, pos) of all terms some window is anchored at."""
    terms = settled(anchors.select(F.explode("anchors.term").alias("term")).distinct(), "anchors")
    tokens = docs.select("id", "version", F.posexplode(cut(F.col("text"))).alias("pos", "word")).select(
        lowered(F.col("word")).alias("term"), "id", "version", "pos")
    return settled(tokens.join(terms, "term", "left_semi"), "postings")


def occurrences(postings: DataFrame, anchors: DataFrame, rarest: int = RAREST, slop: int = 0) -> DataFrame:
    """Starts of windows whose rarest terms stand at their offsets: (id, version, start, window).

    With ``slop``, each further term may stand up to so many words off its place:
    proximity matches instead of candidates for exact ones.
    """
    anchor = F.col("anchors")[0]
    # Windows travel as a number; two with the same one would both be candidates.
    numbered = anchors.withColumn("number", F.xxhash64("window"))
    further = [
        c for k in range(1, rarest)
        for c in (F.get("anchors", F.lit(k))["term"].alias(f"term{k}"), F.get("anchors", F.lit(k))["offset"].alias(f"offset{k}"))
    ]
    lists = numbered.select("number", anchor["term"].alias("term"), anchor["offset"].alias("offset"), *further)
    carried = [c for c in lists.columns if c not in ("term", "offset")]
    found = postings.join(lists, "term").select(
        "id", "version", (F.col("pos") - F.col("offset")).alias("start"), *carried
    ).filter(F.col("start") >= -slop)
    for k in range(1, rarest):
        found = settled(found, "found")
        wanted = found.filter(F.col(f"term{k}").isNotNull()).withColumns(
            {"_term": F.col(f"term{k}"), "_pos": F.col("start") + F.col(f"offset{k}")})
        if slop:  # each place the term may stand at, so that lists meet by equality
            wanted = wanted.withColumn("_pos", F.explode(F.sequence(F.col("_pos") - slop, F.col("_pos") + slop)))
        here = (
            F.col("id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version"))
            & (F.col("term") == F.col("_term")) & (F.col("pos") == F.col("_pos"))
        )
        places = wanted.select(
            F.col("id").alias("_id"), F.col("version").alias("_version"), "_term", "_pos").distinct()
        # Of the long lists, which are not sorted for it, those places stay that are asked for.
        terms = lists.select(f"term{k}").distinct()
        other = postings.join(terms, F.col("term") == F.col(f"term{k}"), "left_semi")
        there = other.join(places.hint("shuffle_hash"), here, "left_semi").select(
            F.col("id").alias("_id"), F.col("version").alias("_version"), "term", "pos")
        there = settled(there, "there")
        here = (
            F.col("id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version"))
            & (F.col("_term") == F.col("term")) & (F.col("_pos") == F.col("pos"))
        )
        kept = wanted.join(there, here, "left_semi").drop("_term", "_pos")
        kept = kept.distinct() if slop else kept
        found = kept.unionByName(found.filter(F.col(f"term{k}").isNull()))
    return found.join(numbered.select("number", "window"), "number").select("id", "version", "start", "window")


def _texts_with(docs: DataFrame, candidates: DataFrame, name: str) -> DataFrame:
    """Documents with candidates: id, version, their words w and the (start, window) to be checked."""
    per_doc = candidates.groupBy("id", "version").agg(F.collect_set(F.struct("start", "window")).alias("starts"))
    per_doc = settled(per_doc, f"{name}-starts").withColumnsRenamed({"id": "_id", "version": "_version"})
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version"))
    # The ids alone are sent to the texts, which stay in place if the ids are few enough.
    ids = settled(per_doc.select("_id", "_version"), f"{name}-ids")
    # Written, so that each of these texts is cut into words once.
    read = settled(
        docs.join(ids, same, "left_semi").select("id", "version", words_of(F.col("text")).alias("w")), f"{name}-read")
    return read.join(per_doc, same).select("id", "version", "w", "starts")


def exact_hits(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Documents with occurrences: id, version, n_hit words and the windows that occur."""
    read = _texts_with(docs, candidates, "exact")
    true = F.filter(
        "starts", lambda s: F.slice(F.col("w"), s["start"] + 1, F.size(s["window"])) == s["window"])
    hits = read.select("id", "version", true.alias("hits")).filter("size(hits) > 0")
    places = F.flatten(F.transform(
        "hits", lambda h: F.sequence(h["start"], h["start"] + F.size(h["window"]) - 1)))
    return hits.select(
        "id", "version", F.size(F.array_distinct(places)).cast("long").alias("n_hit"),
        F.array_distinct(F.col("hits.window")).alias("windows"))


def near_hits(docs: DataFrame, candidates: DataFrame, slop: int) -> DataFrame:
    """As :func:`exact_hits`, for windows all of whose words stand within ``slop`` words of their place.

    Places are counted from the window's rarest term; n_hit counts the words that match.
    """
    read = _texts_with(docs, candidates, "near")

    def places(start: Column, window: Column) -> Column:
        return F.transform(window, lambda term, k: F.filter(
            F.sequence(start + k - slop, start + k + slop), lambda at: F.get(F.col("w"), at) == term))

    placed = F.transform("starts", lambda s: F.struct(s["window"].alias("window"), places(s["start"], s["window"]).alias("at")))
    true = F.filter(placed, lambda s: F.forall(s["at"], lambda at: F.size(at) > 0))
    hits = read.select("id", "version", true.alias("hits")).filter("size(hits) > 0")
    return hits.select(
        "id", "version", F.size(F.array_distinct(F.flatten(F.flatten(F.col("hits.at"))))).cast("long").alias("n_hit"),
        F.array_distinct(F.col("hits.window")).alias("windows"))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
    slop: int = 0,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (their ids as text, sorted).

    With ``slop``, also n_near and items_near: the same for windows all of whose words
    stand within ``slop`` words of their place, the exact ones among them.
    What was found is written; all other tables on the way to it are removed.
    """
    docs, found = _judged(docs, items, id_col, text_col, item_col, item_text_col, width, slop)
    found = found.withColumnsRenamed({"id": "_id", "version": "_version"})
    counted = docs.select("id", "version", count_words(F.col("text")).alias("n_words"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version"))
    none = F.array().cast("array<string>")
    ends = ("", "hit"), ("_near", "near")
    columns = [
        c for end, n in ends[: 2 if slop else 1]
        for c in (F.coalesce(f"n_{n}", F.lit(0).cast("long")).alias(f"n_{n}"), F.coalesce(f"items{end}", none).alias(f"items{end}"))
    ]
    return counted.join(found, same, "left").select(F.col("id").alias(id_col), "n_words", *columns)


def _judged(
    docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, width: int,
    slop: int,
) -> tuple[DataFrame, DataFrame]:
    """The documents as (id, text, version) and what was found in them, written."""
    docs = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("version", F.xxhash64("text"))
    with scratch(docs.sparkSession):
        windows = windows_of(items, item_col, item_text_col, width)
        return docs, settled(_found(docs, windows, slop), "found", outlives=True)


def _found(docs: DataFrame, windows: DataFrame, slop: int) -> DataFrame:
    """Documents with occurrences: id, version, n_hit and the items' ids; with ``slop`` also near ones."""
    windows = settled(windows, "windows")
    anchors = settled(anchors_of(windows, term_counts(docs, windows)), "lists")
    postings = postings_of(docs, anchors)
    found = _owned(exact_hits(docs, occurrences(postings, anchors)), windows)
    if not slop:
        return found
    near = _owned(near_hits(docs, occurrences(postings, anchors, slop=slop), slop), windows)
    near = near.withColumnsRenamed({"n_hit": "n_near", "items": "items_near"})
    found = found.withColumnsRenamed({"id": "_id", "version": "_version"})
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version"))
    return near.join(found, same, "left").drop("_id", "_version")


def _owned(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """Hits with the ids of the items that have their windows."""
    hits = settled(hits.dropDuplicates(["id", "version"]), "hits")
    owners = (
        hits.select("id", "version", F.explode("windows").alias("window"))
        .join(windows, "window")
        .groupBy("id", "version")
        .agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    )
    return hits.select("id", "version", "n_hit").join(
        owners.withColumnsRenamed({"id": "_id", "version": "_version"}),
        F.col("id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")), "left",
    ).select("id", "version", "n_hit", "items")


def clean_documents(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", slop: int = 0
) -> DataFrame:
    """The documents that no benchmark window occurs in, with their columns as they are.

    A row goes for its own text only, whatever else stands under its id. With ``slop``,
    proximity matches count too.
    """
    _, found = _judged(docs, items, id_col, text_col, "item_id", "text", WINDOW, slop)
    # Columns of any name are kept apart from those used here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumns({
        "id": F.col("row")[id_col], "version": F.xxhash64(F.col("row")[text_col].cast("string"))})
    hit = found.select(F.col("id").alias("hit_id"), F.col("version").alias("hit_version"))
    same = F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("version") == F.col("hit_version"))
    return rows.join(hit, same, "left_anti").select("row.*")
