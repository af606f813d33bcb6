"""Operator 11: phrases whose words stand together more often than apart, per language.

Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line breaks, and
the pieces into words at spaces and tabs. A candidate is a phrase of 2 to ``longest``
words with at least ``least`` occurrences a. Cut after its first k words, of which
there are l occurrences, and r of the rest, it scores floor(2000000 a / (l + r)); its
lowest score counts, the smallest k of equal ones. A candidate is dropped if a longer
candidate that holds its words has ``covered`` percent of its occurrences or more
(looking one word further to both sides is enough: what is longer still has no more
occurrences than what lies between). Of each language the ``top`` best remain.

The search is best-first branch and bound, in rounds. Words and word pairs are counted
in full. A phrase grown from the pair p has at most f(p) occurrences, and its first
word has l = f(first), so it scores at most floor(2000000 f(p) / (f(first) + f(p))).
A round supposes a lowest score t for each language, first that of its pair at
one and a half times ``top``. The pairs whose bound reaches t are the frontier (every pair that scores t is
one of them): only they are grown, to full length, and one word to the left to see
what covers them. If ``top`` candidates with a score of t survive, no phrase outside
the frontier can be among the best and the language is settled, ties included.
Otherwise t sinks to the score of a pair four times further down, in the end to 0,
where every candidate is looked at.

Phrases are counted next to the scan: a task counts the windows of its texts that pass
a filter, Spark adds them up. A filter is a table of ``2 ** FILTER_BITS`` bits set by
hashes of phrases, of one size whatever the corpus. A phrase that passes by chance is
counted exactly too, which changes nothing. Words are told apart by 64-bit hashes of
language and word; two with one hash would raise an error.

NULL and empty texts have no words; a NULL language is ``und``. Repeated rows count
each. Bytes that are not UTF-8 belong to words and are shown as U+FFFD. Without
candidates the result is empty. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsflow.llm.tokens import _LOWER, Texts, Words, column, mixed, sliced, word_hashes, words
from newsflow.session import settled

TOP, LEAST, LONGEST, COVERED = 2000, 30, 4, 80
FILTER_BITS = 26
UNKNOWN = "und"
WIDER = 4
# What a task reads, counts and hands over at once; executors hold a few such pieces.
_SLICE_BYTES = 1 << 20
_BATCH_ROWS = 1 << 15
_BATCH_BYTES = 4 << 20
_IS_END = np.zeros(256, bool)
_IS_END[list(b".,;:!?\n\x0b\x0c\r")] = True
_IS_WORD = ~_IS_END
_IS_WORD[list(b" \t")] = False
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _names(width: int, first: int = 1) -> list[str]:
    """Columns of ``width`` word hashes of a phrase, from its word ``first`` on."""
    return [f"w{i}" for i in range(first, first + width)]


def _key(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of a row of hashes."""
    return reduce(lambda whole, part: mixed(whole * _STEP + part), parts)


def _language_hashes(names: list[str]) -> np.ndarray:
    digests = [hashlib.blake2b(n.encode("utf-8", "surrogatepass"), digest_size=8).digest() for n in names]
    return np.frombuffer(b"".join(digests), "<u8").astype(np.uint64)


@dataclass(frozen=True)
class _Slice:
    """Words of some rows: place, hash of language and word, number of piece and of language."""

    rows: Texts
    found: Words
    hashes: np.ndarray
    piece: np.ndarray
    lang: np.ndarray
    languages: list[str]

    def windows(self, width: int) -> np.ndarray:
        """First words of all windows inside a piece."""
        count = max(len(self.hashes) - width + 1, 0)
        last, row = slice(width - 1, width - 1 + count), self.found.row
        return np.flatnonzero((row[:count] == row[last]) & (self.piece[:count] == self.piece[last]))

    def parts(self, at: np.ndarray, width: int) -> list[np.ndarray]:
        return [self.hashes[at + i] for i in range(width)]

    def counted(self, at: np.ndarray, width: int, longest: int) -> Iterator[pa.RecordBatch]:
        """How often each window occurs; words beyond ``width`` are NULL."""
        _, chosen, counts = np.unique(_key(self.parts(at, width)), return_index=True, return_counts=True)
        at = at[chosen]
        for low in range(0, len(at), _BATCH_ROWS):
            own = at[low : low + _BATCH_ROWS]
            more = [pa.nulls(len(own), pa.int64())] * (longest - width)
            number = pa.array(counts[low : low + _BATCH_ROWS].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*[column(part) for part in self.parts(own, width)], *more, number], [*_names(longest), "n"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[_Slice]:
    for batch, rows in sliced(batches, "text", _SLICE_BYTES):
        found = words(rows, _IS_WORD)
        if not len(found.start):
            continue
        coded = pc.fill_null(batch.column("lang"), UNKNOWN).dictionary_encode()
        names = coded.dictionary.to_pylist()
        lang = coded.indices.to_numpy(zero_copy_only=False)[found.row]
        hashes = _key([_language_hashes(names)[lang], word_hashes(rows, found, lower=True)])
        piece = np.searchsorted(np.flatnonzero(_IS_END[rows.data]), found.start)
        yield _Slice(rows, found, hashes, piece, lang, names)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for own in _read(batches):
        hashes, at, counts = np.unique(own.hashes, return_index=True, return_counts=True)
        lower, found = _LOWER[own.rows.data], own.found
        spelled = [lower[found.start[i] : found.end[i]].tobytes().decode("utf-8", "replace") for i in at]
        numbers = pa.array(own.lang[at], pa.int32())
        lang = pa.DictionaryArray.from_arrays(numbers, pa.array(own.languages, pa.string())).cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [lang, column(hashes), pa.array(spelled, pa.string()), pa.array(counts.astype(np.int64))],
            ["lang", "w1", "word", "n"])


def _count_pairs(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of words that pass the filter."""
    for own in _read(batches):
        good = _holds(frequent, _key([own.hashes]))
        at = own.windows(2)
        yield from own.counted(at[good[at] & good[at + 1]], 2, 2)


def _grow(
    batches: Iterator[pa.RecordBatch], longest: int, frequent: np.ndarray, frontier: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Windows of 3 to ``longest`` words all of whose pairs are frequent.

    Their first pair is of the frontier, or the second, seen from one word further left.
    """
    for own in _read(batches):
        pair = np.zeros(len(own.hashes) + 1, bool)
        grown = pair.copy()
        at = own.windows(2)
        keys = _key(own.parts(at, 2))
        pair[at], grown[at] = _holds(frequent, keys), _holds(frontier, keys)
        for width in range(3, longest + 1):
            at = own.windows(width)
            good = np.logical_and.reduce([pair[at + i] for i in range(width - 1)])
            yield from own.counted(at[good & (grown[at] | grown[at + 1])], width, longest)


def _count_given(batches: Iterator[pa.RecordBatch], width: int, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    for own in _read(batches):
        at = own.windows(width)
        yield from own.counted(at[_holds(wanted, _key(own.parts(at, width)))], width, width)


def _spots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key."""
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return keys & mask, (keys >> np.uint64(32)) & mask


def _holds(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    held = np.ones(len(keys), bool)
    for spot in _spots(keys):
        held &= (bits[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
    return held


def _cells(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Filter cells of 64 bits that the phrases of a task set."""
    for batch in batches:
        if not len(batch):
            continue
        keys = _key([batch.column(n).to_numpy().view(np.uint64) for n in _names(width)])
        spots = np.unique(np.concatenate(_spots(keys)))
        cell, first = np.unique(spots >> np.uint64(6), return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (spots & np.uint64(63)), first)
        yield pa.RecordBatch.from_arrays([column(cell), column(bits)], ["cell", "bits"])


def phrase_filter(phrases: DataFrame, width: int) -> np.ndarray:
    """Bit table of phrases (w1, ...).

    At most ``2 ** (FILTER_BITS - 6)`` rows reach the driver.
    """
    cells = phrases.select(*_names(width)).mapInArrow(partial(_cells, width=width), "cell long, bits long")
    rows = cells.groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[rows["cell"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return bits


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows go to Python in batches of ``_BATCH_BYTES``, since executors hold a batch several times over."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(_BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Corpus:
    """Counts of words and windows in the texts of ``docs``."""

    def __init__(self, docs: DataFrame, text_col: str, lang_col: str, least: int):
        self.texts = docs.select(
            F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
        self.least = least

    def words(self) -> DataFrame:
        """All words: lang, w1 (hash), word, n."""
        found = self.texts.mapInArrow(_count_words, "lang string, w1 long, word string, n long")
        with _small_batches(self.texts.sparkSession):
            total = settled(found.groupBy("lang", "w1", "word").agg(F.sum("n").alias("n")), "phrase-words")
        clash = total.groupBy("w1").count().filter("count > 1").head(1)
        if clash:
            raise ValueError(f"two words share the hash {clash[0].w1}")
        return total

    def windows(self, count: Callable, width: int, name: str) -> DataFrame:
        """Windows that ``count`` finds and that occur often enough: w1, ..., n."""
        names = _names(width)
        found = self.texts.mapInArrow(count, ", ".join(f"{n} long" for n in [*names, "n"]))
        total = found.groupBy(*names).agg(F.sum("n").alias("n"))
        with _small_batches(self.texts.sparkSession):
            return settled(total.filter(F.col("n") >= self.least), name)


def _joined(rows: DataFrame, counts: DataFrame, width: int, first: int, name: str, *more: str) -> DataFrame:
    """Add the count of the ``width`` words from ``first`` on as ``name``."""
    names = _names(width, first)
    renamed = counts.select(
        *[F.col(a).alias(b) for a, b in zip(_names(width), names)], F.col("n").alias(name), *more)
    return rows.join(renamed, names)


def _ratio(a: str, total: str) -> str:
    """floor(2000000 a / total) with products beyond 64 bits."""
    return f"(2000000 * cast({a} AS DECIMAL(20,0))) div ({total})"


def _wide(*counts: str) -> str:
    return " + ".join(f"cast({c} AS DECIMAL(20,0))" for c in counts)


def scored(tables: dict[int, DataFrame], width: int, cuts: list[int] | None = None) -> DataFrame:
    """Phrases with score, l and r of the lowest-scoring cut, and the bound of what grows from them."""
    cuts = cuts or list(range(1, width))
    rows = _joined(tables[width], tables[1], 1, 1, "first", "lang")
    for k in cuts:
        rows = _joined(rows, tables[k], k, 1, f"l{k}")
        rows = _joined(rows, tables[width - k], width - k, k + 1, f"r{k}")
    each = ", ".join(
        f"struct({_ratio('n', _wide(f'l{k}', f'r{k}'))} AS score, {k} AS k, l{k} AS l, r{k} AS r)" for k in cuts)
    lowest = rows.withColumn("cut", F.expr(f"least({each})" if len(cuts) > 1 else each))
    return lowest.select(
        "lang", *_names(width), "n", "cut.score", "cut.l", "cut.r", F.expr(_ratio("n", _wide("first", "n"))).alias("bound"))


def _uncovered(rows: DataFrame, longer: DataFrame, width: int, covered: int) -> DataFrame:
    """Phrases that no phrase of one word more covers."""
    names = _names(width)
    sides = [longer.select(*[F.col(f"w{i + s}").alias(f"w{i}") for i in range(1, width + 1)], "n") for s in (0, 1)]
    most = sides[0].unionByName(sides[1]).groupBy(*names).agg(F.max("n").alias("most"))
    kept = f"most IS NULL OR 100 * cast(most AS DECIMAL(20,0)) < {covered} * cast(n AS DECIMAL(20,0))"
    return rows.join(most, names, "left").filter(kept).drop("most")


def _score_at(scores: DataFrame, place: int) -> DataFrame:
    """Per language the score of the ``place``-th best row, 0 if there are fewer.

    Rows are counted per score first, so a language has at most 1,000,001 of them.
    """
    counts = scores.groupBy("lang", "score").agg(F.count("*").alias("rows"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"))
    reached = counts.withColumn("reached", F.sum("rows").over(order))
    at = F.max(F.when(F.col("reached") >= place, F.col("score")))
    return reached.groupBy("lang").agg(F.coalesce(at, F.lit(0)).alias("least_score"))


def _padded(rows: DataFrame, width: int, longest: int) -> DataFrame:
    more = [F.lit(None).cast("long").alias(f"w{i}") for i in range(width + 1, longest + 1)]
    return rows.select("lang", *_names(width), *more, "n", "score", "l", "r")


def _round(
    corpus: Corpus, tables: dict[int, DataFrame], frequent: np.ndarray, pairs: DataFrame, longest: int, covered: int
) -> DataFrame:
    """Surviving candidates with at least the supposed ``least_score`` of their language."""
    tables, lowest = dict(tables), pairs.select("lang", "least_score").distinct()
    if longest > 2:
        frontier = phrase_filter(pairs.filter("bound >= least_score"), 2)
        grow = partial(_grow, longest=longest, frequent=frequent, frontier=frontier)
        grown = corpus.windows(grow, longest, "phrases-grown")
        for width in range(3, longest + 1):
            own = grown.filter(f"w{width} IS NOT NULL")
            own = own if width == longest else own.filter(f"w{width + 1} IS NULL")
            tables[width] = own.select(*_names(width), "n")
    level, found = pairs, []
    for width in range(2, longest + 1):
        if width > 2:
            _count_rests(corpus, tables, lowest, width)
            level = scored(tables, width).join(lowest, "lang")
        checked = level.filter("score >= least_score")
        if width < longest:
            checked = _uncovered(checked, tables[width + 1], width, covered)
        found.append(_padded(checked, width, longest))
    return settled(reduce(DataFrame.unionByName, found), "phrases-surviving")


def _count_rests(corpus: Corpus, tables: dict[int, DataFrame], lowest: DataFrame, width: int) -> None:
    """Count the rests of ``width``-word phrases that no frontier has reached.

    Pairs are counted in full. A longer rest is wanted if the cuts whose parts are
    known leave its phrase a score that counts.
    """
    known = [k for k in range(1, width) if width - k <= 2]
    for size in range(3, width):
        open_ = scored(tables, width, known).join(lowest, "lang").filter("score >= least_score")
        rest = open_.select(*[F.col(f"w{i + width - size}").alias(f"w{i}") for i in range(1, size + 1)])
        missing = settled(rest.distinct().join(tables[size], _names(size), "left_anti"), "phrases-wanted")
        if missing.isEmpty():
            continue
        count = partial(_count_given, width=size, wanted=phrase_filter(missing, size))
        more = corpus.windows(count, size, f"phrases-{size}").join(tables[size], _names(size), "left_anti")
        tables[size] = settled(tables[size].unionByName(more), f"phrases-{size}")


def mine_phrases(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    top: int = TOP,
    least: int = LEAST,
    longest: int = LONGEST,
    covered: int = COVERED,
) -> DataFrame:
    """The best phrases of every language: lang, rank, phrase, a, l, r, n, score."""
    corpus = Corpus(docs, text_col, lang_col, least)
    vocabulary = corpus.words()
    words_ = settled(vocabulary.filter(F.col("n") >= least).select("lang", "w1", "n"), "phrases-1")
    count = partial(_count_pairs, frequent=phrase_filter(words_, 1))
    tables = {1: words_, 2: corpus.windows(count, 2, "phrases-2")}
    pairs = settled(scored(tables, 2), "phrases-2-scored")
    frequent = phrase_filter(pairs, 2)

    # Half as many pairs again as asked for, since longer phrases cover some.
    place, waiting, surviving = top * 3 // 2, pairs, []
    while True:
        supposed = settled(_score_at(waiting, place), "phrase-scores")
        found = _round(corpus, tables, frequent, waiting.join(supposed, "lang"), longest, covered)
        survivors = found.groupBy("lang").agg(F.count("*").alias("survivors"))
        state = supposed.join(survivors, "lang", "left")
        state = settled(state.select(
            "lang", ((F.coalesce("survivors", F.lit(0)) >= top) | (F.col("least_score") == 0)).alias("done")), "phrase-state")
        surviving.append(found.join(state.filter("done").select("lang"), "lang", "left_semi"))
        left = state.filter("NOT done").select("lang")
        if left.isEmpty():
            break
        waiting, place = waiting.join(left, "lang", "left_semi"), place * WIDER

    rows = settled(reduce(DataFrame.unionByName, surviving), "phrases-found")
    rows = rows.join(_score_at(rows, top), "lang").filter("score >= least_score")
    for i in range(1, longest + 1):
        spelled = vocabulary.select(F.col("w1").alias(f"w{i}"), F.col("word").alias(f"word{i}"))
        rows = rows.join(spelled, f"w{i}", "left")
    rows = rows.withColumn("phrase", F.concat_ws(" ", *[f"word{i}" for i in range(1, longest + 1)]))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("n"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    sizes = vocabulary.groupBy("lang").agg(F.sum("n").alias("size"))
    return ranked.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("n").alias("a"), "l", "r",
        F.col("size").alias("n"), "score")
