"""Operator 2: quality classifier, an additive model with pairwise interactions.

Each feature of a text is put into bins. Shallow trees over one feature's bins are
boosted in turns, round after round, and added up into one lookup table per
feature; then the strongest pairs of features get tables of their own in the same
way. A score is the sum of the looked-up values, so scoring is a few vectorised
additions per text and never looks at labels, language, source or id.

The model is fitted on the driver from a bounded sample of labelled rows
(``SAMPLE_ROWS``, the smallest hashes of the ids). All texts are scored, whole.
NULL and empty texts get the score of their feature values, all 0. A label that is
NULL is ignored; an id labelled several times counts once, with the mean label.
Without usable labels every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.llm.tokens import Texts, mixed, sliced, window_hashes, word_hashes, words

SAMPLE_ROWS = 20_000
KEEP_FROM = 0.3

FEATURES = (
    "words", "word_bytes", "upper", "symbols", "exclamations", "digits", "stops", "distinct",
    "repeats_previous", "line_words", "short_words", "repeated_triples", "non_ascii", "capitalised",
)

_BINS = 48
_PAIR_BINS = 12
_PAIRS = 6
_ROUNDS = 150
_RATE = 0.15
_PENALTY = 1.0


def _flags(chars: bytes | range) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


_UPPER, _LOWER = _flags(range(65, 91)), _flags(range(97, 123))
_SYMBOL, _DIGIT = _flags(b"#*$%&|<>"), _flags(b"0123456789")
_CAN_END, _HIGH = _flags(b".,;:?"), _flags(range(128, 256))
_LINE, _MARK = _flags(b"\n"), _flags(b"!")


def _distinct_per_row(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    own = mixed(hashes ^ mixed(row.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(own, return_index=True)
    return np.bincount(row[first], minlength=rows)


def features(rows: Texts) -> np.ndarray:
    """One line of feature values per text."""
    found = words(rows)
    n = np.diff(found.first)
    per_word = np.maximum(n, 1)
    size = np.maximum(np.diff(rows.at), 1)
    hashes = word_hashes(rows, found)
    length = found.end - found.start
    data, count = rows.data, rows.per_row
    upper = count(_UPPER[data])
    letters = np.maximum(upper + count(_LOWER[data]), 1)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (found.row[1:] == found.row[:-1])

    def by_word(flags: np.ndarray) -> np.ndarray:
        return np.bincount(found.row[flags], minlength=len(rows)) / per_word

    triples, at = window_hashes(found, hashes, 3)
    triple_row = found.row[at]
    n_triples = np.bincount(triple_row, minlength=len(rows))
    different = _distinct_per_row(triples, triple_row, len(rows))
    return np.column_stack(
        [
            np.log1p(n),
            np.bincount(found.row, weights=length, minlength=len(rows)) / per_word,
            upper / letters,
            count(_SYMBOL[data]) / per_word,
            count(_MARK[data]) / per_word,
            count(_DIGIT[data]) / size,
            count(_CAN_END[data]) / per_word,
            _distinct_per_row(hashes, found.row, len(rows)) / per_word,
            by_word(same),
            np.log1p(n / (count(_LINE[data]) + 1)),
            by_word(length <= 3),
            1 - different / np.maximum(n_triples, 1) * (n_triples > 0) - (n_triples == 0),
            count(_HIGH[data]) / size,
            by_word(_UPPER[data[found.start]]) if len(data) else np.zeros(len(rows)),
        ]
    ).reshape(len(rows), len(FEATURES))


@dataclass
class AdditiveModel:
    """Cut points and lookup tables per feature and per pair of features."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def scores(self, values: np.ndarray) -> np.ndarray:
        total = np.full(len(values), self.intercept)
        for i, table in enumerate(self.tables):
            total += table[_binned(self.cuts[i], values[:, i])]
        coarse = {i: _binned(self.pair_cuts[i], values[:, i]) for pair in self.pairs for i in pair}
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _binned(cuts: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.searchsorted(cuts, values, side="right")


def _cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="nearest"))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and position of the best split of ordered bins; 0 where none gains."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + _PENALTY) + right_g**2 / (right_h + _PENALTY)
    gain = gain - g.sum() ** 2 / (h.sum() + _PENALTY)
    if not len(gain) or gain.max() <= 1e-9:
        return 0.0, 0
    return float(gain.max()), int(gain.argmax()) + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values per bin of a tree of depth two over one feature."""
    step = np.zeros(len(g))
    _, middle = _best_cut(g, h)
    edges = {0, len(g)}
    if middle:
        edges.add(middle)
        for low, high in ((0, middle), (middle, len(g))):
            _, cut = _best_cut(g[low:high], h[low:high])
            edges.add(low + cut)
    ordered = sorted(edges)
    for low, high in zip(ordered, ordered[1:]):
        step[low:high] = g[low:high].sum() / (h[low:high].sum() + _PENALTY)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of a tree that cuts one feature, then the other on each side."""
    best, step = 0.0, np.zeros(g.shape)
    for axis in (0, 1):
        gt, ht = (g, h) if axis == 0 else (g.T, h.T)
        for cut in range(1, len(gt)):
            total, own = 0.0, np.zeros(gt.shape)
            for rows in (slice(0, cut), slice(cut, None)):
                sub_g, sub_h = gt[rows].sum(axis=0), ht[rows].sum(axis=0)
                _, at = _best_cut(sub_g, sub_h)
                for cols in (slice(0, at), slice(at, None)):
                    s, w = sub_g[cols].sum(), sub_h[cols].sum() + _PENALTY
                    total += s**2 / w
                    own[rows, cols] = s / w
            if total > best:
                best, step = total, own if axis == 0 else own.T
    return best, step


def fit(values: np.ndarray, labels: np.ndarray) -> AdditiveModel:
    """Boost the tables of single features, then those of the strongest pairs."""
    if not len(labels):
        return AdditiveModel()
    mean = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    model = AdditiveModel(intercept=float(np.log(mean / (1 - mean))))
    width = values.shape[1]
    model.cuts = [_cut_points(values[:, i], _BINS) for i in range(width)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    model.pair_cuts = [_cut_points(values[:, i], _PAIR_BINS) for i in range(width)]
    bins = [_binned(c, values[:, i]) for i, c in enumerate(model.cuts)]
    total = np.full(len(labels), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)

    for _ in range(_ROUNDS):
        for i in range(width):
            g, h = slopes()
            many = len(model.tables[i])
            step = _RATE * _tree(np.bincount(bins[i], g, many), np.bincount(bins[i], h, many))
            model.tables[i] += step
            total += step[bins[i]]

    coarse = [_binned(c, values[:, i]) for i, c in enumerate(model.pair_cuts)]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(model.pair_cuts[i]) + 1, len(model.pair_cuts[j]) + 1)
        cell = coarse[i] * shape[1] + coarse[j]
        g, h = slopes()
        size = shape[0] * shape[1]
        return cell, np.bincount(cell, g, size).reshape(shape), np.bincount(cell, h, size).reshape(shape)

    gains = {(i, j): _pair_tree(*sums(i, j)[1:])[0] for i in range(width) for j in range(i)}
    model.pairs = sorted(gains, key=lambda pair: (-gains[pair], pair))[:_PAIRS]
    model.pair_tables = [np.zeros(sums(i, j)[1].shape) for i, j in model.pairs]
    for _ in range(_ROUNDS // 5):
        for k, (i, j) in enumerate(model.pairs):
            cell, g, h = sums(i, j)
            step = _RATE * _pair_tree(g, h)[1]
            model.pair_tables[k] += step
            total += step.ravel()[cell]
    return model


def held_out(id_column: Column) -> Column:
    """True for the fifth of all ids that labels are never learned from."""
    return F.crc32(id_column.cast("string")) % 5 == 0


def _feature_lists(column: pa.Array) -> pa.Array:
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    lines = [features(rows) for _, rows in sliced([batch], "text")]
    flat = np.concatenate(lines) if lines else np.zeros((0, len(FEATURES)))
    ends = np.arange(len(flat) + 1, dtype=np.int32) * len(FEATURES)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> AdditiveModel:
    """Fit on at most ``sample_rows`` labelled rows outside the held-out fifth.

    An id that stands on many rows counts with each, as far as the bound allows: those
    with the smallest hashes of the id, then of the text.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
    known = known.filter("id IS NOT NULL AND label IS NOT NULL").filter(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.avg("label").alias("label"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    lists = F.arrow_udf(_feature_lists, "array<double>")
    # At most sample_rows rows of 16 bytes are broadcast, and as many come back.
    rows = (
        texts.join(F.broadcast(sample), "id")
        .select("id", "label", F.xxhash64("text").alias("version"), lists("text").alias("x"))
        .orderBy(F.xxhash64("id"), "id", "version")
        .limit(sample_rows)
        .collect()
    )
    rows.sort(key=lambda r: (r.id, r.x))
    x = np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r.label for r in rows]))


def score(model: AdditiveModel, text: Column) -> Column:
    """Probability that a text is good."""

    def scored(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        parts = [model.scores(features(rows)) for _, rows in sliced([batch], "text")]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    if not model.tables:
        return F.lit(0.5)
    return F.arrow_udf(scored, "double")(text.cast("string"))


def good_documents(
    docs: DataFrame, labels: DataFrame, text_col: str = "text", keep_from: float = KEEP_FROM
) -> DataFrame:
    """The documents the model does not reject, with their columns as they are."""
    model = train(docs, labels, text_col=text_col)
    return docs.filter(score(model, F.col(text_col)) >= keep_from)
