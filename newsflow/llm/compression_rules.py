"""Operator 4: quality rules with compression bands.

The base rules count words, symbols, repeated lines and repeated eight-word
windows. The method then compresses the whole text, and each of its fixed chunks,
with zstandard: a ratio of raw to compressed size above the band of its length
means repetitive text, one below it incompressible text. A text is rejected when
the whole is outside its band, or when chunks outside theirs hold more than
``BAD_SHARE`` of its bytes. Bands are wider for short texts, whose ratio says
little. Random hexadecimal digits compress as prose does (about 1.9), so no band of
ratios tells them from it.

A NULL text has no words, so its base rules fail. Repeated rows give equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm.tokens import SPACES, Texts, mixed, sliced, window_hashes, word_hashes, words

CHUNK_BYTES = 4096
BAD_SHARE = 0.2
# From this many bytes on: least and greatest ratio of raw to compressed size. The least
# lie between random base64 (measured 1.18, 1.25, 1.31, 1.32 and 1.33 at the upper end of
# each) and the least of all documents labelled good (1.24, 1.45, 1.66, 1.95 and 2.27).
BANDS = (
    (0, 0.0, 4.0), (256, 1.2, 3.0), (512, 1.33, 3.0), (1024, 1.45, 3.2), (4096, 1.6, 3.6), (16384, 1.7, 4.0))

RESULT = (
    "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, ratio double, bad_chunk_share double, base_failed boolean, kept boolean"
)

_WINDOW = 8
_LEAST_WORDS = 20
_MOST_REPEATED = 30  # per cent of the words

_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACES)] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def repeated_lines(text: bytes) -> int:
    """Lines that hold a word and equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def repeated_words(rows: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Per row: number of words, and of words inside windows that occur more than once."""
    found = words(rows)
    windows, at = window_hashes(found, word_hashes(rows, found), _WINDOW)
    own = mixed(windows ^ mixed(found.row[at].astype(np.uint64) + np.uint64(1)))
    _, inverse, counts = np.unique(own, return_inverse=True, return_counts=True)
    at = at[counts[inverse] > 1]
    cover = np.zeros(len(found.start) + 1, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + _WINDOW, -1)
    inside = np.cumsum(cover)[:-1] > 0
    return np.diff(found.first), np.bincount(found.row[inside], minlength=len(rows))


def in_band(raw: int, packed: int) -> bool:
    """Whether a text's compression ratio suits its length."""
    low, high = next((low, high) for size, low, high in reversed(BANDS) if raw >= size)
    return low * packed <= raw <= high * packed


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    for batch, rows in sliced(batches, "text"):
        n_words, n_repeat = repeated_words(rows)
        symbols = rows.per_row(_SYMBOL[rows.data])
        chars = rows.per_row(((rows.data & 0xC0) != 0x80) & ~_SPACE[rows.data])
        lines, ratio, share, whole_ok = [], [], [], []
        for i in range(len(rows)):
            text = rows.raw(i)
            lines.append(repeated_lines(text))
            packed = len(packer.compress(text))
            bad = 0
            for start in range(0, len(text), CHUNK_BYTES) if len(text) > CHUNK_BYTES else ():
                chunk = text[start : start + CHUNK_BYTES]
                bad += 0 if in_band(len(chunk), len(packer.compress(chunk))) else len(chunk)
            ratio.append(len(text) / packed)
            share.append(bad / max(len(text), 1))
            whole_ok.append(in_band(len(text), packed))
        failed = (n_words < _LEAST_WORDS) | (100 * n_repeat > _MOST_REPEATED * n_words)
        kept = ~failed & np.array(whole_ok, bool) & (np.array(share) <= BAD_SHARE)
        columns = [n_words, chars, symbols, np.array(lines, np.int64), n_repeat, np.array(ratio, float),
                   np.array(share, float), failed, kept]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *map(pa.array, columns)],
            ["id", *(part.split()[0] for part in RESULT.split(",")[1:])])


def compression_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, compression ratios and verdict of every document."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_rules, RESULT).withColumnRenamed("id", id_col)
