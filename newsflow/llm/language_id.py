"""Operator 10: language identification by compression.

For each language a zstandard raw-content dictionary is made of sample documents.
A text is compressed with every dictionary, in chunks so that the dictionary keeps
its weight in long texts, and the language with the smallest total wins. Letters
are lower-cased (ASCII and Latin-1) and everything else in ASCII becomes a blank
on both sides, so case, markup and digits do not decide.

Dictionaries are made from at most ``SAMPLE_DOCS`` rows per language, those with the
smallest hashes of id and text, long texts before short ones, and one stretch of
``SAMPLE_CHARS`` characters of each, taken anywhere in the text by a hash. So at most
``SAMPLE_DOCS`` rows of a language reach the driver, whatever ids repeat; more than
``MOST_LANGUAGES`` languages are an error. All texts are then judged whole. Bytes that
are not UTF-8 are compressed as they are. ``score`` grows with the margin to the second
language, ``reliable`` is false where the margin is narrow. A NULL text, or one
without a letter, is ``und`` with score 0, and so is every text if no language
could be learned. Equal totals go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm.byte_bpe import column_type
from newsflow.llm.tokens import Texts, sliced
from newsflow.session import settled

UNKNOWN = "und"
SAMPLE_DOCS = 48
SAMPLE_CHARS = 2000
SHORT_CHARS = 200
MOST_LANGUAGES = 1000
REPETITIVE = 2.6  # a sample that compresses better says little about a language
CHUNK_BYTES = 2048
LEVEL = 6
NARROW = 0.01

_RESULT = "lang_pred string, score double, reliable boolean"

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def folded(rows: Texts) -> Texts:
    """Lower-case letters and blanks, byte for byte."""
    data = _FOLD[rows.data]
    latin = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    data[1:][latin] += 0x20
    return Texts(data, rows.at)


def _has_letter(rows: Texts, plain: Texts) -> np.ndarray:
    ascii_letters = plain.per_row((plain.data >= 97) & (plain.data < 123)) > 0
    for i in np.flatnonzero(~ascii_letters):
        ascii_letters[i] = any(c.isalpha() for c in rows.raw(i).decode("utf-8", "replace"))
    return ascii_letters


def _judge(batches: Iterator[pa.RecordBatch], samples: dict[str, bytes]) -> Iterator[pa.RecordBatch]:
    languages = sorted(samples)
    packers = []
    for name in languages:
        content = zstandard.ZstdCompressionDict(samples[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=LEVEL)
        packers.append(
            zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_dict_id=False)
        )
    for batch, rows in sliced(batches, "text"):
        plain = folded(rows)
        lettered = _has_letter(rows, plain)
        best, score, reliable = [], [], []
        for i in range(len(rows)):
            if not lettered[i] or not packers:
                best.append(UNKNOWN)
                score.append(0.0)
                reliable.append(False)
                continue
            text = plain.raw(i)
            chunks = [text[at : at + CHUNK_BYTES] for at in range(0, len(text), CHUNK_BYTES)]
            sizes = [sum(len(p.compress(c)) for c in chunks) for p in packers]
            first = int(np.argmin(sizes))
            second = min((s for k, s in enumerate(sizes) if k != first), default=len(text) + 16)
            margin = max(0.0, 1 - sizes[first] / second)
            best.append(languages[first])
            score.append(min(1.0, 0.5 + 5 * margin))
            reliable.append(margin >= NARROW)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(best, pa.string()), pa.array(score, pa.float64()),
             pa.array(reliable, pa.bool_())],
            ["id", "lang_pred", "score", "reliable"])


def held_out(id_column: Column) -> Column:
    """True for the quarter of all ids that languages are never learned from."""
    return F.crc32(id_column.cast("string")) % 4 == 2


def learn(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> dict[str, bytes]:
    """Dictionary content per language, from documents outside the held-out quarter."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
    )
    rows = rows.filter("lang IS NOT NULL AND id IS NOT NULL").filter(~held_out(F.col("id")))
    # Any stretch of a text may be its sample, the last one too, which is as long as the others.
    size = F.length("text")
    place = F.pmod(F.xxhash64(F.lit(1), "text"), F.greatest(size - SAMPLE_CHARS, F.lit(0)) + 1)
    stretch = F.substring("text", (place + 1).cast("int"), F.lit(SAMPLE_CHARS))
    # Longer texts first: they fill a dictionary with few documents.
    narrow = rows.filter(size > 0).select(
        "id", "lang", (size < SHORT_CHARS).alias("short"), F.xxhash64("text").alias("version"), stretch.alias("text"))
    order = Window.partitionBy("lang").orderBy("short", F.xxhash64("id"), "id", "version")
    chosen = narrow.withColumn("row", F.row_number().over(order)).filter(F.col("row") <= SAMPLE_DOCS)
    chosen = settled(chosen, "language-samples")
    if chosen.filter("row = 1").count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    found = chosen.select("lang", "id", "text").collect()
    samples: dict[str, list[bytes]] = {}
    for row in sorted(found, key=lambda r: (r.lang, r.id, r.text)):
        data = np.frombuffer(row.text.encode("utf-8", "replace"), np.uint8)
        plain = folded(Texts(data, np.array([0, len(data)]))).raw(0)
        samples.setdefault(row.lang, []).append(plain)
    packer = zstandard.ZstdCompressor(level=3)
    learned = {}
    for lang, parts in samples.items():
        telling = [p for p in parts if len(p) <= REPETITIVE * len(packer.compress(p))]
        content = b"\n".join(telling or parts)
        if len(content) >= 8:
            learned[lang] = content
    return learned


def identify(
    docs: DataFrame, samples: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Language, score and reliability of every document."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {column_type(docs, id_col)}, {_RESULT}"
    return texts.mapInArrow(partial(_judge, samples=samples), schema).withColumnRenamed("id", id_col)
