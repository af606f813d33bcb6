"""Operator 12: byte-level BPE encoding and decoding.

Texts are cut into pre-tokens by the tokenizer's pattern. The distinct pre-tokens of
a stretch of the corpus are then encoded together by replaying the merges: their
bytes lie one after the other, an inverted index holds the places of every pair that
has a merge, and the merges are applied in the order of their ranks, each at all its
places from left to right. A merge touches only its two neighbours, whose new pairs
enter the index. All pre-tokens of the text then take their ids from the distinct
ones, which a task keeps for the texts that follow.

A merged pair may form a pair of a lower rank than its own; that one is then merged
first, as it would be if the word were encoded alone. A pre-token that is a token
keeps its one id.

Decoding gathers the bytes of the ids. Encoding any valid text and decoding it gives
its bytes again. NULL and empty texts have no ids. Bytes that are not UTF-8 are read
as U+FFFD. An id outside the vocabulary, or NULL, decodes to no bytes. Repeated rows
give equal results; ids of documents keep their type.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator, Sequence
from functools import partial
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm.packing import TOKENIZERS
from newsflow.llm.tokens import sliced

RANKS = "byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's texts are cut into pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Distinct pre-tokens, and bytes of them, that a task keeps.
_MOST_KNOWN, _MOST_BYTES = 200_000, 8 << 20
# Bytes of text encoded, and ids decoded, at once.
_SLICE_BYTES, _SLICE_IDS = 6 << 20, 1 << 19
# A pair of tokens as one number. Above every rank, so a place without token makes no pair.
_RADIX = 1 << 24
# Up to so many places are merged one by one.
_FEW = 8


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens of a rank file: the bytes in base64, a blank, the rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def splitter(pattern: str = PATTERN):
    """Function that cuts a text into pre-tokens; white space is Unicode's property."""
    pattern = pattern.replace(r"[^\s", r"[^\p{White_Space}")
    pattern = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    return regex.compile(pattern).findall


class Merges:
    """The merges of a vocabulary: which token every two adjacent tokens make."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pairs: dict[int, int] = {}
        self.makers: dict[int, list[int]] = {}
        # Tokens that can make a pair of a lower rank than their own.
        self.unordered: set[int] = set()
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pair = left * _RADIX + right
                    self.pairs[pair] = rank
                    self.makers.setdefault(rank, []).append(pair)
                    self.unordered.update(part for part in (left, right) if part > rank)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self._pairs = np.sort(np.fromiter(self.pairs, np.int64, len(self.pairs)))
        self._made = np.array([self.pairs[p] for p in self._pairs.tolist()], np.int64)

    def made(self, pairs: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that pairs make, -1 where they make none."""
        if not len(self._pairs):
            return np.full(len(pairs), -1)
        at = np.minimum(np.searchsorted(self._pairs, pairs), len(self._pairs) - 1)
        return np.where(self._pairs[at] == pairs, self._made[at], -1)

    def replay(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each word has."""
        sizes = np.array([len(w) for w in words], np.int64)
        if not sizes.sum():
            return np.zeros(0, np.int32), sizes
        line = _Line(self, np.frombuffer(b"".join(words), np.uint8), sizes)
        line.merge_all()
        merged = line.tokens[:-1]
        ends, kept = np.cumsum(sizes), np.concatenate(([0], np.cumsum(merged >= 0)))
        return merged[merged >= 0].astype(np.int32), kept[ends] - kept[ends - sizes]


class _Line:
    """Words laid end to end, their places linked, and the index of their pairs.

    A place holds the token that begins there, -1 once it was merged into another.
    One more place, whose token makes no pair, stands beyond both ends of every word.
    """

    def __init__(self, merges: Merges, data: np.ndarray, sizes: np.ndarray):
        self.merges = merges
        beyond, ends = len(data), np.cumsum(sizes)
        self.tokens = np.append(merges.of_byte[data], -1)
        self.after, self.before = np.arange(1, beyond + 2), np.arange(-1, beyond)
        self.after[ends[sizes > 0] - 1] = beyond
        self.before[(ends - sizes)[sizes > 0]] = beyond
        self.index: dict[int, list[int]] = {}
        self.waiting: list[int] = []
        places = np.arange(beyond)
        self._enter(places, self.tokens[:-1] * _RADIX + self.tokens[self.after[:-1]])

    def _enter(self, places: np.ndarray, pairs: np.ndarray) -> None:
        """Put places whose pairs have a merge into the index."""
        ranks = self.merges.made(pairs)
        some = ranks >= 0
        for rank, place in zip(ranks[some].tolist(), places[some].tolist()):
            self._enter_one(rank, place)

    def _enter_one(self, rank: int, place: int) -> None:
        own = self.index.get(rank)
        if own is None:
            self.index[rank] = [place]
            heappush(self.waiting, rank)
        else:
            own.append(place)

    def merge_all(self) -> None:
        """Apply every merge in the order of the ranks."""
        while self.waiting:
            rank = heappop(self.waiting)
            places = self.index.pop(rank)
            if len(places) <= _FEW or not self._merge_together(rank, np.unique(places)):
                self._merge_one_by_one(rank, sorted(places))

    def _merge_together(self, rank: int, places: np.ndarray) -> bool:
        """Merge all places of a rank at once; false, and nothing done, if a lower rank would come up."""
        pairs = self.tokens[places] * _RADIX + self.tokens[self.after[places]]
        places = places[np.logical_or.reduce([pairs == own for own in self.merges.makers[rank]])]
        right = self.after[places]
        linked = right[:-1] == places[1:]
        if linked.any():
            # Of places that share a token, the first, third, ... are merged.
            number = np.arange(len(places))
            run = np.maximum.accumulate(np.where(np.append(True, ~linked), number, 0))
            places = places[(number - run) % 2 == 0]
            right = self.after[places]
        if not len(places):
            return True
        ahead = self.after[right]
        if rank in self.merges.unordered:
            beside = np.concatenate((
                rank * _RADIX + self.tokens[ahead], self.tokens[self.before[places]] * _RADIX + rank,
                [rank * _RADIX + rank]))
            new = self.merges.made(beside)
            if ((new >= 0) & (new < rank)).any():
                return False
        self.tokens[places], self.tokens[right] = rank, -1
        self.after[places], self.before[ahead] = ahead, places
        behind = self.before[places]
        self._enter(
            np.concatenate((places, behind)),
            np.concatenate((rank * _RADIX + self.tokens[ahead], self.tokens[behind] * _RADIX + rank)))
        return True

    def _merge_one_by_one(self, rank: int, places: list[int]) -> None:
        tokens, made = self.tokens, self.merges.pairs.get
        for done, place in enumerate(places, 1):
            right = int(self.after[place])
            if made(int(tokens[place]) * _RADIX + int(tokens[right])) != rank:
                continue
            tokens[place], tokens[right] = rank, -1
            ahead, behind = int(self.after[right]), int(self.before[place])
            self.after[place], self.before[ahead] = ahead, place
            lower = False
            for new, at in (
                (made(rank * _RADIX + int(tokens[ahead])), place),
                (made(int(tokens[behind]) * _RADIX + rank), behind),
            ):
                if new is not None:
                    self._enter_one(new, at)
                    lower = lower or new < rank
            if lower:
                # A lower rank came up: it goes first, the rest of this one waits.
                for other in places[done:]:
                    self._enter_one(rank, other)
                return


class _Numbers(dict):
    """Numbers of distinct pre-tokens in the order they are met."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Encoder:
    """Ids of whole texts, from distinct pre-tokens that are kept."""

    def __init__(self, path: str, pattern: str = PATTERN):
        self.merges, self.split = Merges(read_ranks(path)), splitter(pattern)
        self._start_over()

    def _start_over(self) -> None:
        self.numbers, self.bytes = _Numbers(), 0
        self.flat = np.zeros(0, np.int32)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Encode new distinct pre-tokens; those that are tokens need no merges."""
        coded = [w.encode("utf-8") for w in words]
        whole = np.array([self.merges.ranks.get(w, -1) for w in coded], np.int64)
        ids, counts = self.merges.replay([b"" if token >= 0 else w for w, token in zip(coded, whole)])
        size = np.where(whole >= 0, 1, counts)
        end = np.cumsum(size)
        flat = np.zeros(int(size.sum()), np.int32)
        single = np.zeros(len(flat), bool)
        single[(end - 1)[whole >= 0]] = True
        flat[single], flat[~single] = whole[whole >= 0], ids
        self.first = np.concatenate((self.first, len(self.flat) + end - size))
        self.size = np.concatenate((self.size, size))
        self.flat = np.concatenate((self.flat, flat))
        self.bytes += sum(map(len, coded))

    def ids(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text begins and ends."""
        if len(self.numbers) > _MOST_KNOWN or self.bytes > _MOST_BYTES:
            self._start_over()
        known, numbers, ends = len(self.numbers), array("q"), [0]
        for text in texts:
            numbers.extend(map(self.numbers.__getitem__, self.split(text)))
            ends.append(len(numbers))
        self._learn(list(self.numbers)[known:])
        which = np.frombuffer(numbers, np.int64) if numbers else np.zeros(0, np.int64)
        size = self.size[which]
        total = np.concatenate(([0], np.cumsum(size)))
        take = np.repeat(self.first[which] - total[:-1], size) + np.arange(total[-1])
        return self.flat[take], total[ends]


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(path, pattern)
    for batch, rows in sliced(batches, "text", _SLICE_BYTES):
        ids, at = encoder.ids([rows.raw(i).decode("utf-8", "replace") for i in range(len(rows))])
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
        yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tokens = {rank: token for token, rank in read_ranks(path).items()}
    ordered = [tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)]
    data = np.frombuffer(b"".join(ordered), np.uint8)
    # One more token without bytes stands for all ids outside the vocabulary.
    size = np.array([len(t) for t in ordered] + [0], np.int64)
    first = np.cumsum(size) - size
    for batch in _id_slices(batches):
        lists = batch.column("ids")
        counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = np.where((ids < 0) | (ids >= len(ordered)), len(ordered), ids)
        each = size[ids]
        total = np.concatenate(([0], np.cumsum(each)))
        body = data[np.repeat(first[ids] - total[:-1], each) + np.arange(total[-1])]
        at = total[np.concatenate(([0], np.cumsum(counts)))]
        offsets = pa.py_buffer(at.astype(np.int64).tobytes())
        decoded = pa.Array.from_buffers(pa.large_binary(), len(batch), [None, offsets, pa.py_buffer(body.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column("id"), lists, decoded.cast(pa.binary())], ["id", "ids", "decoded"])


def _id_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut batches between rows so that their lists have about ``_SLICE_IDS`` ids."""
    for batch in batches:
        counts = batch.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(counts), 0
        while start < len(batch):
            before = ends[start - 1] if start else 0
            end = max(int(np.searchsorted(ends, before + _SLICE_IDS, "right")), start + 1)
            yield batch.slice(start, end - start)
            start = end


def column_type(df: DataFrame, column: str) -> str:
    """Spark's name of the type of a column."""
    return df.select(F.col(column)).schema[0].dataType.simpleString()


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, pattern: str = PATTERN
) -> DataFrame:
    """``ids`` of every document."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    job = partial(_encode, path=f"{folder}/{RANKS}", pattern=pattern)
    return texts.mapInArrow(job, f"id {column_type(docs, id_col)}, ids array<int>").withColumnRenamed("id", id_col)


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", folder: str = TOKENIZERS) -> DataFrame:
    """``decoded`` bytes of every row of ids, beside the ids."""
    lists = coded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    job = partial(_decode, path=f"{folder}/{RANKS}")
    schema = f"id {column_type(coded, id_col)}, ids array<int>, decoded binary"
    return lists.mapInArrow(job, schema).withColumnsRenamed({"id": id_col, "ids": ids_col})
