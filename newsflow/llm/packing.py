"""Operator 3: token ids packed into rows of one length.

Texts are tokenized whole with a byte-level BPE. Its pre-tokens never span the
start of white space, so each stretch of white space with the word after it has
ids of its own; every distinct stretch is tokenized once per task and the ids are
gathered by array indexing. A document ends with the end mark; one longer than a
row is split into pieces without loss.

Rows are filled best-fit decreasing: the longest piece first, into the row with
the least room that suffices, found in a segment tree over room sizes. Packing is
done in windows of ``WINDOW_TOKENS`` tokens of a task's own documents, so nothing
is shuffled and no task holds more than a window.

A result row has the ids and position ids (little-endian, two bytes where they
fit), which restart at each piece, the cumulative piece lengths, and document id
and first token of each piece. Free places at the end hold the end mark and lie
after the last cumulative length. A NULL or empty text is a document of one end
mark. Repeated rows are packed once each. NULL ids stay NULL.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm.tokens import Memo, Texts, Words, sliced, word_hashes, words

TOKENIZERS = "/opt/tokenizers"
ROW_TOKENS = 2048
WINDOW_TOKENS = 2_000_000

# Fixed value: how the vocabulary's texts are cut into pre-tokens.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

RESULT = (
    "n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>,"
    " doc_ids array<long>, piece_starts array<int>"
)


class ByteTokenizer:
    """Byte-level BPE whose ids of distinct stretches of text are kept for a task."""

    def __init__(self, folder: str = TOKENIZERS):
        import tiktoken

        with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("bytes", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self._start_over()

    def _start_over(self) -> None:
        self.known, self.flat = Memo(), np.zeros(0, np.int32)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, rows: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each with the end mark, and where each row begins."""
        found = words(rows)
        # Stretches: from the end of the word before, or of the row before, to the
        # end of the word; the white space at a row's end is one more.
        last = found.first[1:] - 1
        tail = np.where(np.diff(found.first) > 0, found.end[last] if len(found.end) else 0, rows.at[:-1])
        end = np.concatenate((found.end, rows.at[1:]))
        begin = np.concatenate(([0], found.end[:-1])) if len(found.end) else found.start
        begin = np.maximum(begin, rows.at[found.row])
        begin = np.concatenate((begin, tail))
        row = np.concatenate((found.row, np.arange(len(rows))))
        order = np.lexsort((end, row))
        begin, end, row = begin[order], end[order], row[order]
        hashes = word_hashes(rows, Words(begin, end, found.first, row))
        distinct, at = np.unique(hashes, return_index=True)
        if self.known.count + len(distinct) > self.known.most:
            self._start_over()
        new = self.known.missing(distinct)
        texts = [rows.data[begin[i] : end[i]].tobytes().decode("utf-8", "replace") for i in at[new]]
        coded = [self.encoding.encode_ordinary(text) for text in texts]
        size = np.array([len(c) for c in coded], np.int64)
        more = np.fromiter((i for c in coded for i in c), np.int32, int(size.sum()))
        self.first = np.concatenate((self.first, len(self.flat) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.flat = np.concatenate((self.flat, more, np.array([], np.int32)))
        self.known.add(distinct[new])
        number = self.known.numbers(hashes)
        size = self.size[number]
        total = np.concatenate(([0], np.cumsum(size)))
        take = np.repeat(self.first[number] - total[:-1], size) + np.arange(total[-1])
        ids = self.flat[take]
        ends = total[np.searchsorted(row, np.arange(len(rows)), side="right")]
        whole = np.insert(ids, ends, self.end)
        return whole, np.concatenate(([0], ends + 1 + np.arange(len(rows))))


class RoomTree:
    """Segment tree over room sizes: which sizes some open row has."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.any = np.zeros(2 * self.leaves, dtype=np.int64).tolist()
        self.rows: dict[int, list[int]] = {}

    def put(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        at = room + self.leaves
        while at:
            self.any[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return the row with the least room of at least ``least``."""
        at = least + self.leaves
        if not self.any[at]:
            while at > 1 and not (at % 2 == 0 and self.any[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at *= 2
                at += not self.any[at]
        room = at - self.leaves
        while at:
            self.any[at] -= 1
            at >>= 1
        return room, self.rows[room].pop()


def best_fit(sizes: list[int], row_tokens: int) -> list[list[int]]:
    """Pieces of each row, longest pieces placed first; no piece exceeds a row."""
    tree, rows = RoomTree(row_tokens), []
    for piece in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[piece])
        room, row = found if found else (row_tokens, len(rows))
        if not found:
            rows.append([])
        rows[row].append(piece)
        tree.put(room - sizes[piece], row)
    return rows


def _narrow(most: int) -> np.dtype:
    return np.dtype("<u2" if most < 1 << 16 else "<u4")


def _packed(pieces: list[tuple], row_tokens: int, end: int) -> pa.RecordBatch:
    """One window: pieces are (document id, first token, ids)."""
    rows = best_fit([len(p[2]) for p in pieces], row_tokens)
    id_kind, place_kind = _narrow(end), _narrow(row_tokens)
    columns: list[list] = [[], [], [], [], [], []]
    for members in rows:
        sizes = [len(pieces[m][2]) for m in members]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        ids = np.full(row_tokens, end, id_kind)
        ids[: ends[-1]] = np.concatenate([pieces[m][2] for m in members])
        places = np.zeros(row_tokens, place_kind)
        places[: ends[-1]] = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes)
        own = (int(ends[-1]), ids.tobytes(), places.tobytes(), ends.astype(np.int32),
               [pieces[m][0] for m in members], [pieces[m][1] for m in members])
        for column, value in zip(columns, own):
            column.append(value)
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = [part.split()[0] for part in RESULT.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _pack(batches: Iterator[pa.RecordBatch], folder: str, row_tokens: int, window: int) -> Iterator[pa.RecordBatch]:
    tokenizer = ByteTokenizer(folder)
    pieces: list[tuple] = []
    held = 0
    for batch, rows in sliced(batches, "text"):
        ids, at = tokenizer.ids(rows)
        for i, doc_id in enumerate(batch.column("id").to_pylist()):
            for start in range(at[i], at[i + 1], row_tokens):
                own = ids[start : min(start + row_tokens, at[i + 1])]
                pieces.append((doc_id, int(start - at[i]), own))
                held += len(own)
                if held >= window:
                    yield _packed(pieces, row_tokens, tokenizer.end)
                    pieces, held = [], 0
    if pieces:
        yield _packed(pieces, row_tokens, tokenizer.end)


def pack_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folder: str = TOKENIZERS,
    row_tokens: int = ROW_TOKENS,
    window_tokens: int = WINDOW_TOKENS,
) -> DataFrame:
    """Packed rows of all documents, see ``RESULT``."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pack = partial(_pack, folder=folder, row_tokens=row_tokens, window=window_tokens)
    return texts.mapInArrow(pack, RESULT)


def write_packed(rows: DataFrame, path: str) -> None:
    """Write packed rows; the id matrix of a file is its input_ids laid end to end."""
    rows.write.mode("overwrite").parquet(path)


def matrix(values: bytes, most: int) -> np.ndarray:
    """Numbers of an ``input_ids`` or ``position_ids`` value; ``most`` is the largest possible."""
    if sys.byteorder != "little":
        return np.frombuffer(values, _narrow(most)).astype(np.int64)
    return np.frombuffer(values, _narrow(most))
