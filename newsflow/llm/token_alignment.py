"""Operator 13: which tokens of two tokenizers cover the same bytes.

A is a byte-level BPE, B a sentence-piece BPE that puts a space before the text; both
therefore tokenize a space and the text. Byte offsets at which a token of A and one
of B both end cut the tokens into groups, the smallest stretches both cover with
whole tokens. They are found by interval coalescing: all tokens of A and B are sorted
by start, the running maximum of their ends is kept, and a group begins where a start
reaches the maximum of all ends before it. Within a group, the tokens that overlap are
expanded from two binary searches per token.

Neither tokenizer has a token that goes on past a space after a visible character, so a
text is cut there and every distinct stretch is tokenized and aligned once per task;
texts are put together from their stretches.

A link is a pair of tokens, one of A and one of B, that end at the same byte: exactly
one per group. (Pairs that merely overlap are counted in ``n_overlaps``.) The count of
a pair of ids is the number of links with it in all documents. Of two tokens that end
together one is a suffix of the other, so the pairs that can occur are bounded by the
lengths of all tokens, some 500,000 for the given vocabularies, however large the
corpus is: the counts are sent to all tasks that judge the links. Counting and judging
both read the links, so what is kept of the alignments is written to the shared folder
first (:func:`newsflow.session.settled`) and texts are tokenized once.

Texts that are NULL or empty, and those that the tokens do not spell out byte by byte
(U+2581, which B reads as a space, or invalid UTF-8), have no tokens. Special tokens in a
text are plain text. Repeated rows count once each. Ids of documents keep their type.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm.byte_bpe import column_type
from newsflow.llm.packing import TOKENIZERS
from newsflow.llm.tokens import Memo, Texts, Words, sliced, word_hashes
from newsflow.session import settled

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
MARK = "▁"
_MOST_KNOWN = 150_000
_SLICE_BYTES = 1 << 20
# Stretches tokenized in one call, as one text.
_AT_ONCE = 1000
# A pair of ids as one number below 2 ** 32.
_B_BITS = 15
# Characters after which a space may cut: visible ASCII, and À-ÿ in UTF-8 but × and ÷.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False

_ALIGNED = "n_a long, n_b long, n_groups long, n_overlaps long, groups string, links binary"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Visible Latin-1 characters stand for themselves, the others for the characters
    from U+0100 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(moved)}


@dataclass(frozen=True)
class Vocabulary:
    """Bytes of all tokens; token i is data[first[i]:first[i] + size[i]]."""

    data: np.ndarray
    first: np.ndarray
    size: np.ndarray

    @staticmethod
    def of(tokens: list[bytes]) -> Vocabulary:
        size = np.array([len(t) for t in tokens], np.int64)
        return Vocabulary(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the tokens, one after the other."""
        size = self.size[ids]
        total = np.concatenate(([0], np.cumsum(size)))
        return self.data[np.repeat(self.first[ids] - total[:-1], size) + np.arange(total[-1])]


class ByteLevel:
    """Tokenizer A: a byte-level BPE file."""

    def __init__(self, folder: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(f"{folder}/{A_FILE}")
        self.model.encode_special_tokens = True
        letters = byte_letters()
        special = {i: token.content.encode() for i, token in self.model.get_added_tokens_decoder().items()}
        entries = {
            i: special[i] if i in special else bytes(letters[c] for c in entry)
            for entry, i in self.model.get_vocab(with_added_tokens=True).items()
        }
        self.vocabulary = Vocabulary.of([entries.get(i, b"") for i in range(max(entries) + 1)])

    def encode(self, text: str) -> list[int]:
        """Ids of a text that begins with its space."""
        return self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids


class Pieces:
    """Tokenizer B: a sentence-piece model, which puts a space before each text."""

    def __init__(self, folder: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{B_FILE}")
        entries = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            entries.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(MARK, " ").encode())
        self.vocabulary = Vocabulary.of(entries)

    def encode(self, text: str) -> list[int]:
        """Ids of a text that begins with a space, which the model puts there itself."""
        return self.model.encode(text[1:])


def stretches(rows: Texts) -> Words:
    """Where texts may be cut; the space a stretch begins with is left out of it.

    A space cuts if a visible character stands before it and something follows it.
    """
    data = rows.data
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(rows) + 1, np.int64), none)
    seen = _VISIBLE[data]
    seen[1:] |= _LATIN[data[1:]] & (data[:-1] == 0xC3)
    cut = np.zeros(len(data), bool)
    cut[1:] = (data[1:] == 0x20) & seen[:-1]
    cut[rows.at[:-1][rows.at[:-1] < len(data)]] = False
    cut[rows.at[1:][rows.at[1:] > 0] - 1] = False
    cuts = np.flatnonzero(cut)
    filled = np.diff(rows.at) > 0
    begin = np.sort(np.concatenate((rows.at[:-1][filled], cuts + 1)))
    end = np.sort(np.concatenate((rows.at[1:][filled], cuts)))
    first = np.searchsorted(begin, rows.at)
    return Words(begin, end, first, np.repeat(np.arange(len(rows)), np.diff(first)))


@dataclass(frozen=True)
class Coalesced:
    """Tokens of A and B over one line of bytes: the group of each, overlaps of each A token."""

    a_group: np.ndarray
    b_group: np.ndarray
    overlaps: np.ndarray
    groups: int


def coalesce(a_size: np.ndarray, b_size: np.ndarray) -> Coalesced:
    """Group two tokenizations of the same bytes, given the lengths of their tokens.

    No length is 0 and both cover all bytes.
    """
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    a_start, b_start = a_end - a_size, b_end - b_size
    start, end = np.concatenate((a_start, b_start)), np.concatenate((a_end, b_end))
    of_b = np.repeat([0, 1], [len(a_size), len(b_size)])
    order = np.lexsort((of_b, start))
    start, end = start[order], end[order]
    reached = np.maximum.accumulate(end)
    begins = np.ones(len(start), bool)
    begins[1:] = start[1:] >= reached[:-1]
    group = np.empty(len(start), np.int64)
    group[order] = np.cumsum(begins) - 1
    overlaps = np.searchsorted(b_start, a_end, "left") - np.searchsorted(b_end, a_start, "right")
    return Coalesced(group[: len(a_size)], group[len(a_size) :], overlaps, int(begins.sum()))


def tokenize(side: ByteLevel | Pieces, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all stretches, how many each has, and which are spelled out byte by byte.

    A stretch begins with a space. Many are tokenized in one call, laid end to end, as
    long as each ends with a visible character; the ends of their tokens tell them apart.
    Where that fails, the stretches of the call are tokenized one by one.
    """
    ids, counts, valid = [], [], []
    for start in range(0, len(stretches), _AT_ONCE):
        some = stretches[start : start + _AT_ONCE]
        whole = b"".join(some)
        own = np.array(side.encode(whole.decode("utf-8", "replace")), np.int64)
        ends = np.cumsum([len(s) for s in some])
        token_ends = np.cumsum(side.vocabulary.size[own])
        at = np.searchsorted(token_ends, ends)
        if side.vocabulary.spelled(own).tobytes() == whole and (token_ends[np.minimum(at, len(own) - 1)] == ends).all():
            ids.append(own)
            counts.append(np.diff(at + 1, prepend=0))
            valid.append(np.ones(len(some), bool))
            continue
        each = [np.array(side.encode(s.decode("utf-8", "replace")), np.int64) for s in some]
        right = [side.vocabulary.spelled(one).tobytes() == s for one, s in zip(each, some)]
        ids.extend(one for one, good in zip(each, right) if good)
        counts.append(np.array([len(one) if good else 0 for one, good in zip(each, right)], np.int64))
        valid.append(np.array(right, bool))
    if not ids:
        ids = [np.zeros(0, np.int64)]
    return np.concatenate(ids), np.concatenate(counts), np.concatenate(valid)


def _joinable(stretch: bytes) -> bool:
    """Whether what follows cannot change how the stretch is tokenized."""
    return bool(_VISIBLE[stretch[-1]]) or (stretch[-2] == 0xC3 and bool(_LATIN[stretch[-1]]))


class Aligner:
    """Alignments of distinct stretches, kept for a task."""

    def __init__(self, folder: str):
        self.a, self.b = ByteLevel(folder), Pieces(folder)
        self.numerals = [str(i) for i in range(max(len(self.a.vocabulary.size), len(self.b.vocabulary.size)))]
        self.start_over()

    def start_over(self) -> None:
        self.known = Memo(_MOST_KNOWN)
        # Per stretch: valid, n_a, n_b, groups, overlaps.
        self.facts = np.zeros((0, 5), np.int64)
        self.texts: list[str] = []
        self.links, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def learn(self, stretches: list[bytes]) -> None:
        """Tokenize and align new distinct stretches, in the order given."""
        # Those that may be laid end to end come first.
        order = sorted(range(len(stretches)), key=lambda i: not _joinable(stretches[i]))
        plain = sum(map(_joinable, stretches))
        ordered = [stretches[i] for i in order]
        sides = []
        for side in (self.a, self.b):
            parts = [tokenize(side, ordered[:plain]) if plain else None]
            parts += [tokenize(side, [one]) for one in ordered[plain:]]
            sides.append([np.concatenate(column) for column in zip(*[p for p in parts if p is not None])])
        (a, a_count, a_valid), (b, b_count, b_valid) = sides
        valid = a_valid & b_valid
        a, b = a[np.repeat(valid, a_count)], b[np.repeat(valid, b_count)]
        a_count, b_count = a_count * valid, b_count * valid
        found = coalesce(self.a.vocabulary.size[a], self.b.vocabulary.size[b])
        a_last = np.flatnonzero(np.diff(found.a_group, append=found.groups))
        b_last = np.flatnonzero(np.diff(found.b_group, append=found.groups))
        owner = np.repeat(np.arange(len(stretches)), a_count)
        groups = np.bincount(owner[a_last], minlength=len(stretches))
        overlaps = np.bincount(owner, found.overlaps, len(stretches)).astype(np.int64)
        links = (a[a_last] << _B_BITS | b[b_last]).astype(np.uint32)
        texts = self._written(a, b, a_last, b_last, groups)

        # Back to the order given.
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.facts = np.concatenate((self.facts, np.stack([valid, a_count, b_count, groups, overlaps], 1)[place]))
        self.texts += [texts[i] for i in place.tolist()]
        self.links = np.concatenate((self.links, _gathered(links, np.cumsum(groups) - groups, groups, place)))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(groups[place])))

    def _written(self, a, b, a_last, b_last, groups) -> list[str]:
        """The groups of each stretch, ``a1,a2|b1;a3|b2,b3``."""
        numeral = self.numerals.__getitem__
        a_lasts, b_lasts = a_last.tolist(), b_last.tolist()
        # Most groups are one token each; the others are written from slices.
        parts = list(map("%s|%s".__mod__, zip(map(numeral, a[a_last].tolist()), map(numeral, b[b_last].tolist()))))
        more = np.flatnonzero((np.diff(a_last, prepend=-1) > 1) | (np.diff(b_last, prepend=-1) > 1)).tolist()
        a, b = list(map(numeral, a.tolist())), list(map(numeral, b.tolist()))
        for n in more:
            i, j = (a_lasts[n - 1] + 1, b_lasts[n - 1] + 1) if n else (0, 0)
            parts[n] = ",".join(a[i : a_lasts[n] + 1]) + "|" + ",".join(b[j : b_lasts[n] + 1])
        ends = np.cumsum(groups).tolist()
        return [";".join(parts[low:high]) for low, high in zip([0, *ends], ends)]

    def numbers(self, rows: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of each stretch, first stretch of each row, and whether the row has tokens."""
        found = stretches(rows)
        hashes = word_hashes(rows, found)
        distinct, at = np.unique(hashes, return_index=True)
        if self.known.count and self.known.count + len(distinct) > self.known.most:
            self.start_over()
        new = self.known.missing(distinct)
        if len(new):
            self.learn([b" " + rows.data[found.start[i] : found.end[i]].tobytes() for i in at[new]])
            self.known.add(distinct[new])
        which = self.known.numbers(hashes) if len(hashes) else np.zeros(0, np.int64)
        wrong = np.concatenate(([0], np.cumsum(self.facts[which, 0] == 0)))
        right = wrong[found.first[1:]] == wrong[found.first[:-1]]
        return which, found.first, right & (np.diff(found.first) > 0)


def _gathered(values: np.ndarray, first: np.ndarray, size: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Runs of values, those of ``take`` one after the other."""
    own = size[take]
    total = np.cumsum(own)
    return values[np.repeat(first[take] - (total - own), own) + np.arange(total[-1] if len(total) else 0)]


def _align(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    aligner = Aligner(folder)
    names = ["id"] + [part.split()[0] for part in _ALIGNED.split(", ")]
    for batch, rows in sliced(batches, "text", _SLICE_BYTES):
        which, first, right = aligner.numbers(rows)
        facts = np.concatenate((np.zeros((1, 5), np.int64), np.cumsum(aligner.facts[which], 0)))
        facts = np.where(right[:, None], facts[first[1:]] - facts[first[:-1]], 0)
        _, n_a, n_b, n_groups, overlaps = facts.T
        taken = which[np.repeat(right, np.diff(first))]
        links = _gathered(aligner.links, aligner.first[:-1], np.diff(aligner.first), taken).astype("<u4").tobytes()
        ends = 4 * np.cumsum(n_groups)
        packed = [links[low:high] for low, high in zip([0, *ends.tolist()], ends.tolist())]
        which, groups = which.tolist(), []
        for good, low, high in zip(right.tolist(), first[:-1].tolist(), first[1:].tolist()):
            groups.append(";".join([aligner.texts[n] for n in which[low:high]]) if good else "")
        columns = [pa.array(c) for c in (n_a, n_b, n_groups, overlaps)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *columns, pa.array(groups, pa.string()), pa.array(packed, pa.binary())], names)


def _packed_links(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches with the links of all rows, and where each row's begin and end."""
    for batch, rows in sliced(batches, "links", _SLICE_BYTES):
        yield batch, np.frombuffer(rows.data.tobytes(), "<u4").astype(np.int64), rows.at // 4


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, links, _ in _packed_links(batches):
        pairs, counts = np.unique(links, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts.astype(np.int64))], ["pair", "links"])


def _judge(
    batches: Iterator[pa.RecordBatch], table: tuple[np.ndarray, np.ndarray, np.ndarray]
) -> Iterator[pa.RecordBatch]:
    pairs, counts, best = table
    for batch, links, at in _packed_links(batches):
        place = np.minimum(np.searchsorted(pairs, links), max(len(pairs) - 1, 0))
        hit = pairs[place] == links if len(pairs) else np.zeros(0, bool)
        sums = []
        for values in (best, counts):
            total = np.concatenate(([0], np.cumsum(np.where(hit, values[place], 0) if len(pairs) else links)))
            sums.append(pa.array(total[at[1:]] - total[at[:-1]], pa.int64()))
        kept = [batch.column(n) for n in batch.schema.names if n != "links"]
        names = [n for n in batch.schema.names if n != "links"]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(at)), *sums], [*names, "n_links", "n_best", "count_sum"])


def align(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS
) -> DataFrame:
    """Groups and links of every document; lazy, so settle what is kept of it.

    ``links`` holds the pairs packed as little-endian numbers of four bytes, the id of
    A times 2 ** 15 plus that of B.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.mapInArrow(partial(_align, folder=folder), f"id {column_type(docs, id_col)}, {_ALIGNED}")
    return found.withColumnRenamed("id", id_col)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """All linked pairs of ids: a_id, b_id, count, and whether no pair of the B id has more."""
    found = aligned.select("links").mapInArrow(_count, "pair long, links long")
    total = found.groupBy("pair").agg(F.sum("links").alias("count"))
    total = settled(total, "token-pairs").select(
        F.shiftright("pair", _B_BITS).cast("int").alias("a_id"),
        F.col("pair").bitwiseAND((1 << _B_BITS) - 1).cast("int").alias("b_id"), "count")
    most = total.groupBy("b_id").agg(F.max("count").alias("most"))
    return total.join(most, "b_id").select("a_id", "b_id", "count", (F.col("count") == F.col("most")).alias("best"))


def judge(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Alignments with n_links, n_best and count_sum instead of the packed links."""
    rows = counts.select("a_id", "b_id", "count", "best").toArrow()
    pairs = rows["a_id"].to_numpy().astype(np.int64) << _B_BITS | rows["b_id"].to_numpy().astype(np.int64)
    order = np.argsort(pairs)
    table = (pairs[order], rows["count"].to_numpy()[order], rows["best"].to_numpy()[order].astype(np.int64))
    kept = [c for c in aligned.columns if c != "links"]
    schema = ", ".join(f"`{c}` {column_type(aligned, c)}" for c in kept)
    return aligned.mapInArrow(partial(_judge, table=table), f"{schema}, n_links long, n_best long, count_sum long")
