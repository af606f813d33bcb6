"""Words and word hashes of whole Arrow text columns, computed with numpy.

A column's bytes are handled as one array, so a word costs a few vector
operations and never a Python object. Only whole texts are handled: a batch is
cut between rows, and a row longer than the cut is a batch of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words are runs of anything but the six ASCII white-space characters.
SPACES = b" \t\n\x0b\x0c\r"
_SLICE_BYTES = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SPACES)] = False
# One 64-bit number per byte value, from a fixed seed: hashes agree on all executors.
_BYTE_CODE = np.random.Generator(np.random.PCG64(20240115)).integers(
    1, 2**64 - 1, 256, dtype=np.uint64
)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_JOIN = np.uint64(0xD6E8FEB86659FD93)
_BLOCK = 1 << 16


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    full = np.full(_BLOCK + 1, base, dtype=np.uint64)
    full[0] = 1
    return np.cumprod(full)


_POWERS, _INVERSE_POWERS = _powers(_BASE), _powers(_BASE_INVERSE)


@dataclass(frozen=True)
class Texts:
    """The UTF-8 bytes of some rows, one after the other; row i is data[at[i]:at[i + 1]]."""

    data: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def raw(self, row: int) -> bytes:
        return self.data[self.at[row] : self.at[row + 1]].tobytes()

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each row are flagged."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.at[1:]] - total[self.at[:-1]]


def texts(column: pa.Array) -> Texts:
    """Texts of an Arrow string column; NULL counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(at) == 0:
        at = np.zeros(1, dtype=np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(body[at[0] : at[-1]], at - at[0])


def sliced(
    batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = _SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cut batches between rows so that their texts have about ``max_bytes``."""
    for batch in batches:
        whole = texts(batch.column(column))
        start = 0
        while start < len(whole):
            end = int(np.searchsorted(whole.at, whole.at[start] + max_bytes, "right")) - 1
            end = min(max(end, start + 1), len(whole))
            at = whole.at[start : end + 1]
            yield batch.slice(start, end - start), Texts(whole.data[at[0] : at[-1]], at - at[0])
            start = end


@dataclass(frozen=True)
class Words:
    """Byte positions of all words; row i has words[first[i]:first[i + 1]]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    row: np.ndarray


def words(rows: Texts, is_word: np.ndarray = _IS_WORD) -> Words:
    """Runs of word bytes; a run never spans two rows."""
    inside = is_word[rows.data]
    size = len(inside)
    before = np.concatenate(([False], inside[:-1])) if size else inside.copy()
    after = np.concatenate((inside[1:], [False])) if size else inside.copy()
    edges = rows.at[1:-1]
    before[edges[edges < size]] = False
    after[edges[edges > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, rows.at)
    return Words(start, end, first, np.repeat(np.arange(len(rows)), np.diff(first)))


def word_hashes(rows: Texts, found: Words, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands.

    Words come in order of place. Bytes are summed block by block, so that memory
    beyond the words' own does not grow with the texts.
    """
    hashes = np.zeros(len(found.start), np.uint64)
    inverse = np.empty(len(found.start), np.uint64)
    # Sum of the blocks before; what the block's first byte and its inverse are scaled by.
    before, scale, inverse_scale = np.uint64(0), 1, 1
    for low in range(0, len(rows.data) + 1, _BLOCK):
        part = rows.data[low : low + _BLOCK]
        terms = _BYTE_CODE[_LOWER[part] if lower else part] * _POWERS[: len(part)]
        total = np.concatenate(([before], terms * np.uint64(scale)))
        np.cumsum(total, out=total)
        first, last = np.searchsorted(found.end, (low, low + _BLOCK))
        hashes[first:last] += total[found.end[first:last] - low]
        first, last = np.searchsorted(found.start, (low, low + _BLOCK))
        place = found.start[first:last] - low
        hashes[first:last] -= total[place]
        inverse[first:last] = _INVERSE_POWERS[place] * np.uint64(inverse_scale)
        before = total[-1]
        scale = scale * int(_POWERS[_BLOCK]) % 2**64
        inverse_scale = inverse_scale * int(_INVERSE_POWERS[_BLOCK]) % 2**64
    return mixed(hashes * inverse + (found.end - found.start).astype(np.uint64))


def window_hashes(found: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word windows and the index of their first word."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = hashes[:count].copy()
    for shift in range(1, width):
        whole = whole * _JOIN + hashes[shift : shift + count]
    at = np.flatnonzero(found.row[:count] == found.row[width - 1 :])
    return mixed(whole[at]), at


def shingle_sets(rows: Texts, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``width``-word windows of each lower-cased row.

    A row with fewer words has its whole word sequence as one; one without words
    has an empty set.
    """
    found = words(rows)
    hashes = word_hashes(rows, found, lower=True)
    windows, at = window_hashes(found, hashes, width)
    first = np.searchsorted(at, found.first)
    sets = []
    for row in range(len(rows)):
        low, high = found.first[row], found.first[row + 1]
        if high - low >= width:
            sets.append(np.unique(windows[first[row] : first[row + 1]]))
        elif high > low:
            whole = hashes[low : low + 1]
            for word in hashes[low + 1 : high]:
                whole = whole * _JOIN + word
            sets.append(mixed(whole + np.uint64(high - low)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def column(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit numbers as Spark longs, bit for bit."""
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values)


class Memo:
    """Values of distinct byte strings met so far in a task, looked up by hash.

    Forgets everything once it holds ``most`` entries, so its memory is bounded.
    """

    def __init__(self, most: int = 400_000):
        self.most = most
        self.hashes = np.zeros(0, np.uint64)
        self.index = np.zeros(0, np.int64)
        self.count = 0

    def missing(self, distinct: np.ndarray) -> np.ndarray:
        """Positions of the hashes not known; drops what is known if it is too much."""
        if self.count + len(distinct) > self.most:
            self.hashes, self.index, self.count = self.hashes[:0], self.index[:0], 0
        if not self.count:
            return np.arange(len(distinct))
        at = np.minimum(np.searchsorted(self.hashes, distinct), self.count - 1)
        return np.flatnonzero(self.hashes[at] != distinct)

    def add(self, hashes: np.ndarray) -> None:
        """Number the new hashes in the given order, after those known."""
        together = np.concatenate((self.hashes, hashes))
        index = np.concatenate((self.index, self.count + np.arange(len(hashes))))
        order = np.argsort(together, kind="stable")
        self.hashes, self.index, self.count = together[order], index[order], len(together)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        return self.index[np.searchsorted(self.hashes, hashes)]
