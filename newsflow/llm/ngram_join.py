"""Operator 1: near-duplicate join on word n-grams with count-vector R-trees.

Two texts link when the Jaccard similarity of their shingle sets reaches the
threshold. The search is exact but for events as rare as a clash of 64-bit hashes.

1. Every set is fingerprinted; equal sets become one representative.
2. Representatives meet in buckets. A bucket is a shingle that is among the
   first ``n - ceil(t n) + 4`` of a set in one order common to all sets. A linked
   pair shares at least four such shingles (or all, for tiny sets), and larger sets
   many more, see :func:`_shared_least`; a set that meets others in fewer is linked
   with nothing. Shingles that many documents share come last in the order, so a
   common passage makes no bucket.
3. Each representative goes, with its text, to one bucket at first. There the
   shingles are hashed into groups, the group counts are the points of an R-tree,
   and a box is left out when the sum of the coordinate minima of its upper corner
   and the query point is less than the overlap a link needs. Surviving pairs are
   verified on the whole sets, unless known links connect them already.
4. Buckets that still hold unconnected documents that never met are worked off:
   first by another single bucket each in the same way, then all that is left, large
   buckets as pairs of blocks. There only count vectors are sent, and the pairs that
   the tree leaves over are verified on the texts.

Between the steps only narrow tables move. The R-tree alone would be quadratic:
in the few dimensions that can prune a whole box, independent texts of one length
lie closer together than the threshold. The buckets are what makes it scale.

Rows with a NULL or empty text, or without words, have an empty set and link with
nothing. Rows with a NULL id link with nothing. Repeated rows are copies of each
other; different texts under one id are linked each for itself. Bytes that are not
UTF-8 belong to words. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm.graph import components
from newsflow.llm.tokens import column, mixed, shingle_sets, sliced
from newsflow.session import scratch, settled

_MISS = 1e-15
_SHARED = 4  # prefix shingles a linked pair shares at least, set size permitting
_COMMON_LEAST = 64  # a shingle in fewer sets is never ordered last
_COMMON_SHARE = 1000  # ordered last: in more than one of this many sets
_BLOCK_ROWS = 4096
_BLOCK_SHINGLES = 2_000_000
_LEAF = 16
_POINTS = 8_000_000  # most coordinates of one tree

_SKETCH = "id long, version long, n long, high long, low long, common boolean"
_KEYS = "id long, n long, high long, low long, need long, keys array<long>"
_EDGES = "a long, b long"


def _least_overlap(n: np.ndarray | int, num: int, den: int):
    """ceil(n * num / den): what a set of n must share with any set it links with."""
    return -(-n * num // den)


def _shared_least(n: int, common: int, num: int, den: int) -> int:
    """Prefix shingles a set of n, ``common`` of them ordered last, shares with any link.

    Certain are ``_SHARED``. The order of the others is a hash's, so a prefix is a
    random sample, and by Hoeffding's bound a link shares fewer than the larger
    number below with probability under ``_MISS``, as rare as a clash of hashes.
    The partner may be smaller and have as many common shingles in the overlap.
    """
    smaller = _least_overlap(n, num, den)
    least = _least_overlap(smaller, num, den)
    certain = min(_SHARED, least)
    prefix = smaller - least + certain
    overlap, rest = least - common, smaller - common
    if overlap <= certain:
        return certain
    sampled = prefix * overlap / rest - math.sqrt(-math.log(_MISS) / 2 * prefix)
    return max(certain, min(overlap, int(sampled)))


def _sets(batches, width) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch, rows in sliced(batches, "text"):
        yield batch, shingle_sets(rows, width)


def _sketch(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Size and fingerprint of each set, and the shingles that repeat among some thousand rows."""
    names = ["id", "version", "n", "high", "low", "common"]
    seen: list[np.ndarray] = []

    def repeated() -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(seen), return_counts=True)
        often = counts >= max(4, len(seen) // _COMMON_SHARE)
        keys, counts = keys[often], counts[often]
        nothing = np.zeros(len(keys), np.int64)
        return pa.RecordBatch.from_arrays(
            [*[pa.nulls(len(keys), pa.int64())] * 2, pa.array(counts), column(keys), pa.array(nothing),
             pa.array(nothing == 0)], names)

    for batch, sets in _sets(batches, width):
        high = np.array([mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64)
        low = np.array([mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64)
        n = np.array([len(s) for s in sets], np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("version"), pa.array(n), column(high), column(low), pa.array(n < 0)], names)
        seen += sets
        if len(seen) >= 4096 or sum(map(len, seen)) >= _BLOCK_SHINGLES:
            yield repeated()
            seen.clear()
    if seen:
        yield repeated()


def _prefixes(
    batches: Iterator[pa.RecordBatch], width: int, num: int, den: int, last: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """The bucket keys of each set: its first shingles, common ones last."""
    for batch, sets in _sets(batches, width):
        keys, need = [], []
        for s in sets:
            least = _least_overlap(len(s), num, den)
            wanted, common = len(s) - least + min(_SHARED, least), 0
            if len(last) and len(s):
                at = np.searchsorted(last, s)
                is_last = last[np.minimum(at, len(last) - 1)] == s
                common = int(is_last.sum())
                s = np.concatenate((s[~is_last], s[is_last]))
            keys.append(s[:wanted])
            need.append(_shared_least(len(s), common, num, den))
        high = np.array([mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64)
        low = np.array([mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64)
        ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), column(np.concatenate(keys)))
        n = pa.array([len(s) for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), n, column(high), column(low), pa.array(need, pa.int64()), lists],
            ["id", "n", "high", "low", "need", "keys"])


def group_counts(s: np.ndarray, groups: int) -> np.ndarray:
    """How many shingles of a set fall into each of ``groups`` (a power of two) hash groups."""
    return np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def _groups_of(n: int) -> int:
    """Groups of the count vector that stands for a set of n shingles.

    Small sets get about two groups a shingle, large ones one: there the bound is
    tight enough with less. Sets that link differ by one doubling at most.
    """
    n = int(n)
    return 1 << max(5, min(16, (n if n <= 512 else n // 2).bit_length()))


class CountTree:
    """R-tree over count vectors: shingles hashed into groups, counted per group."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = self._packed(points, sizes)
        self.points, self.sizes = points[self.order], sizes[self.order]
        # Levels from the leaves up: upper corners, size ranges, last point of each box.
        self.levels = []
        low, high, corner = self.sizes, self.sizes, self.points
        last = np.arange(len(sizes))
        while len(last) > 1:
            first = np.arange(0, len(last), _LEAF)
            corner = np.maximum.reduceat(corner, first, axis=0)
            low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            last = np.maximum.reduceat(last, first)
            self.levels.append((corner, low, high, last))

    @classmethod
    def of_sets(cls, sets: list[np.ndarray]) -> CountTree:
        sizes = np.array([len(s) for s in sets], np.int64)
        most = max(16, min(2 * int(sizes.max()), _POINTS // len(sets)))
        groups = 1 << (most.bit_length() - 1)
        points = np.empty((len(sets), groups), np.uint16 if sizes.max() < 2**16 else np.uint32)
        for i, s in enumerate(sets):
            points[i] = group_counts(s, groups)
        return cls(points, sizes)

    @staticmethod
    def _packed(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Bulk-loading order: halve by size or by the group that varies most, down to leaves."""
        order, todo = [], [np.argsort(sizes, kind="stable")]
        while todo:
            part = todo.pop()
            if len(part) <= _LEAF:
                order.append(part)
                continue
            own = points[part]
            spread = own.max(axis=0).astype(np.int64) - own.min(axis=0)
            axis = int(spread.argmax())
            by = sizes[part] if np.ptp(sizes[part]) > spread[axis] else own[:, axis]
            part = part[np.argsort(by, kind="stable")]
            todo += [part[len(part) // 2 :], part[: len(part) // 2]]
        return np.concatenate(order)

    def later(self, i: int, num: int, den: int) -> np.ndarray:
        """Points after the i-th whose bounded overlap allows a link with it."""
        point, size = self.points[i], int(self.sizes[i])

        def open_(corner, low, high, last, among):
            among = among[(last[among] > i) & (high[among] * den >= size * num) & (low[among] * num <= size * den)]
            if not len(among):
                return among
            bound = np.minimum(corner[among], point).sum(axis=1, dtype=np.int64)
            fewest = np.maximum(low[among], _least_overlap(size, num, den))
            return among[bound * (num + den) >= num * (size + fewest)]

        if not self.levels:
            return np.zeros(0, np.int64)
        boxes = np.arange(len(self.levels[-1][0]))
        below = [len(self.points), *(len(level[0]) for level in self.levels)]
        for depth in reversed(range(len(self.levels))):
            boxes = open_(*self.levels[depth], boxes)
            boxes = (boxes[:, None] * _LEAF + np.arange(_LEAF)).ravel()
            boxes = boxes[boxes < below[depth]]
        return open_(self.points, self.sizes, self.sizes, np.arange(len(self.sizes)), boxes)


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def linked(sets: list[np.ndarray], labels: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of positions that link and connect sets not connected before.

    ``labels`` are known components; together with them the pairs returned
    connect exactly what all links among the sets connect.
    """
    if len(sets) < 2:
        return []
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    known: dict[int, int] = {}
    for i, label in enumerate(labels):
        root[i] = find(known.setdefault(label, i))
    tree, found = CountTree.of_sets(sets), []
    for i, own in enumerate(tree.order):
        for j in tree.later(i, num, den):
            other = tree.order[j]
            x, y = find(own), find(other)
            if x == y:
                continue
            both = _overlap(sets[own], sets[other])
            if den * both >= num * (len(sets[own]) + len(sets[other]) - both):
                root[y] = x
                found.append((int(own), int(other)))
    return found


def _vectors(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The count vector of each text, one byte per group where that suffices."""
    for batch, sets in _sets(batches, width):
        points = [group_counts(s, _groups_of(len(s))) for s in sets]
        packed = [p.astype(np.uint8 if p.max() < 256 else np.uint32).tobytes() for p in points]
        n = pa.array([len(s) for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), n, pa.array(packed, pa.binary())], ["id", "n", "vector"])


def candidates(
    sizes: np.ndarray, vectors: list[bytes], labels: np.ndarray, num: int, den: int
) -> Iterator[tuple[int, int]]:
    """Positions of vectors whose bounded overlap allows a link; none with equal labels.

    Sets that link differ at most by one doubling of their groups, so a tree holds
    two neighbouring resolutions, the finer one folded.
    """
    groups = np.array([_groups_of(n) for n in sizes])
    for coarse in np.unique(groups):
        own = np.flatnonzero((groups == coarse) | (groups == 2 * coarse))
        if len(own) < 2 or (labels[own] == labels[own[0]]).all():
            continue
        points = np.empty((len(own), coarse), np.uint32)
        for row, i in enumerate(own):
            kind = np.uint8 if len(vectors[i]) == groups[i] else np.uint32
            points[row] = np.frombuffer(vectors[i], kind).reshape(-1, coarse).sum(axis=0)
        tree = CountTree(points, sizes[own])
        for i, x in enumerate(own[tree.order]):
            for y in own[tree.order[tree.later(i, num, den)]]:
                if labels[x] != labels[y] and coarse in (groups[x], groups[y]):
                    yield int(x), int(y)


def _near(
    batches: Iterator[pa.RecordBatch], num: int, den: int
) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of each block of count vectors; the rows of a block follow each other."""
    block, rows = None, []

    def pairs() -> pa.RecordBatch:
        ids, sizes, labels, vectors = zip(*rows)
        found = list(candidates(np.array(sizes), vectors, np.array(labels), num, den))
        low = [min(ids[x], ids[y]) for x, y in found]
        high = [max(ids[x], ids[y]) for x, y in found]
        return pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["a", "b"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("id", "n", "label", "vector")]
        for at, *row in zip(batch.column("block").to_pylist(), *columns):
            if at != block:
                if len(rows) > 1:
                    yield pairs()
                block, rows = at, []
            rows.append(row)
    if len(rows) > 1:
        yield pairs()


def _match(
    batches: Iterator[pa.RecordBatch], width: int, num: int, den: int
) -> Iterator[pa.RecordBatch]:
    """Labels that links within a block connect: (label, smallest label connected with it).

    The rows of a block follow each other.
    """
    block, labels, sets = None, [], []

    def edges() -> pa.RecordBatch:
        smallest = {label: label for label in labels}

        def find(label: int) -> int:
            while smallest[label] != label:
                label = smallest[label]
            return label

        for x, y in linked(sets, labels, num, den):
            low, high = sorted((find(labels[x]), find(labels[y])))
            smallest[high] = low
        stars = [(label, find(label)) for label in smallest if smallest[label] != label]
        return pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in stars], pa.int64()), pa.array([b for _, b in stars], pa.int64())], ["a", "b"])

    for batch, own in _sets(batches, width):
        for at, label, s in zip(batch.column("block").to_pylist(), batch.column("label").to_pylist(), own):
            if at != block:
                if len(sets) > 1:
                    yield edges()
                block, labels, sets = at, [], []
            labels.append(label)
            sets.append(s)
    if len(sets) > 1:
        yield edges()


def _blocks(rows: DataFrame) -> DataFrame:
    """Number of blocks of each bucket, from its rows and shingles."""
    size = rows.groupBy("key").agg(F.count("*").alias("_rows"), F.sum("n").alias("_n"))
    parts = F.greatest(F.ceil(F.col("_rows") / _BLOCK_ROWS), F.ceil(F.col("_n") / _BLOCK_SHINGLES))
    return size.select("key", F.greatest(parts, F.lit(1)).cast("long").alias("parts"))


def _one_bucket(buckets: DataFrame, order, seed: int) -> DataFrame:
    """Each id in one of its buckets, and the block there."""
    chosen = buckets.groupBy("id").agg(F.max("n").alias("n"), F.max_by("key", order).alias("key"))
    part = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.col("parts"))
    return chosen.join(_blocks(chosen), "key").select("id", F.xxhash64("key", part).alias("block"))


def _different(buckets: DataFrame) -> DataFrame:
    """One bucket of those that hold the same ids."""
    held = buckets.groupBy("key").agg(
        F.count("*").alias("_k"), F.bit_xor(F.xxhash64("id")).alias("_x"),
        F.bit_xor(F.xxhash64(F.lit(4), F.col("id"))).alias("_y"))
    one = held.groupBy("_k", "_x", "_y").agg(F.min("key").alias("key")).select("key")
    return buckets.join(one, "key", "left_semi")


def _pairs_of_blocks(buckets: DataFrame) -> DataFrame:
    """Each bucket as one block, or as all pairs of its parts."""
    part = F.pmod(F.xxhash64(F.lit(3), F.col("id")), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    return (
        buckets.join(_blocks(buckets), "key")
        .withColumn("part", part)
        .withColumn("other", other)
        .select("id", "label", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("block"))
    )


def _stars(pairs: DataFrame) -> DataFrame:
    """Pairs as blocks of one id and its partners, many partners in several blocks."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / 1024).alias("parts"))
    part = F.pmod(F.xxhash64(F.lit(5), F.col("b")), F.col("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.xxhash64("a", part).alias("block"))
    centres = dealt.select("block", F.col("a").alias("id")).distinct()
    ends = dealt.select("block", F.col("b").alias("id")).unionByName(centres)
    return ends


def _linked_in(blocks: DataFrame, match, name: str) -> DataFrame:
    """Labels connected within blocks of (block, label, text)."""
    dealt = blocks.select("block", "label", "text").repartition("block")
    return settled(dealt.sortWithinPartitions("block").mapInArrow(match, _EDGES), name)


def _able(buckets: DataFrame) -> DataFrame:
    """Rows of ids that stand in as many buckets as any link of theirs needs."""
    enough = F.count("*") >= F.max("need")
    able = buckets.groupBy("id").agg(enough.alias("ok")).filter("ok").select("id")
    return buckets.join(able, "id", "left_semi")


def _open(buckets: DataFrame, met: list[str]) -> DataFrame:
    """Rows of buckets that hold several labels and several blocks of every earlier round.

    All buckets that a pair shares are open as long as the pair is unconnected and
    has not met, so the rule of :func:`_able` holds for open buckets too.
    """
    open_keys = buckets.groupBy("key").agg(
        *[F.min(c).alias(f"_min_{c}") for c in ("label", *met)],
        *[F.max(c).alias(f"_max_{c}") for c in ("label", *met)],
    )
    for c in ("label", *met):
        open_keys = open_keys.filter(F.col(f"_min_{c}") < F.col(f"_max_{c}"))
    return buckets.join(open_keys.select("key"), "key", "left_semi")


def _still_open(buckets: DataFrame, met: list[str]) -> DataFrame:
    """Open buckets of the ids that stand in enough of them."""
    return _open(_able(_open(buckets, met)), met)


def _labelled(rows: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """Rows with the component of their id, the id itself where no link is known.

    Each round maps the labels of the round before to smaller ones.
    """
    rows = rows.withColumn("label", F.col("id"))
    for labels in rounds:
        known = labels.select(F.col("vertex").alias("label"), F.col("component").alias("_c"))
        rows = rows.join(known, "label", "left").withColumn("label", F.coalesce("_c", "label")).drop("_c")
    return rows


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    threshold: tuple[int, int] = (75, 100),
) -> DataFrame:
    """One row per document: id, ``n_shingles`` and ``component_id``.

    ``component_id`` is the smallest id reachable by links, the own one included.
    ``threshold`` is the similarity as a fraction of whole numbers. The result is
    written; all tables on the way to it are removed.
    """
    with scratch(docs.sparkSession):
        found = _components_of(_versions(docs, id_col, text_col), width, *threshold)
        found = settled(found.select("id", "n_shingles", "component_id"), "near-duplicates", outlives=True)
    return found.withColumnRenamed("id", id_col)


def _versions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, version): rows of one text share the hash of it, whatever their ids."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.withColumn("version", F.xxhash64("text"))


def _components_of(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """From (id, text, version): id, version, ``n_shingles``, the group's label and ``component_id``.

    Sets are told apart by the version of a text that has them, never by ids, which
    may stand on several texts: the steps in between call it ``id``.
    """
    sketch = settled(docs.mapInArrow(partial(_sketch, width=width), _SKETCH), "sketch")
    sizes = sketch.filter("not common").select("id", "version", "n", "high", "low")
    usable = sizes.filter("id IS NOT NULL AND n > 0")

    # At most _COMMON_SHARE times the mean set size, whatever the number of documents.
    least = max(_COMMON_LEAST, sizes.count() // _COMMON_SHARE)
    common = sketch.filter("common").groupBy("high").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    last = np.sort(np.array([r[0] for r in common.select("high").collect()], np.int64).view(np.uint64))

    members = settled(
        usable.groupBy("high", "low").agg(
            F.min("version").alias("rep"), F.min("id").alias("least"), F.min(F.struct("version", "id"))["id"].alias("holder")),
        "members")
    keys = (
        docs.filter("id IS NOT NULL").select(F.col("version").alias("id"), "text")
        .mapInArrow(partial(_prefixes, width=width, num=num, den=den, last=last), _KEYS)
        .filter("n > 0")
        .groupBy("high", "low")
        .agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "need", "keys")])
        .select("id", "n", "need", F.explode("keys").alias("key"))
    )
    of_key = F.count("*").over(Window.partitionBy("key"))
    met = settled(keys.withColumn("k", of_key).filter("k > 1"), "buckets")
    buckets = settled(_able(met).withColumn("k", of_key).filter("k > 1"), "buckets")

    match = partial(_match, width=width, num=num, den=den)
    # Round 1: every representative in its most frequented bucket.
    first = settled(_one_bucket(buckets, F.struct("k", "key"), 1), "blocks")
    # One document that holds the text sends it, the others are copies.
    # They may outgrow a broadcast, so the texts are always shuffled to meet them.
    holders = first.join(members.select(F.col("rep").alias("id"), "holder"), "id").select(
        F.col("id").alias("version"), F.col("holder").alias("id"), "block")
    held = docs.hint("merge").join(holders, ["id", "version"]).select(F.col("version").alias("id"), "text", "block")
    held = settled(held, "texts")
    edges = _linked_in(held.withColumn("label", F.col("id")), match, "links")
    # Every id is in one block, so the stars are the components already.
    rounds = [edges.withColumnsRenamed({"a": "vertex", "b": "component"})]

    # Round 2: what is open, again in the most frequented bucket.
    buckets = _labelled(buckets, rounds).join(first.withColumnRenamed("block", "block1"), "id")
    buckets = settled(_still_open(buckets, ["block1"]).drop("label"), "open")
    if not buckets.isEmpty():
        second = settled(_one_bucket(buckets, F.struct("k", "key"), 2), "blocks")
        texts = held.select("id", "text")
        rounds.append(components(_linked_in(_labelled(texts.join(second, "id"), rounds), match, "links")))
        # The rest: all buckets still open, large ones as pairs of blocks, by count vectors.
        buckets = _labelled(buckets, rounds).join(second.withColumnRenamed("block", "block2"), "id")
        buckets = settled(_still_open(buckets, ["block1", "block2"]), "open")
        if not buckets.isEmpty():
            vectors = texts.mapInArrow(partial(_vectors, width=width), "id long, n long, vector binary")
            blocks = _pairs_of_blocks(_different(buckets.select("key", "id", "n", "label")))
            dealt = blocks.join(vectors.withColumnRenamed("n", "size"), "id").select(
                "block", "id", F.col("size").alias("n"), "label", "vector")
            near = dealt.repartition("block").sortWithinPartitions("block").mapInArrow(
                partial(_near, num=num, den=den), _EDGES)
            near = settled(near.distinct(), "near")
            if not near.isEmpty():
                stars = _labelled(_stars(near).join(texts, "id"), rounds)
                rounds.append(components(_linked_in(stars, match, "links")))

    grouped = settled(_labelled(members.withColumnRenamed("rep", "id"), rounds), "groups")
    smallest = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    grouped = grouped.select("high", "low", "label").join(smallest, "label")
    linkable = F.col("id").isNotNull() & (F.col("n") > 0)
    return (
        sizes.join(grouped, ["high", "low"], "left")
        .select(
            "id",
            "version",
            F.col("n").alias("n_shingles"),
            F.when(linkable, F.col("label")).alias("label"),
            F.when(linkable, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        )
    )


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents less all but one of each near-duplicate group, columns as they are.

    The document with the smallest id of a group stays. Documents with an empty set or a
    NULL id stay. Different texts under one id are told apart: a text goes only for a
    group of its own. Of rows equal in id and text one stays.
    """
    with scratch(docs.sparkSession):
        found = _components_of(_versions(docs, id_col, text_col), 5, 75, 100)
        found = settled(found.select("id", "version", "label"), "groups", outlives=True)
    first = found.filter("label IS NOT NULL").groupBy("label").agg(F.min(F.struct("id", "version")).alias("first"))
    gone = found.join(first, "label").filter(
        (F.col("id") != F.col("first.id")) | (F.col("version") != F.col("first.version"))).select("id", "version").distinct()
    # Columns of any name are kept apart from those used here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", F.col("row")[id_col].cast("long").alias("id"), F.xxhash64(F.col("row")[text_col].cast("string")).alias("version"))
    kept = rows.join(gone, ["id", "version"], "left_anti")
    repeats = found.filter("id IS NOT NULL").groupBy("id", "version").count().filter("count > 1").select("id", "version")
    if repeats.isEmpty():
        return kept.select("row.*")
    single = kept.join(repeats, ["id", "version"], "left_anti")
    once = kept.join(repeats, ["id", "version"]).groupBy("id", "version").agg(F.first("row").alias("row"))
    return single.select("row.*").unionByName(once.select("row.*"))
