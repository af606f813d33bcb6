"""Operators over whole tables, against plain Python on small inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsflow.llm import decontamination, graph, mixing, ngram_join, sharding
from newsflow.llm.prefix_sums import running_sums
from tests.llm.brute import SPACED, ascii_lower, near_duplicate_components, shingles

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, id string, n long, key string, block long"


def rows_of(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "a", 1, "k", 5) for r in rows], SCHEMA)


# --- near duplicates ------------------------------------------------------------------


def sentence(seed, n):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 3000, n)]


def near_rows():
    rows = [(1, None, "s"), (2, "", "s"), (3, " \n", "s"), (4, "a b", "s"), (5, "A  B", "s"), (6, "a b c", "s")]
    base, passage = sentence(1, 60), sentence(2, 40)
    rng = np.random.default_rng(3)
    for k in range(90):  # near copies of one text, many of them not near each other
        own = list(base)
        for at in rng.integers(0, 60, rng.integers(0, 4)):
            own[at] = f"x{k}_{at}"
        rows.append((100 + k, " ".join(own), "s"))
    for k in range(150):  # a passage that many different texts share
        rows.append((300 + k, " ".join(sentence(100 + k, 45) + passage), "s"))
    rows += [(600 + k, " ".join(base).upper(), None) for k in range(30)]
    chain = sentence(9, 80)
    for k in range(8):  # each links with the next only
        rows.append((700 + k, " ".join(chain[: 80 - 4 * k] + sentence(50 + k, 4 * k)), "s"))
    rows.append((800, " ".join(sentence(5, 30_000)), "s"))
    rows.append((801, " ".join(sentence(5, 30_000)[:-200]), "s"))
    return rows


@pytest.fixture(scope="module")
def near(spark):
    rows = near_rows()
    docs = rows_of(spark, [*rows, rows[10], (None, rows[10][1], "s")])
    return rows, docs, ngram_join.near_duplicates(docs).collect()


def test_near_duplicates_on_planted_rows(near):
    rows, docs, got = near
    wanted = near_duplicate_components([(r[0], r[1]) for r in rows])
    assert len(got) == len(rows) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == wanted
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_one_per_group(near):
    rows, docs, got = near
    kept = ngram_join.one_per_group(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert ids == Counter({*(r.component_id for r in got if r.doc_id is not None), None})


def by_row(rows):
    """Plain version with texts told apart by row: (n_shingles, smallest id linked) of each row."""
    found = near_duplicate_components([(i, text) for i, (_, text, *_) in enumerate(rows)])
    least = {}
    for i, (_, root) in found.items():
        least[root] = min(least.get(root, rows[i][0]), rows[i][0])
    return Counter((rows[i][0], n, least[root]) for i, (n, root) in found.items())


def test_different_texts_under_one_id(spark):
    """A long text under an id takes no link from a short one, and no text goes for another's group."""
    chance = random.Random(11)
    words = lambda n: " ".join(f"w{chance.randrange(10**6)}" for _ in range(n))
    short, long = words(40), words(30_000)
    rows = [(1, short, "s"), (1, long, "s"), (2, short + " more", "s"), (4, " ".join(long.split()[:300]), "s"),
            (5, words(50), "s"), (5, words(50), "s"), (6, long + " end", "s"), (7, words(60), "s"), (7, None, "s")]
    rows += [(8, short + " again", "s"), (8, rows[4][1] + " again", "s")]
    got = ngram_join.near_duplicates(rows_of(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == by_row(rows)
    kept = {(r.doc_id, r.text) for r in ngram_join.one_per_group(rows_of(spark, rows)).collect()}
    assert kept == {(r[0], r[1]) for r in rows if r not in (rows[2], rows[6], rows[9], rows[10])}


def test_repeated_ids_at_random(spark):
    """Near copies under few ids, against the plain version by row."""
    chance = random.Random(5)
    rows = []
    for i, (_, text, source) in enumerate(near_rows()[:150]):
        rows.append((chance.randrange(60), text, source))
    got = ngram_join.near_duplicates(rows_of(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == by_row(rows)


@pytest.mark.parametrize("stage", [1, 2, 3])
def test_columns_named_like_those_used_inside(spark, stage):
    """Stages keep extra columns of any name."""
    names = ["_id", "_hit_id", "_hit_version", "_source", "_version", "_copies", "_more", "_at", "_one", "_rank", "_range",
             "id", "version", "row", "label", "copies", "more", "rank", "sum", "rows", "doc", "hit_id", "taken_doc_id"]
    rows = [(i, f"text number {i} of some documents", "en", f"s{i % 3}", 30) for i in range(12)] + [(3, "another one", "en", "s0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({name: F.concat(F.lit(name), F.col("doc_id").cast("string")) for name in names})
    items = spark.createDataFrame([(1, "nothing of this is in there")], "item_id long, text string")
    calls = [None, lambda: ngram_join.one_per_group(docs), lambda: decontamination.clean_documents(docs, items),
             lambda: corpus_pipeline.source_mix(spark, docs, "")]
    out = calls[stage]()
    assert out.columns == docs.columns
    for r in out.collect():
        assert all(r[name] == f"{name}{r.doc_id}" for name in names)
    assert out.select("doc_id", "text").distinct().count() > 0


def test_near_duplicates_small_blocks(spark, monkeypatch):
    """Blocks, pairs of blocks and stars give the same groups as whole buckets."""
    monkeypatch.setattr(ngram_join, "_BLOCK_ROWS", 7)
    rows = near_rows()[:180]
    got = ngram_join.near_duplicates(rows_of(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_duplicate_components(
        [(r[0], r[1]) for r in rows])


def test_near_duplicates_empty(spark):
    assert ngram_join.near_duplicates(rows_of(spark, []).limit(0)).count() == 0


def test_tree_never_loses_a_pair():
    rng = np.random.default_rng(7)
    sets = []
    for _ in range(120):
        base = sets[rng.integers(0, len(sets))] if sets and rng.random() < 0.7 else rng.integers(0, 2**63, 60).astype(np.uint64)
        keep = base[rng.random(len(base)) > 0.08]
        sets.append(np.unique(np.concatenate((keep, rng.integers(0, 2**63, rng.integers(1, 9)).astype(np.uint64)))))
    tree = ngram_join.CountTree.of_sets(sets)
    found = {frozenset((int(tree.order[i]), int(tree.order[j]))) for i in range(120) for j in tree.later(i, 75, 100)}
    sizes = np.array([len(s) for s in sets])
    packed = [ngram_join.group_counts(s, ngram_join._groups_of(len(s))).astype(np.uint8).tobytes() for s in sets]
    sent = {frozenset(p) for p in ngram_join.candidates(sizes, packed, np.arange(120), 75, 100)}
    for i in range(120):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                assert frozenset((i, j)) in found and frozenset((i, j)) in sent


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200), (7, 300)]
    got = {r.vertex: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {v for k, v in got.items() if k <= 40 or k == 300} == {0}
    assert got[100] == got[101] == 100


# --- decontamination -------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = WORD.findall(ascii_lower(text or ""))
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(item))
    sizes = {len(w) for w in windows}
    result = {}
    for id_, text in docs:
        w = WORD.findall(ascii_lower(text or ""))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        result[id_] = (len(w), len(hit), sorted(found))
    return result


def test_contamination(spark):
    items = [(1, " ".join(f"q{i}" for i in range(14))), (2, "One two, three"), (3, None), (4, "..."),
             (5, " ".join(f"q{i}" for i in range(3, 20))), (10, "Äpfel und birnen"), (1, "same same same")]
    phrase = " ".join(f"Q{i}!" for i in range(14))
    docs = [(1, None, "s"), (2, "", "s"), (3, "x " + phrase + " y", "s"), (4, "one TWO three; one two three", "s"),
            (5, "one two x three", "s"), (6, " ".join(f"q{i}" for i in range(9)), "s"), (7, "äpfel und birnen", "s"),
            (8, "Äpfel und Birnen", "s"), (9, "same same same same", "s"), (11, (phrase + " ") * 40, "s"), (3, "x " + phrase + " y", "s")]
    got = decontamination.contamination(rows_of(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == leaks([(d[0], d[1]) for d in docs], items)
    kept = decontamination.clean_documents(rows_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6, 7]


def test_clean_documents_judges_each_text_of_an_id(spark):
    phrase = " ".join(f"q{i}" for i in range(12))
    docs = [(None, f"x {phrase}", "s"), (None, "clean one", "s"), (None, "clean two", "s"), (None, None, "s"),
            (1, phrase, "s"), (1, "another clean text", "s"), (2, phrase, "s")]
    items = spark.createDataFrame([(1, phrase)], "item_id long, text string")
    kept = decontamination.clean_documents(rows_of(spark, docs), items).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == [
        ("1", "another clean text"), ("None", "None"), ("None", "clean one"), ("None", "clean two")]


def test_contamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = rows_of(spark, [(1, "a b", "s"), (None, None, None)])
    got = decontamination.contamination(docs, none).collect()
    assert sorted((r.n_words, r.n_hit, r["items"]) for r in got) == [(0, 0, []), (2, 0, [])]
    assert decontamination.contamination(docs.limit(0), none).count() == 0


def test_contamination_by_proximity(spark):
    """All ten words count, not the rarest three; an inserted word is found, a foreign one is not."""
    q = [f"q{i}" for i in range(10)]
    docs = [(1, " ".join(q), "s"), (2, " ".join([*q[:4], "x", *q[4:]]), "s"), (3, " ".join([*q[:4], "x", *q[5:]]), "s"),
            (4, " ".join(q[3:] + q[:3]), "s"), (None, " ".join(["y", *q[:9], "x", q[9]]), "s"), (None, None, "s"),
            (5, " ".join([q[1], q[0], *q[2:]]), "s"), (6, " ".join(["z", *q[:2], "x", "x", "x", *q[2:]]), "s")]
    items = spark.createDataFrame([(1, " ".join(q)), (2, " ".join(q[:9]))], "item_id long, text string")
    got = decontamination.contamination(rows_of(spark, docs), items, slop=1).collect()
    seen = {r.doc_id if r.n_words or r.doc_id else "none": (r.n_hit, r["items"], r.n_near, r.items_near) for r in got}
    assert seen == {
        1: (10, ["1", "2"], 10, ["1", "2"]), 2: (0, [], 10, ["1", "2"]), 3: (0, [], 0, []), 4: (0, [], 0, []),
        None: (9, ["2"], 10, ["1", "2"]), "none": (0, [], 0, []), 5: (0, [], 10, ["1", "2"]), 6: (0, [], 0, [])}
    exact = decontamination.contamination(rows_of(spark, docs), items)
    assert exact.columns == ["doc_id", "n_words", "n_hit", "items"]
    kept = decontamination.clean_documents(rows_of(spark, docs), items, slop=1).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "4", "6", "None"]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha x beta gamma"), (3, "gamma alpha")], "id long, text string")
    docs = docs.withColumn("version", F.lit(0).cast("long"))
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    windows = decontamination.windows_of(items)
    anchors = decontamination.anchors_of(windows, decontamination.term_counts(docs, windows))
    postings = decontamination.postings_of(docs, anchors)
    exact = decontamination.occurrences(postings, anchors)
    near = decontamination.occurrences(postings, anchors, slop=1)
    assert {r.id for r in exact.collect()} == {1} and {r.id for r in near.collect()} == {1, 2}


def test_words_of_every_character(spark):
    texts = ["".join(f"a{chr(c)}Z" for c in range(at, at + 64)) for at in range(0, 0x500, 64)]
    texts += ["", "..", "A", " b ", "日本 ΑΣ ǅ İ I\u0307 \U0001F600 x", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = rows.select("i", decontamination.words_of(F.col("text")).alias("w"), decontamination.count_words(F.col("text")).alias("n")).collect()
    for r in got:
        assert r.w == WORD.findall(ascii_lower(texts[r.i] or "")) and r.n == len(r.w)


def test_threads_of_one_jvm_cut_texts_side_by_side(spark):
    """A class of ranges took about ten times as long as one of single characters with six threads or more."""
    text = F.repeat(F.concat(F.col("id").cast("string"), F.lit(" The quick brown foxes jumped, over lazy dogs.")), 100)
    texts = spark.range(0, 6400, 1, 8).select(text.alias("text")).localCheckpoint()
    single = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
    ways = {"plain": F.size(F.regexp_extract_all(F.col("text"), F.lit(single), F.lit(0))),
            "counted": decontamination.count_words(F.col("text")), "cut": F.size(decontamination.words_of(F.col("text")))}
    took = defaultdict(list)
    for _ in range(4):
        for name, way in ways.items():
            began = time.perf_counter()
            assert texts.agg(F.sum(way)).first()[0] == 6400 * 900
            took[name].append(time.perf_counter() - began)
    assert max(min(took["counted"]), min(took["cut"])) < 4 * min(took["plain"])


# --- mixing -------------------------------------------------------------------------------


def wanted_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        target |= {s: 3.0 * sizes[s] for s in full} if full else {s: level * weight[s] for s in open_}
        open_ = open_ - full if full else set()
    return target


def check_mix(docs, totals):
    sizes = defaultdict(int)
    for _, text, source, *_ in docs:
        sizes[source] += len(SPACED.findall(text or ""))
    target = wanted_targets(sizes)
    taken = defaultdict(int)
    block = max(1, min(4096, sum(sizes.values()) // (1 << 17)))
    for r in totals:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size and (r.copies > 0) == (r.taken > 0)
        taken[r.source] += r.taken
    for source in sizes:
        assert abs(taken[source] - target[source]) <= 40 * block + 1, source
    assert len(totals) == len(docs)


def test_mix(spark):
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(sentence(i, int(rng.integers(0, 60)))), s) for i, s in enumerate(
        rng.choice(["a", "b", "Z", "é", "d"], 300, p=[0.6, 0.1, 0.1, 0.1, 0.1]).tolist())]
    docs += [(i, "w " * 30, None) for i in range(300, 310)] + [(400, None, "a"), (401, "", None), (402, "", "empty")]
    docs += [(5, docs[5][1], docs[5][2]), (None, "no id", "a")]
    pieces, totals = mixing.mix(rows_of(spark, docs))
    check_mix(docs, totals.collect())
    by_slot = Counter()
    for r in pieces.collect():
        by_slot[r.slot] += r.words
    assert set(by_slot.values()) == {1}


def test_source_mix_takes_each_row_as_often_as_the_mix(spark):
    docs = [(None, f"w{i} " * (1 + i % 7), "abc"[i % 3]) for i in range(120)]
    docs += [(1, "one text", "b"), (1, "another text of it", "a"), *[(2, "equal rows", "c")] * 40, (None, None, "a")]
    frame = rows_of(spark, docs)
    _, totals = mixing.mix(frame)
    wanted, hashed = Counter(), {r.v: r.text for r in frame.select("text", F.xxhash64("text").alias("v")).collect()}
    for r in totals.collect():
        wanted[r.doc_id, hashed[r.version], r.source] += r.copies
    mixed = corpus_pipeline.source_mix(spark, frame, FOLDER)
    assert mixed.columns == frame.columns
    assert Counter((r.doc_id, r.text, r.source) for r in mixed.collect()) == +wanted
    assert len(set(wanted.values())) > 2


def test_mix_is_even_along_the_way_and_repeats(spark):
    docs = rows_of(spark, [(i, "w " * 50, "abc"[i % 3]) for i in range(90)])
    first, totals = mixing.mix(docs)
    again, _ = mixing.mix(docs)
    rows = sorted(map(tuple, first.collect()))
    assert rows == sorted(map(tuple, again.collect()))
    share = Counter(r[1] for r in rows if r[0] < 450)
    assert abs(share["b"] / 450 - 0.25) < 0.02
    assert mixing.mix(docs.limit(0))[1].count() == 0


# --- sharding -------------------------------------------------------------------------------


def least_capacity(sizes, shards):
    def parts(capacity):
        used, room = 1, capacity
        for s in sizes:
            if s > room:
                used, room = used + 1, capacity
            room -= s
        return used

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if parts(middle) <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_sharding(spark, shards):
    rng = np.random.default_rng(5)
    docs = [(i, "x" * int(rng.integers(0, 400)), "s") for i in range(200)]
    docs += [(1000 + i, "copy " * 20, "s") for i in range(150)] + [(2000, None, "s"), (2001, "", "s"), (None, "é", "s"), (3, docs[3][1], "s")]
    got = sharding.shard_documents(rows_of(spark, docs), shards).collect()
    assert len(got) == len(docs)
    load, groups, slots, texts = Counter(), Counter(), defaultdict(list), defaultdict(set)
    size_of = {d[0]: len((d[1] or "").encode()) + 1 for d in docs}
    text_of = {d[0]: d[1] for d in docs}
    for r in got:
        text = text_of[r.doc_id]
        assert r["size"] == size_of[r.doc_id] and r.text_crc32 == zlib.crc32((text or "").encode())
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        texts[text].add(r.shard)
    assert all(len(s) == 1 for s in texts.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for _, text, *_ in docs:
        groups[text] += len((text or "").encode()) + 1
    order = sorted(groups, key=lambda t: "" if t is None else hashlib.sha256(t.encode()).hexdigest())
    assert max(load.values()) == least_capacity([groups[t] for t in order], shards)


def test_sharding_empty(spark):
    assert sharding.shard_documents(rows_of(spark, []).limit(0)).count() == 0


def test_running_sums(spark):
    rows = spark.createDataFrame([(k, i, i * 3 % 7) for k in ("a", "b", None) for i in range(100)], "k string, i long, v long")
    got = running_sums(rows, ["i"], {"s": "v"}, by=["k"]).collect()
    for r in got:
        assert r.s == sum(i * 3 % 7 for i in range(r.i + 1))
    assert len(got) == 300
