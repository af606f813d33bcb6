"""Phrase mining against plain counting, on small inputs and in several rounds."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsflow.llm import collocations
from tests.llm.brute import ascii_lower


def plain(rows, top, least, longest, covered=80):
    """lang -> ranked (phrase, a, l, r, n, score), by counting every phrase of every text."""
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", ascii_lower(text or "")):
            words = re.findall("[^ \t]+", piece)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts["und" if lang is None else lang][tuple(words[i : i + size])] += 1
    result = {}
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        gone = {
            p[i : i + size]
            for p, c in candidates.items() for size in range(2, len(p)) for i in range(len(p) - size + 1)
            if 100 * c >= covered * f[p[i : i + size]]
        }
        ranked = []
        for p, a in candidates.items():
            if p in gone:
                continue
            score, _, l, r = min(
                (2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), (" ".join(p), a, l, r, n, score)))
        result[lang] = [row[3] for row in sorted(ranked)[:top]]
    return {lang: found for lang, found in result.items() if found}


def mined(docs, **how):
    result = defaultdict(list)
    for r in collocations.mine_phrases(docs, **how).orderBy("lang", "rank").collect():
        assert r["rank"] == len(result[r.lang]) + 1
        result[r.lang].append((r.phrase, r.a, r.l, r.r, r.n, r.score))
    return dict(result)


def corpus(seed, texts, vocabulary):
    """Texts with set phrases among random words, over several languages and none."""
    chance = random.Random(seed)
    fixed = [[f"p{i}x{k}" for k in range(chance.randint(2, 6))] for i in range(12)]
    rows = []
    for _ in range(texts):
        words = []
        while len(words) < 40:
            words += chance.choice(fixed) if chance.random() < 0.4 else [f"w{int(chance.random() ** 2 * vocabulary)}"]
        breaks = [w + chance.choice(["", "", "", "", ",", ". ", "\n", "\t", " "]) for w in words]
        rows.append((chance.choice(["en", "en", "fr", None]), " ".join(breaks).replace("w1 ", "W1 ")))
    return rows


@pytest.mark.parametrize("top, least, longest", [(5, 3, 4), (40, 3, 4), (1000, 5, 3), (7, 4, 2), (15, 2, 5)])
def test_phrases_equal_plain_counting(spark, top, least, longest):
    rows = corpus(top, 120, 30)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert mined(docs, top=top, least=least, longest=longest) == plain(rows, top, least, longest)


def test_frontier_widens_until_settled(spark, monkeypatch):
    """Where the first supposition leaves too few survivors, further rounds find the rest."""
    rounds, run = [], collocations._round
    monkeypatch.setattr(collocations, "_round", lambda *a: rounds.append(1) or run(*a))
    rows = [("en", f"one{i} two{i} three{i} four{i}") for i in range(30) for _ in range(10)]
    rows += [("en", f"common{i % 7} word{i % 9}") for i in range(400)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert mined(docs, top=40, least=5) == plain(rows, 40, 5, 4)
    assert len(rounds) > 1


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """With a filter so small that everything passes, the result is the same."""
    monkeypatch.setattr(collocations, "FILTER_BITS", 6)
    bits = np.full(1, np.uint64(2**64 - 1))
    assert collocations._holds(bits, np.arange(50, dtype=np.uint64)).all()
    monkeypatch.setattr(collocations, "phrase_filter", lambda phrases, width: np.full(1 << 20, np.uint64(2**64 - 1)))
    monkeypatch.setattr(collocations, "FILTER_BITS", 26)
    rows = corpus(2, 60, 20)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert mined(docs, top=10, least=3) == plain(rows, 10, 3, 4)


def test_scores_beyond_64_bits(spark):
    """Counts whose products pass 64 bits are divided exactly."""
    big = 9_000_000_000_000_001
    counts = spark.createDataFrame([(big, 10**16 + 7, 10**16 + 9)], "n long, l long, r long")
    got = counts.select(F.expr(collocations._ratio("n", collocations._wide("l", "r")))).first()[0]
    assert got == 2_000_000 * big // (2 * 10**16 + 16)


def test_odd_rows(spark):
    """NULLs, no words, repeated rows, long texts, invalid bytes, clashing names, an empty table."""
    rows = [("en", None), ("en", ""), ("en", " ,;.\n"), (None, "a b"), (None, "a b"), ("", "x y"), ("", "x y"), ("", "x  y"),
            ("en", "again and again " * 5000)]
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns(
        {c: F.lit(1) for c in ("n", "w1", "word", "phrase", "score", "rank", "bound", "l", "first")})
    assert mined(docs, top=4, least=2) == plain(rows, 4, 2, 4)
    broken = spark.sql("SELECT 'en' AS lang, cast(unhex('61FF2062') AS string) AS text FROM range(3)")
    assert mined(broken, top=4, least=2) == {"en": [("a� b", 3, 3, 3, 6, 1_000_000)]}
    assert collocations.mine_phrases(docs.limit(0)).count() == 0
    assert collocations.mine_phrases(docs, least=10**9).count() == 0


def test_pieces_and_rows_end_windows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a b.c d", "e f"]), pa.array(["en", "en"])], ["text", "lang"])
    (own,) = collocations._read(iter([batch]))
    assert own.windows(2).tolist() == [0, 2, 4] and own.windows(3).tolist() == []


def test_a_slice_takes_bounded_memory():
    """Reading and counting a slice takes some numbers a word, but none a byte."""
    batch = pa.RecordBatch.from_arrays(
        [pa.array([" ".join(f"word{i % 997}x{i % 89}" for i in range(1000))] * 400), pa.array(["en"] * 400)], ["text", "lang"])
    everything = np.full(1 << 20, np.uint64(2**64 - 1))
    for count in (
        collocations._count_words,
        partial(collocations._count_pairs, frequent=everything),
        partial(collocations._grow, longest=4, frequent=everything, frontier=everything),
    ):
        tracemalloc.start()
        try:
            assert sum(len(found) for found in count(iter([batch]))) > 0
            assert tracemalloc.get_traced_memory()[1] < 64 << 20
        finally:
            tracemalloc.stop()


def test_rows_reach_python_in_bounded_batches(spark):
    """Batches are bounded in bytes, and the session's own setting holds again afterwards."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([1])], ["w1", "n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    docs = spark.range(3000, numPartitions=1).selectExpr("'en' AS lang", "repeat('word text ', 1000) AS text")
    found = collocations.Corpus(docs, "text", "lang", 1).windows(sizes, 1, "batch-sizes")
    assert found.agg(F.max("w1")).first()[0] < 2 * collocations._BATCH_BYTES
    assert spark.conf.get(key, None) == before
