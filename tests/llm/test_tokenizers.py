"""Byte-level BPE and token alignment against the tokenizer libraries, token by token."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from newsflow.llm import byte_bpe, queries, token_alignment
from newsflow.llm.packing import TOKENIZERS
from newsflow.llm.tokens import texts
from tokenizers import Tokenizer

SMALL, FOLDER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def bpe():
    ranks = byte_bpe.read_ranks(f"{TOKENIZERS}/{byte_bpe.RANKS}")
    return tiktoken.Encoding("bytes", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_equal_the_library(bpe):
    chance = random.Random(7)
    signs = list("aabcdeABthe ing \n\t'sll 12½ßéя中文 　\x1c\x1f\x85​ 😀́_-=#")
    signs += ["the", "ing", "    ", "'ll", "ation", "\n\n", "<|endoftext|>"]
    texts = ["".join(chance.choices(signs, k=chance.randint(0, 60))) for _ in range(4000)]
    tokens = sorted(bpe.token_byte_values())
    texts += [b"".join(chance.choices(tokens, k=8)).decode("utf-8", "replace") for _ in range(4000)]
    texts += ["a" * 3000, "ab" * 5000, "=-" * 4000, " " * 3000, "thethe" * 900, ""]
    encoder = byte_bpe.Encoder(f"{TOKENIZERS}/{byte_bpe.RANKS}")
    ids, at = encoder.ids(texts)
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == bpe.encode_ordinary(text), repr(text)


def test_forgetting_changes_nothing(bpe, monkeypatch):
    monkeypatch.setattr(byte_bpe, "_MOST_KNOWN", 3)
    encoder = byte_bpe.Encoder(f"{TOKENIZERS}/{byte_bpe.RANKS}")
    for text in ("one two three four", "five six seven eight", "one six"):
        assert encoder.ids([text])[0].tolist() == bpe.encode_ordinary(text)


def test_lower_rank_coming_up_goes_first():
    """Merging x+y makes a pair whose rank is below that of x+y."""
    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {b"yz": 300, b"xyx": 256, b"xy": 301}
    library = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    merges = byte_bpe.Merges(ranks)
    for word in ("xyxy", "xyxyxy", "xyzxyxyz", "zxyxyyzx"):
        ids, sizes = merges.replay([word.encode()])
        assert ids.tolist() == library.encode_ordinary(word) and sizes.tolist() == [len(ids)]


def test_query_equals_the_library(spark, bpe):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op12_byte_bpe(spark, FOLDER).collect()}
    assert len(got) == len(docs)
    for row in docs:
        ids = bpe.encode_ordinary(row.text)
        assert got[row.doc_id].n_tokens == len(ids)
        assert got[row.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[row.doc_id].decoded_sha256 == hashlib.sha256(row.text.encode()).hexdigest()


def test_odd_rows(spark, bpe):
    """NULLs, empty and long texts, repeated rows, invalid bytes, ids of another type, clashing names."""
    rows = [("a", None, 1), ("b", "", 2), ("c", "word " * 50_000, 3), ("c", "other text", 4),
            ("c", "other text", 4), (None, "no id", 5)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, ids int")
    docs = docs.withColumns({"id": F.lit(1), "decoded": F.lit("x")})
    back = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    want = sorted((str(i), bpe.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in back) == want
    broken = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text")
    assert bytes(byte_bpe.decode(byte_bpe.encode(broken)).first().decoded) == "a�b".encode()
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0))).count() == 0
    odd = spark.createDataFrame([(1, [50256, -1, 64, None, 2_000_000]), (2, None)], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in byte_bpe.decode(odd).sort("doc_id").collect()] == [b"a", b""]


class PlainAlignment:
    """Whole texts by the libraries, token ends compared as sets."""

    def __init__(self, bpe):
        self.a = Tokenizer.from_file(f"{TOKENIZERS}/{token_alignment.A_FILE}")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/{token_alignment.B_FILE}")
        self.bytes = bpe.decode_single_token_bytes

    def b_bytes(self, token: int) -> bytes:
        piece = self.b.id_to_piece(token)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(token) else piece.replace("\u2581", " ").encode()

    def __call__(self, text: str | None):
        """(A ids, B ids, groups, overlaps, links), or None without tokens."""
        if not text:
            return None
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        a_bytes, b_bytes = [self.bytes(i) for i in a], [self.b_bytes(i) for i in b]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            return None
        a_end, b_end = np.cumsum([len(x) for x in a_bytes]), np.cumsum([len(x) for x in b_bytes])
        groups, links, i, j = [], [], 0, 0
        for end in sorted({*a_end.tolist()} & {*b_end.tolist()}):
            p, q = a_end.tolist().index(end, i), b_end.tolist().index(end, j)
            groups.append((a[i : p + 1], b[j : q + 1]))
            links.append((a[p], b[q]))
            i, j = p + 1, q + 1
        spans = [(e - len(x), e) for e, x in zip(b_end.tolist(), b_bytes)]
        overlaps = sum(
            sum(1 for low, high in spans if low < e and high > e - len(x)) for e, x in zip(a_end.tolist(), a_bytes)
        )
        return a, b, groups, overlaps, links


@pytest.fixture(scope="module")
def plain(bpe):
    return PlainAlignment(bpe)


def written(groups) -> str:
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def judged(docs):
    aligned = token_alignment.align(docs)
    return token_alignment.judge(aligned, token_alignment.pair_counts(aligned))


def plain_table(plain, rows):
    """The query's columns by plain counting."""
    found = [(id_, plain(text)) for id_, text in rows]
    count = Counter(link for _, own in found if own for link in own[4])
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    table = []
    for id_, own in found:
        if own is None:
            table.append((id_, 0, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, overlaps, links = own
        table.append((
            id_, len(a), len(b), len(groups), len(links), overlaps, sum(count[k] == most[k[1]] for k in links),
            sum(count[k] for k in links), written(groups)))
    return table


def test_byte_letters(bpe):
    import json

    with open(f"{TOKENIZERS}/{token_alignment.A_FILE}", encoding="utf-8") as file:
        entries = json.load(file)["model"]["vocab"]
    letters = token_alignment.byte_letters()
    for entry, token in entries.items():
        if token < 50256:
            assert bytes(letters[c] for c in entry) == bpe.decode_single_token_bytes(token)


def test_no_piece_goes_on_past_a_space():
    b = token_alignment.Pieces(TOKENIZERS).vocabulary
    for i in range(len(b.size)):
        assert b" " not in b.data[b.first[i] : b.first[i] + b.size[i]].tobytes().lstrip(b" ")


def test_coalescing():
    """Bytes ab|c|def against a|bc|de|f: groups abc and def."""
    found = token_alignment.coalesce(np.array([2, 1, 3]), np.array([1, 2, 2, 1]))
    assert found.a_group.tolist() == [0, 0, 1] and found.b_group.tolist() == [0, 0, 1, 1]
    assert found.overlaps.tolist() == [2, 1, 2] and found.groups == 2


def test_random_texts_align_as_whole_texts(plain):
    chance = random.Random(3)
    signs = list("aabcdeABthe ing \n\t'sll 12½ßéà×÷я中文\xa0　\x1c\x1f\x85 😀́_-=#\x00")
    signs += ["the", "ing", "    ", "'ll", "ation", "\n\n", "<s>", "<0x41>", "<|endoftext|>", "\u2581"]
    rows = ["".join(chance.choices(signs, k=chance.randint(0, 40))) for _ in range(3000)]
    rows += ["", "a ", " ", "  ", "a  b", "\u2581", "a\u2581b c"]
    aligner = token_alignment.Aligner(TOKENIZERS)
    which, first, right = aligner.numbers(texts(pa.array(rows)))
    for i, text in enumerate(rows):
        own, want = which[first[i] : first[i + 1]], plain(text)
        assert right[i] == (want is not None), repr(text)
        if want is not None:
            assert ";".join(aligner.texts[n] for n in own) == written(want[2]), repr(text)
            assert aligner.facts[own, 4].sum() == want[3]


def test_alignment_query_equals_plain_counting(spark, plain):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op13_token_alignment(spark, SMALL).collect()
    for row, want in zip(sorted(got), sorted(plain_table(plain, [tuple(r) for r in docs]))):
        own = (row.doc_id, row.n_a, row.n_b, row.n_groups, row.n_links, row.n_overlaps, row.n_best, row.count_sum)
        assert own == want[:-1]
        assert row.groups_sha256 == hashlib.sha256(want[-1].encode()).hexdigest()


def test_odd_rows_of_the_alignment(spark, plain, monkeypatch):
    rows = [(1, None), (2, ""), (3, "a\u2581b"), (4, "word " * 20_000 + "end"), (5, "same text"), (5, "same text"),
            (None, "other text <s>"), (6, " "), (7, "\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"groups": F.lit("x"), "pair": F.lit(1), "id": F.lit(2), "count": F.lit(3)})
    got = judged(docs).collect()
    # The long text is one word over and over: its overlaps are counted by hand.
    short = [r for r in rows if r[0] != 4]
    long_alone = plain("word word end"), plain("word end")
    step = len(long_alone[0][0]) - len(long_alone[1][0])
    by_id = {str(r.doc_id): r for r in got}
    assert len(got) == len(rows) and by_id["4"].n_a == len(long_alone[1][0]) + 19_999 * step
    for id_, text in short:
        own, want = by_id[str(id_)], plain(text)
        assert (own.n_a, own.n_b, own.n_groups) == (
            (len(want[0]), len(want[1]), len(want[2])) if want else (0, 0, 0))
        assert own.groups == (written(want[2]) if want else "")
    counts = {(r.a_id, r.b_id): r["count"] for r in token_alignment.pair_counts(token_alignment.align(docs)).collect()}
    same = plain("same text")[4]
    assert all(counts[link] >= 2 for link in same) and by_id["5"].count_sum == sum(counts[k] for k in same)
    broken = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text")
    none = judged(broken).first()
    assert (none.n_a, none.groups) == (0, "")
    assert judged(docs.limit(0)).count() == 0


def test_forgetting_stretches_changes_nothing(monkeypatch):
    """Few stretches kept, small slices and small calls: the same rows."""
    text = [f"some words {i} and some \u2581 more {i % 3}" for i in range(40)]
    text += [f"other words\n{i} and no more {i % 3} " for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(80)), pa.array(text)], ["id", "text"])

    def aligned():
        return [row for part in token_alignment._align(iter([batch]), TOKENIZERS) for row in part.to_pylist()]

    whole = aligned()
    monkeypatch.setattr(token_alignment, "_MOST_KNOWN", 12)
    monkeypatch.setattr(token_alignment, "_SLICE_BYTES", 100)
    monkeypatch.setattr(token_alignment, "_AT_ONCE", 2)
    assert aligned() == whole


def test_odd_ids(spark):
    docs = spark.createDataFrame([("doc-a", "a text")], "key string, body string")
    found = token_alignment.align(docs, "key", "body").first()
    assert found.key == "doc-a" and found.n_groups > 0
