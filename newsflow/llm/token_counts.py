"""Operator 7: token counts under a unigram model over a given vocabulary.

Pre-tokens are the words of a text, each with the word mark before it. The best
segmentation of a word is the one with the greatest sum of piece scores (of equal
ones that with fewer pieces), found by forward dynamic programming. The distinct
words of a slice are walked in sorted order, which is their trie in depth-first
order: forward scores and piece counts of the path to the current node are kept,
so a prefix that words share is scored once. The count at a word's end is stored
and looked up for all its occurrences.

The vocabulary file holds pieces by rank, so a piece of rank r scores -log(r + 2).
A character without a piece counts as its UTF-8 bytes, scored below every piece.
A NULL text and one without words have 0 tokens. Repeated rows give equal results.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import partial
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm.packing import TOKENIZERS
from newsflow.llm.tokens import Memo, sliced, word_hashes, words

MARK = "▁"


def vocabulary(folder: str = TOKENIZERS) -> dict[str, float]:
    """Pieces with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
    usable = [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    return {piece: -math.log(rank + 2) for rank, piece in enumerate(usable)}


def piece_counts(distinct: Iterable[str], pieces: dict[str, float]) -> list[int]:
    """Pieces in the best segmentation of each word; ``distinct`` is sorted."""
    longest = max(map(len, pieces), default=1)
    lowest = min(pieces.values(), default=0.0) - 1.0
    path, score, used, counts = "", [0.0], [0], []
    for word in distinct:
        shared = len(commonprefix((path, word)))
        del score[shared + 1 :], used[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            best, fewest = -math.inf, 0
            for start in range(max(0, end - longest), end):
                value = pieces.get(word[start:end])
                if value is not None:
                    total = score[start] + value
                    if total > best or (total == best and used[start] + 1 < fewest):
                        best, fewest = total, used[start] + 1
            if word[end - 1] not in pieces:
                size = len(word[end - 1].encode("utf-8", "surrogatepass"))
                total = score[end - 1] + size * lowest
                if total > best:
                    best, fewest = total, used[end - 1] + size
            score.append(best)
            used.append(fewest)
        path = word
        counts.append(used[-1])
    return counts


def _count(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    pieces, known, stored = vocabulary(folder), Memo(), np.zeros(0, np.int64)
    for batch, rows in sliced(batches, "text"):
        found = words(rows)
        hashes = word_hashes(rows, found)
        distinct, at = np.unique(hashes, return_index=True)
        new = known.missing(distinct)
        stored = stored[: known.count]
        texts = [MARK + rows.data[found.start[i] : found.end[i]].tobytes().decode("utf-8", "replace") for i in at[new]]
        order = sorted(range(len(texts)), key=texts.__getitem__)
        own = np.empty(len(texts), np.int64)
        own[order] = piece_counts((texts[i] for i in order), pieces)
        known.add(distinct[new])
        stored = np.concatenate((stored, own))
        each = stored[known.numbers(hashes)] if len(hashes) else np.zeros(0, np.int64)
        total = np.concatenate(([0], np.cumsum(each)))
        n_tokens = total[found.first[1:]] - total[found.first[:-1]]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(np.diff(found.first)), pa.array(n_tokens)], ["id", "n_words", "n_tokens"])


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS
) -> DataFrame:
    """Words and tokens of every document."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = texts.mapInArrow(partial(_count, folder=folder), "id long, n_words long, n_tokens long")
    return counted.withColumnRenamed("id", id_col)
