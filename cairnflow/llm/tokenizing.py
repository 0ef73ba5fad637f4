"""Encoding of a corpus with a public byte-level BPE vocabulary.

A text is cut into pre-tokens; each pre-token is merged by rank.  The merge queue is a
hierarchical bitmap: one bucket of linked-list positions per merge rank, a bitmap of the
non-empty buckets in two levels, and find-first-set to pick the next rank.  A merge of rank r
only creates pairs of higher rank, so a bucket is complete when it is picked; entries whose
nodes have changed since are stale and skipped.  The cost is linear in the length of a
pre-token (times the levels), so one of many megabytes is no special case.

The vocabulary is broadcast (its size is that of the file); encoding is a map over the
documents without any shuffle.  Pre-tokens are remembered per task in a table of bounded size.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Vocabulary file (one base64 token and its rank per line) of the public tokenizer byte_bpe_50k.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens remembered by a task.
REMEMBERED = 150_000

#: The pre-token pattern that belongs to the vocabulary, for any text and for ASCII.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class RankQueue:
    """Positions by merge rank; ``pop`` gives all positions of the lowest rank."""

    __slots__ = ("top", "words", "buckets")

    def __init__(self):
        self.top, self.words, self.buckets = 0, {}, {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        high = rank >> 8
        self.top |= 1 << high
        self.words[high] = self.words.get(high, 0) | 1 << (rank & 255)

    def pop(self) -> tuple[int, list[int]]:
        high = (self.top & -self.top).bit_length() - 1
        word = self.words[high]
        low = word & -word
        word ^= low
        self.words[high] = word
        if not word:
            self.top ^= 1 << high
        rank = high << 8 | low.bit_length() - 1
        return rank, self.buckets.pop(rank)


def merge(data: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Token ids of one pre-token."""
    whole = ranks.get(data)
    if whole is not None:
        return (whole,)
    n = len(data)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    get, queue = ranks.get, RankQueue()
    for i in range(n - 1):
        rank = get(data[i : i + 2])
        if rank is not None:
            queue.push(rank, i)
    while queue.top:
        rank, bucket = queue.pop()
        if len(bucket) > 1:
            bucket.sort()
        for i in bucket:
            j = after[i]
            if j >= n or end[i] < 0 or get(data[i : end[j]]) != rank:
                continue
            end[i], after[i], end[j] = end[j], after[j], -1
            k = after[i]
            if k < n:
                before[k] = i
                rank_after = get(data[i : end[k]])
                if rank_after is not None:
                    queue.push(rank_after, i)
            h = before[i]
            if h >= 0:
                rank_before = get(data[h : end[i]])
                if rank_before is not None:
                    queue.push(rank_before, h)
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i : end[i]]])
        i = after[i]
    return tuple(out)


class _Remembered(dict):
    """Pre-token -> ids, filled on demand, emptied when full."""

    def __init__(self, ranks):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str):
        if len(self) >= REMEMBERED:
            self.clear()
        ids = merge(piece.encode("utf-8", "surrogatepass"), self.ranks)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.get = _Remembered(ranks).__getitem__
        self.ascii, self.any = re.compile(ASCII_PATTERN, re.ASCII).findall, regex.compile(PATTERN).findall

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        pieces = (self.ascii if text.isascii() else self.any)(text)
        return np.fromiter(chain.from_iterable(map(self.get, pieces)), np.int32)


def encode_corpus(docs: DataFrame, doc_id: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids`` of every row: the token ids of ``text`` without special tokens.

    Null and empty texts give an empty list, blank texts are encoded as they are, the names of
    special tokens inside a text are ordinary characters.  Rows are neither dropped nor
    merged: repeated rows and null ids are kept.  Extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(shared.value).encode
        for b in batches:
            ids = [encode(t) for t in b.column("text").to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.record_batch(
                [b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))],
                names=["doc_id", "ids"],
            )

    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, ids array<int>")
