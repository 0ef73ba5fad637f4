"""Evaluation texts inside a corpus, by a stored positional inverted index.

The corpus is tokenised once into an index table in the shared folder.  The index is distributed
by document: a row is a segment, the postings of all terms of some documents (term -> positions,
sorted by term), with the counts of the terms and the places of the documents.  A term that
stands everywhere is spread over all segments, so no posting list is ever held whole.

Every window of ``n`` consecutive words of a test item is looked up in each segment: the terms
are taken from the rarest there; the rarest term's positions, less its offset in the window, are
the possible starts; they are intersected with the offset-adjusted positions of the next rarest
term, and so on until all terms agree.  Nothing but the matches leaves a segment.

The items are the query side.  They are taken in blocks of bounded size, each block against the
whole index, so a larger test collection costs more reads of the index and never more memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cairnflow.sources.tables import materialize

#: Consecutive words that count as a leak.
RUN = 13
#: Words of a segment; a longer document is a segment of its own.
SEGMENT_WORDS = 400_000
#: Words of test items looked up in one read of the index.
BLOCK_WORDS = 2_000_000
#: Possible starts held at once while intersecting.
CANDIDATES = 2_000_000

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, lower-cased."""
    return _WORD.findall(text.lower()) if text else []


class Windows:
    """All windows of ``n`` words of the items, as term numbers."""

    def __init__(self, items: list[tuple], n: int):
        self.n, self.vocab, self.ids = n, {}, [i for i, _ in items]
        rows, owner = [], []
        for k, (_, text) in enumerate(items):
            w = [self.vocab.setdefault(x, len(self.vocab)) for x in words(text)]
            if len(w) >= n:
                rows.append(np.lib.stride_tricks.sliding_window_view(np.array(w, np.int32), n))
                owner.append(np.full(len(w) - n + 1, k, np.int32))
        self.terms = np.concatenate(rows) if rows else np.empty((0, n), np.int32)
        self.owner = np.concatenate(owner) if owner else np.empty(0, np.int32)


class Segment:
    """The postings of all terms of some documents."""

    def __init__(self, terms: pa.Array, counts: np.ndarray, positions: np.ndarray, lengths: np.ndarray):
        self.terms, self.counts, self.positions, self.lengths = terms, counts, positions, lengths

    @classmethod
    def of(cls, texts: list[list[str]]) -> Segment:
        """The segment of the documents with these words; one place is left free behind each."""
        vocab: dict[str, int] = {}
        number = vocab.setdefault
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        flat = np.fromiter((number(w, len(vocab)) for t in texts for w in t), np.int32)
        free = np.zeros(int(lengths.sum()), bool)
        free[np.cumsum(lengths) - 1] = True
        order = np.argsort(flat, kind="stable")
        counts = np.bincount(flat, minlength=len(vocab))
        return cls(pa.array(vocab, pa.string()), counts, np.flatnonzero(~free)[order], lengths)

    def row(self) -> dict:
        """The columns of the index table; positions are stored as steps inside each list."""
        steps = np.diff(self.positions, prepend=0)
        first = np.cumsum(self.counts) - self.counts
        steps[first] = self.positions[first]
        return {
            "terms": "\n".join(self.terms.to_pylist()),
            "counts": self.counts.astype("<i4").tobytes(),
            "steps": steps.astype("<i4").tobytes(),
            "lengths": self.lengths.astype("<i4").tobytes(),
        }

    @classmethod
    def read(cls, terms: str, counts: bytes, steps: bytes, lengths: bytes) -> Segment:
        size = np.frombuffer(counts, "<i4").astype(np.int64)
        run = np.cumsum(np.frombuffer(steps, "<i4"), dtype=np.int64)
        first = np.cumsum(size) - size
        before = np.where(first > 0, run[first - 1], 0) if len(size) else run
        parts = pa.array(terms.split("\n") if terms else [], pa.string())
        return cls(parts, size, run - np.repeat(before, size), np.frombuffer(lengths, "<i4").astype(np.int64))

    def lists(self, vocab: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(postings of each term of ``vocab`` here, first of each in keys, sorted keys: number of the term x places + place)."""
        at = pc.index_in(pa.array(vocab, pa.string()), value_set=self.terms)
        here = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.where(here >= 0, self.counts[here], 0) if len(self.counts) else np.zeros(len(vocab), np.int64)
        begin = (np.cumsum(self.counts) - self.counts)[here] if len(self.counts) else here
        first = np.cumsum(counts) - counts
        places = self.positions[np.repeat(begin - first, counts) + np.arange(int(counts.sum()))]
        return counts, first, np.repeat(np.arange(len(vocab)), counts) * int(self.lengths.sum()) + places


def phrase_matches(segment: Segment, windows: Windows, min_terms: int, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, terms in place) of each window found.

    A window is found where at least ``min_terms`` of its terms stand within ``slop`` words of
    their place in one document; places before its start or past its end are misses.  If so many
    agree, one of the ``n - min_terms + 1`` rarest terms does, so starting from every place within
    ``slop`` of these loses nothing.
    """
    n, found = windows.n, []
    nothing = (np.empty(0, np.int64),) * 3
    if not len(windows.terms) or not len(segment.positions):
        return nothing
    in_segment, first, keys = segment.lists(windows.vocab)
    if not len(keys):
        return nothing
    counts = in_segment[windows.terms]
    by_rarity = np.argsort(counts, axis=1, kind="stable")
    size, ends = int(segment.lengths.sum()), np.cumsum(segment.lengths)
    shifts = range(-slop, slop + 1)

    def stands(term: np.ndarray, place: np.ndarray) -> np.ndarray:
        want = term.astype(np.int64) * size + place
        at = np.searchsorted(keys, want)
        return (keys[np.minimum(at, len(keys) - 1)] == want) & (place >= 0) & (place < size)

    for start_rank in range(n - min_terms + 1):
        offset = by_rarity[:, start_rank]
        anchor = windows.terms[np.arange(len(offset)), offset]
        use = np.flatnonzero(((counts > 0).sum(axis=1) >= min_terms) & (in_segment[anchor] > 0))
        reps_all = in_segment[anchor[use]]
        total = np.cumsum(reps_all)
        lo = 0
        while lo < len(use):
            base = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, base + CANDIDATES, side="right")))
            part, reps = use[lo:hi], reps_all[lo:hi]
            win = np.repeat(part, reps)
            within = np.arange(len(win)) - np.repeat(np.cumsum(reps) - reps, reps)
            here = keys[np.repeat(first[anchor[part]], reps) + within] - anchor[win].astype(np.int64) * size
            doc = np.searchsorted(ends, here, side="right")
            pos = np.concatenate([here - offset[win] + d for d in shifts])
            win, doc = np.tile(win, len(shifts)), np.tile(doc, len(shifts))
            low, high = ends[doc] - segment.lengths[doc], ends[doc]
            if min_terms == n:  # each end has a term within slop of its place
                keep = (pos + slop >= low) & (pos + n - slop <= high)
                win, pos, doc, low, high = win[keep], pos[keep], doc[keep], low[keep], high[keep]
            hits = np.ones(len(win), np.int32)
            for left, k in zip(range(n - 2, -1, -1), (k for k in range(n) if k != start_rank)):
                o = by_rarity[win, k]
                term, ok = windows.terms[win, o], np.zeros(len(win), bool)
                for d in shifts:
                    place = pos + o + d
                    ok |= (place >= low) & (place < high) & stands(term, place)
                hits += ok
                keep = hits + left >= min_terms
                win, pos, doc, low, high, hits = (x[keep] for x in (win, pos, doc, low, high, hits))
            keep = hits >= min_terms
            found.append((win[keep], pos[keep], doc[keep], hits[keep]))
            lo = hi
    if not found:
        return nothing
    win, pos, doc, hits = (np.concatenate(x) for x in zip(*found))
    if min_terms < n or slop:  # a place can be reached from several anchors
        _, one = np.unique(np.stack([win, pos, doc]), axis=1, return_index=True)
        win, doc, hits = win[one], doc[one], hits[one]
    return doc, windows.owner[win], hits


def positional_index(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The stored index of a corpus: a table with a row per segment.

    Columns: ``doc_ids`` (null ids included), ``terms`` (one a line), and as packed 32-bit numbers
    ``counts`` (postings of each term), ``steps`` (positions, list after list) and ``lengths``
    (words of each document and one free place).  Null texts are left out; empty texts hold no terms.
    Repeated rows are indexed each.  Extra columns are ignored.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    id_type = slim.schema["doc_id"].dataType

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def out():
            doc_ids = pa.array([ids], pa.list_(kind))
            row = Segment.of(texts).row()
            return pa.record_batch(
                [doc_ids, pa.array([row["terms"]], pa.string()), *(pa.array([row[c]], pa.binary()) for c in ("counts", "steps", "lengths"))],
                names=["doc_ids", "terms", "counts", "steps", "lengths"],
            )

        kind = None
        for b in batches:
            kind = b.schema.field("doc_id").type
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                w = words(t)
                if texts and size + len(w) > SEGMENT_WORDS:
                    yield out()
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(w)
                size += len(w)
        if texts:
            yield out()

    schema = f"doc_ids array<{id_type.simpleString()}>, terms string, counts binary, steps binary, lengths binary"
    return materialize(slim.mapInArrow(segments, schema), "positional-index")


def leaked_items(
    index: DataFrame, items: DataFrame, item_id: str, item_text: str, run: int = RUN, min_terms: int | None = None, slop: int = 0
) -> DataFrame:
    """Documents of a ``positional_index`` that hold ``run`` consecutive words of a test item.

    Columns: ``doc_id, item_id, exact`` (all words in place, one after the other) and ``n_hits``
    (distinct starts at which a window of the item was found).  With ``min_terms`` below ``run`` or a
    ``slop`` above 0 proximity matches are returned too.  Null, empty and shorter texts match
    nothing.  Items with the same text are reported each.  A repeated document row is reported
    for each row.  Without items or documents there are no rows.  Extra columns are ignored.
    """
    min_terms = run if min_terms is None else min_terms
    spark = index.sparkSession
    tests = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter(F.col("text").isNotNull())
    size = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // (6 * BLOCK_WORDS)))
    types = index.schema["doc_ids"].dataType.elementType.simpleString(), dict(tests.dtypes)["item_id"]
    out = None
    for b in range(blocks):
        block = tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else tests
        windows = Windows([tuple(r) for r in block.collect()], run)
        found = _search(index, spark.sparkContext.broadcast(windows), types, min_terms, slop)
        out = found if out is None else out.unionByName(found)
    return out


def _search(index: DataFrame, shared, types: tuple[str, str], min_terms: int, slop: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        item_ids = pa.array(windows.ids)
        for b in batches:
            for k in range(b.num_rows):
                parts = [b.column(c)[k].as_py() for c in ("terms", "counts", "steps", "lengths")]
                doc, item, hits = phrase_matches(Segment.read(*parts), windows, min_terms, slop)
                pair, inverse, n = np.unique(doc * (len(windows.ids) + 1) + item, return_inverse=True, return_counts=True)
                best = np.zeros(len(pair), np.int64)
                np.maximum.at(best, inverse, hits)
                yield pa.record_batch(
                    [
                        b.column("doc_ids")[k].values.take(pa.array(pair // (len(windows.ids) + 1))),
                        item_ids.take(pa.array(pair % (len(windows.ids) + 1))),
                        pa.array((best == windows.n) & (slop == 0)),
                        pa.array(n.astype(np.int64)),
                    ],
                    names=["doc_id", "item_id", "exact", "n_hits"],
                )

    return index.mapInArrow(search, f"doc_id {types[0]}, item_id {types[1]}, exact boolean, n_hits long")
