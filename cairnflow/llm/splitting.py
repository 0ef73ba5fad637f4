"""Splitting oversized texts at natural boundaries by agglomerative merging.

A text starts as atoms: lines and sentences, and where one of these alone is over the limit,
its clauses, its words, and at last pieces of plain characters.  All adjacent pairs stand in
a heap, the weakest boundary (then the smallest joint size) first; a pair is merged while its
joint size, with the overlap that a later piece opens with, stays under the limit.  Sizes only
grow, so a pair that does not fit once is dropped for good.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

LIMIT, OVERLAP = 4_000, 200

#: Pauses from strong to weak: blank line, line, sentence, clause, word.
_PAUSES = [
    (5, re.compile(r"\n[ \t\r]*\n\s*")),
    (4, re.compile(r"\n")),
    (3, re.compile(r"[.!?…。！？][\"'”’)\]]*\s+|[。！？]")),
    (2, re.compile(r"[,;:)\]}]\s+")),
    (1, re.compile(r"\s+")),
]


def _cuts(text: str, start: int, end: int, rank: int) -> list[tuple[int, int]]:
    """(position, strength) of the pauses of strength ``rank`` inside text[start:end]."""
    pattern = _PAUSES[5 - rank][1]
    return [(m.end(), rank) for m in pattern.finditer(text, start, end) if start < m.end() < end]


def atoms(text: str, room: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary at the end) of the smallest segments."""
    found: dict[int, int] = {}
    for rank in (5, 4, 3):
        for at, s in _cuts(text, 0, len(text), rank):
            found.setdefault(at, s)
    for rank in (2, 1):
        edges = [0, *sorted(found), len(text)]
        for a, b in zip(edges, edges[1:]):
            if b - a > room:
                for at, s in _cuts(text, a, b, rank):
                    found.setdefault(at, s)
    edges = [0, *sorted(found), len(text)]
    for a, b in zip(edges, edges[1:]):
        for at in range(a + room, b, room):
            found[at] = 0
    edges = [0, *sorted(found), len(text)]
    return [(a, b, found.get(b, 9)) for a, b in zip(edges, edges[1:]) if b > a]


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start of the overlap, start, end) of each piece; text[start:end] of all pieces joined is the text."""
    if len(text) <= limit:
        return [(0, 0, len(text))] if text else []
    seg = atoms(text, limit - overlap)
    n = len(seg)
    start, end, strength = [a for a, _, _ in seg], [b for _, b, _ in seg], [s for _, _, s in seg]
    after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n

    def fits(i: int, j: int) -> bool:
        return end[j] - start[i] + (overlap if start[i] else 0) <= limit

    heap = [(strength[i], end[i + 1] - start[i], i, i + 1) for i in range(n - 1) if fits(i, i + 1)]
    heapq.heapify(heap)
    while heap:
        s, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or after[i] != j or end[j] - start[i] != size:
            continue
        end[i], strength[i], after[i], alive[j] = end[j], strength[j], after[j], False
        if after[i] >= 0:
            before[after[i]] = i
            if fits(i, after[i]):
                heapq.heappush(heap, (strength[i], end[after[i]] - start[i], i, after[i]))
        if before[i] >= 0 and fits(before[i], i):
            heapq.heappush(heap, (strength[before[i]], end[i] - start[before[i]], before[i], i))
    out, i, last = [], 0, 0
    while i >= 0:
        lead = max(last, start[i] - overlap) if start[i] else 0
        if start[i] and (m := re.compile(r"\s\S").search(text, lead, start[i])) and lead > last:
            lead = m.start() + 1
        out.append((lead, start[i], end[i]))
        last, i = start[i], after[i]
    return out


def split_items(
    items: DataFrame, item_id: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP
) -> DataFrame:
    """Pieces of every item whose text has more than ``limit`` characters (code points).

    Columns: ``item_id, piece, n_pieces, start, overlap, text``.  ``text`` opens with
    ``overlap`` characters of the piece before; the rest of all pieces in order is the whole
    text.  Null and short texts give no rows.  A row delivered twice (same id and text)
    counts once; a null id is kept as it is.  Extra columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    long = (
        items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
        .filter(F.length("text") > limit)
        .dropDuplicates(["item_id", "text"])
    )
    id_type = dict(long.dtypes)["item_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["item_id"].tolist(), pdf["text"].tolist()):
                pieces = split(t, limit, overlap)
                rows += [(i, k, len(pieces), a, a - lead, t[lead:b]) for k, (lead, a, b) in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=["item_id", "piece", "n_pieces", "start", "overlap", "text"])

    return long.mapInPandas(
        run, f"item_id {id_type}, piece int, n_pieces int, start int, overlap int, text string"
    )
