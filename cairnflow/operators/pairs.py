"""Pairs of rows by the elements that they share, counted inside tasks."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cairnflow.sources.tables import in_parts

#: Rows that all others are held against in one pass.
PAIR_BLOCK = 16384
#: Elements that one of so many rows of a block holds are added as whole rows of bits, rarer ones by their places.
_DENSE = 256
#: Pairs that a task gathers before it returns them.
_FLUSH = 200_000

#: Reads of a table what a test needs; and whether row ``i`` of one makes a pair with the rows ``at`` of the block.
Prepare = Callable[[pa.Table], object]
Keep = Callable[[object, int, object, np.ndarray], np.ndarray]


def flat(column) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The elements, offsets and lengths of a list column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.list_flatten(column), np.concatenate([[0], np.cumsum(lengths)]), lengths


class _Counts:
    """How many elements each row of a block shares with a given one."""

    def __init__(self, elements):
        values, _, self.sizes = flat(elements)
        self.vocabulary = pc.unique(values)
        codes = pc.index_in(values, value_set=self.vocabulary).to_numpy(zero_copy_only=False)
        rows, n = np.repeat(np.arange(len(self.sizes)), self.sizes), len(self.vocabulary)
        held = np.bincount(codes, minlength=n)
        order = np.argsort(codes, kind="stable")
        self.places = np.split(rows[order], np.cumsum(held)[:-1])
        wide = np.uint8 if self.sizes.max(initial=0) < 256 else np.uint16 if self.sizes.max() < 65536 else np.uint32
        often = np.flatnonzero(held * _DENSE >= len(self.sizes))
        self.bits, self.kind = {}, wide
        for c in often:
            self.bits[int(c)] = b = np.zeros(len(self.sizes), wide)
            b[self.places[c]] = 1

    def codes(self, values: pa.Array) -> np.ndarray:
        """The places of elements in the block's vocabulary, or -1."""
        return pc.fill_null(pc.index_in(values, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False)

    def of(self, codes: list[int], lo: int) -> np.ndarray:
        """Counts of the block's rows from ``lo`` on."""
        out = np.zeros(len(self.sizes) - lo, self.kind)
        for c in codes:
            if c in self.bits:
                np.add(out, self.bits[c][lo:], out=out)
            else:
                p = self.places[c]
                out[p[np.searchsorted(p, lo) :] - lo] += 1
        return out


def sharing(
    rows: DataFrame, least: int, share: float = 0.0, without: DataFrame | None = None, test: tuple[Prepare, Keep] | None = None, latter: bool = False
) -> DataFrame:
    """``a, b, shared`` (a < b) of rows (``id``, distinct elements ``cs``) that share at least ``least`` elements and the ``share``
    of the longer list, but not the pairs ``without`` (a, b with a < b); ``test`` may read further columns.  With ``latter`` only
    ``b``, the rows that make a pair with a smaller id, each at least once.

    The rows are cut into ranges of ids of about ``PAIR_BLOCK``.  Each range is read by all tasks and held against all rows
    up to it; the counts of a row are sums of the bits of its elements, so candidates are never written nor moved: only
    what passes every condition leaves a task.  The work grows with the square of the rows."""
    rows = rows.filter(F.col("id").isNotNull() & (F.size("cs") >= least))
    if without is not None:
        known = without.groupBy(F.col("a").alias("id")).agg(F.collect_set("b").alias("_not"))
        rows = rows.join(known, "id", "left").withColumn("_not", F.coalesce("_not", F.array().cast("array<string>")))
    kept, parts = in_parts(rows, "pair-rows", ["id"], PAIR_BLOCK)
    out = None
    for k, block in enumerate(parts):
        found = _held(kept.filter(F.col("_part") <= k), block, least, share, without is not None, test, latter)
        out = found if out is None else out.unionByName(found)
    return out


def _held(rows: DataFrame, block: Callable[[], pa.Table], least: int, share: float, excluding: bool, test: tuple[Prepare, Keep] | None, latter: bool) -> DataFrame:
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = block()
        if not heads.num_rows:
            return
        names, counts = heads["id"].to_pylist(), _Counts(heads["cs"])
        place = {x: i for i, x in enumerate(names)} if excluding else {}
        own = test[0](heads) if test else None
        ids, hit = heads["id"].combine_chunks(), np.zeros(len(names), bool)

        def pairs(b: pa.RecordBatch, of: list) -> pa.RecordBatch:
            at = np.concatenate([x[1] for x in of])
            first = np.repeat([x[0] for x in of], [len(x[1]) for x in of])
            return pa.record_batch([b.column("id").take(pa.array(first)), ids.take(pa.array(at)), pa.array(np.concatenate([x[2] for x in of]), pa.int64())], names=["a", "b", "shared"])

        for b in batches:
            values, starts, sizes = flat(b.column("cs"))
            codes, mine = counts.codes(values), test[0](pa.Table.from_batches([b])) if test else None
            not_ = b.column("_not").to_pylist() if excluding else None
            gathered, n = [], 0
            for i, name in enumerate(b.column("id").to_pylist()):
                lo = bisect_right(names, name)
                held = [c for c in codes[starts[i] : starts[i + 1]].tolist() if c >= 0]
                need = max(least, int(np.ceil(share * sizes[i] - 1e-9)))
                if lo == len(names) or len(held) < need:
                    continue
                count = counts.of(held, lo)
                for x in not_[i] if excluding else ():
                    if (p := place.get(x, -1)) >= lo:
                        count[p - lo] = 0
                at = np.flatnonzero(count >= need)
                if share:
                    at = at[count[at] >= share * counts.sizes[at + lo] - 1e-9]
                if test and len(at):
                    at = at[test[1](mine, i, own, at + lo)]
                if latter:
                    hit[at + lo] = True
                elif len(at):
                    gathered.append((i, at + lo, count[at]))
                    n += len(at)
                if n >= _FLUSH:
                    yield pairs(b, gathered)
                    gathered, n = [], 0
            if gathered:
                yield pairs(b, gathered)
        if latter:
            yield pa.record_batch([ids.filter(pa.array(hit))], names=["b"])

    return rows.mapInArrow(run, f"b {kind}" if latter else f"a {kind}, b {kind}, shared long")
