"""Sessions from a Cartesian tree over the gaps between consecutive events.

The events of one entity, in time order, have a gap between each two neighbours.  The
max-Cartesian tree over these gaps answers every gap setting at once: a node whose gap is
``g`` and whose parent's gap is ``p`` is a session for exactly the thresholds ``t`` with
``g <= t < p`` (single events have ``g = -1``, the root has no parent).  Cutting the tree is
therefore a plain filter over the node table.

Scale: one range shuffle by (entity, time, id) gives every task an equal share however few
entities there are; a hot entity simply spans many chunks.  Each chunk builds its part of
the tree in one pass with a stack.  Of the first and the last entity of a chunk, only the
spine (the gaps no smaller than all gaps before or after them) is still open at the chunk's
edge; it is merged over chunks in two levels.  A spine of strictly growing gaps within a time span T
holds at most sqrt(2 T) gaps and is of logarithmic length for gaps in no special order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from cairnflow.functions.streams import from_micros, micros, stream_keys
from cairnflow.sources.tables import materialize

#: Chunks merged by one task on the first merge level.
FAN_IN = 64

_NODE = ["first_us", "first_id", "last_us", "last_id", "n_events", "gap_us"]


class _Stack:
    """Blocks of merged events and the gaps between them, contracted as far as is certain."""

    def __init__(self, emit, closed_left: bool):
        self.emit, self.closed, self.blocks, self.gaps = emit, closed_left, [], []

    def push(self, block: tuple) -> None:
        if self.blocks:
            gap = block[0] - self.blocks[-1][2]
            self.fold(gap)
            self.gaps.append(gap)
        self.blocks.append(block)

    def fold(self, bound: float) -> None:
        """Contract from the right while the last gap is a local minimum and at most ``bound``."""
        gaps, blocks = self.gaps, self.blocks
        while gaps and gaps[-1] <= bound and (gaps[-2] >= gaps[-1] if len(gaps) > 1 else self.closed):
            g, right, left = gaps.pop(), blocks.pop(), blocks.pop()
            if left[5] < g:
                self.emit(left, g)
            if right[5] < g:
                self.emit(right, g)
            blocks.append((left[0], left[1], right[2], right[3], left[4] + right[4], g))

    def close(self) -> None:
        """The entity ends here (and began at the left edge): resolve everything."""
        self.fold(float("inf"))
        self.emit(self.blocks[0], None)


def _emitter(out: list, thresholds: Sequence[int] | None, key: tuple):
    if thresholds is None:
        return lambda b, parent: out.append((*key, *b, parent))

    def emit(b, parent):
        if any(b[5] <= t and (parent is None or t < parent) for t in thresholds):
            out.append((*key, *b, parent))

    return emit


def gap_tree(
    events: DataFrame,
    entity: Sequence[str],
    ts: str,
    event_id: str,
    thresholds_us: Sequence[int] | None = None,
) -> DataFrame:
    """Node table of the gap tree of each entity.

    Columns: the entity columns, ``first_us, first_id, last_us, last_id, n_events, gap_us,
    parent_gap_us`` (null for the root).  With ``thresholds_us`` only nodes that are a
    session for one of these settings are returned; the tree that is built is the same.

    Rows with a null time or a null id have no place in the order and are left out.  Null
    entity values form an entity of their own.  A row repeated with the same entity, time
    and id counts once.  Equal times are ordered by id.  Extra columns are ignored.
    """
    entity = list(entity)
    keys = [f"_e{i}" for i in range(len(entity))]
    slim = events.select(
        *[F.col(c).alias(k) for c, k in zip(entity, keys)],
        micros(events, ts).alias("_us"),
        F.col(event_id).cast("string").alias("_id"),
    ).filter(F.col("_us").isNotNull() & F.col("_id").isNotNull())
    types = {f.name: f.dataType for f in slim.schema.fields}
    key_fields = [T.StructField(k, types[k]) for k in keys]
    node_fields = [
        T.StructField("first_us", T.LongType()),
        T.StructField("first_id", T.StringType()),
        T.StructField("last_us", T.LongType()),
        T.StructField("last_id", T.StringType()),
        T.StructField("n_events", T.LongType()),
        T.StructField("gap_us", T.LongType()),
        T.StructField("parent_gap_us", T.LongType()),
    ]
    open_fields = [T.StructField("chunk", T.IntegerType()), T.StructField("seq", T.IntegerType())]
    schema = T.StructType(key_fields + node_fields + open_fields)
    names = schema.names

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype(
            {"parent_gap_us": "Int64", "chunk": "Int32", "seq": "Int32"}
        )

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list = []
        done: list = []
        current, stack, last, first_entity, chunk = None, None, None, True, None
        for pdf in batches:
            cols = [pdf[k].tolist() for k in keys]
            for *key, us, i, c in zip(*cols, pdf["_us"].tolist(), pdf["_id"].tolist(), pdf["_chunk"].tolist()):
                key = tuple(None if v != v else v for v in key)
                if stack is None or key != current:
                    if stack is not None:
                        if first_entity:
                            out += _spine(current, stack, chunk)
                        else:
                            stack.close()
                        first_entity = False
                        out += [(*r, None, None) for r in done]
                        done.clear()
                    current, chunk, last = key, c, None
                    stack = _Stack(_emitter(done, thresholds_us, key), not first_entity)
                if (us, i) == last:
                    continue
                last = (us, i)
                stack.push((us, i, us, i, 1, -1))
            if len(out) > 50_000:
                yield frame(out)
                out = []
        if stack is not None:
            out += [(*r, None, None) for r in done] + _spine(current, stack, chunk)
        if out:
            yield frame(out)

    def merge(final: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["chunk", "seq"])
            key = tuple(None if pd.isna(v) else v for v in (pdf[k].iloc[0] for k in keys))
            done: list = []
            stack = _Stack(_emitter(done, thresholds_us, key), final)
            for block in zip(*(pdf[c].tolist() for c in _NODE)):
                stack.push(block)
            if final:
                stack.close()
                rows = []
            else:
                rows = _spine(key, stack, int(pdf["chunk"].iloc[0]))
            return frame([(*r, None, None) for r in done] + rows)

        return run

    ordered = (
        slim.repartitionByRange(*[F.col(k) for k in keys], F.col("_us"), F.col("_id"))
        .sortWithinPartitions(*keys, "_us", "_id")
        .withColumn("_chunk", F.spark_partition_id())
    )
    parts = materialize(ordered.mapInPandas(build, schema), "gap-tree")
    is_open = F.col("chunk").isNotNull()
    local = parts.filter(~is_open)
    level1 = materialize(
        parts.filter(is_open)
        .groupBy(*keys, F.expr(f"chunk div {FAN_IN}"))
        .applyInPandas(lambda k, pdf: merge(False)(pdf), schema),
        "gap-tree-merge",
    )
    level2 = level1.filter(is_open).groupBy(*keys).applyInPandas(merge(True), schema)
    nodes = local.unionByName(level1.filter(~is_open)).unionByName(level2)
    return nodes.select(
        *[F.col(k).alias(c) for k, c in zip(keys, entity)], *[f.name for f in node_fields]
    )


def _spine(key: tuple, stack: _Stack, chunk: int) -> list:
    """What a chunk cannot resolve alone, in order."""
    return [(*key, *b, None, chunk, n) for n, b in enumerate(stack.blocks)]


def cut(nodes: DataFrame, gap_us: int) -> DataFrame:
    """The sessions of a node table for one gap setting: silence of more than ``gap_us`` splits."""
    return nodes.filter(
        (F.col("gap_us") <= gap_us)
        & (F.col("parent_gap_us").isNull() | (F.col("parent_gap_us") > gap_us))
    )


def sessions(
    events: DataFrame, entity: Sequence[str], ts: str, event_id: str, gap_us: int
) -> DataFrame:
    """Sessions of each entity for one gap setting.

    Columns: the entity columns, ``first_id, last_id, start_ts, end_ts, duration_us,
    n_events``.  A gap of exactly ``gap_us`` does not split.  An empty input gives no rows.
    """
    nodes = gap_tree(events, entity, ts, event_id, [gap_us])
    return cut(nodes, gap_us).select(
        *entity,
        "first_id",
        "last_id",
        from_micros("first_us").alias("start_ts"),
        from_micros("last_us").alias("end_ts"),
        (F.col("last_us") - F.col("first_us")).alias("duration_us"),
        "n_events",
    )


def stream_sessions(raw_memories: DataFrame, gap_minutes: float = 30) -> DataFrame:
    """Sessions of each project's source in raw observations."""
    return sessions(
        stream_keys(raw_memories),
        ["stream_project", "stream_source"],
        "timestamp",
        "id",
        int(gap_minutes * 60_000_000),
    )
