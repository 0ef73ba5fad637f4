"""Runs of repeated consecutive events, by the difference of two row numbers.

Within an entity every event has a row number; within entity and value it has another.
Along a run of equal values both grow by one, so their difference is constant, and (value,
difference) names the run.  A counter of breaks (silences longer than the allowed gap)
splits runs further.

Scale: row numbers over a whole entity would put a hot entity into one task.  Events are
range-partitioned by (entity, time, id) instead, so a hot entity spans many chunks; the row
numbers are taken within (chunk, entity), runs are aggregated inside their chunk, and only the
first and the last run of each (chunk, entity) are looked at again to join runs across the
chunk edges: at most two rows per chunk and entity.  Everything stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairnflow.functions.streams import from_micros, micros, stream_keys
from cairnflow.sources.tables import materialize


def canonical(c: Column) -> Column:
    """Lower case without all signs other than letters and digits; null stays null."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def consecutive_runs(
    events: DataFrame,
    entity: Sequence[str],
    ts: str,
    event_id: str,
    value: Column,
    max_gap_us: int | None = None,
    min_count: int = 1,
) -> DataFrame:
    """Maximal runs of consecutive events with the same ``value``.

    Columns: the entity columns, ``value, first_id, last_id, start_ts, end_ts, duration_us,
    n_events``.  With ``max_gap_us`` an event continues a run only if it follows the event
    before by at most that long.

    A null value never starts or continues a run, but it does separate the events around
    it.  Events without time or id are left out.  A row repeated with the same entity, time
    and id counts once.  Equal times are ordered by id.  Null entity values form one entity.
    """
    entity = list(entity)
    keys = [f"_e{i}" for i in range(len(entity))]
    slim = events.select(
        *[F.col(c).alias(k) for c, k in zip(entity, keys)],
        micros(events, ts).alias("_us"),
        F.col(event_id).cast("string").alias("_id"),
        value.alias("_v"),
    ).filter(F.col("_us").isNotNull() & F.col("_id").isNotNull())
    chunked = slim.repartitionByRange(*keys, "_us", "_id").withColumn("_chunk", F.spark_partition_id())

    part = ["_chunk", *keys]
    w = Window.partitionBy(*part).orderBy("_us", "_id")
    by_value = Window.partitionBy(*part, "_v").orderBy("_us", "_id")
    once = chunked.withColumns({"_pu": F.lag("_us").over(w), "_pi": F.lag("_id").over(w)}).filter(
        F.col("_pi").isNull() | (F.col("_pi") != F.col("_id")) | (F.col("_pu") != F.col("_us"))
    )
    far = F.lit(0) if max_gap_us is None else (F.col("_us") - F.col("_pu") > max_gap_us).cast("int")
    numbered = once.withColumns(
        {
            "_rn": F.row_number().over(w),
            "_breaks": F.sum(F.coalesce(far, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "_rv": F.row_number().over(by_value),
        }
    )
    local = (
        numbered.groupBy(*part, "_v", (F.col("_rn") - F.col("_rv")).alias("_diff"), "_breaks")
        .agg(
            F.min(F.struct("_us", "_id")).alias("_first"),
            F.max(F.struct("_us", "_id")).alias("_last"),
            F.count(F.lit(1)).alias("_n"),
        )
        .drop("_diff", "_breaks")
    )
    edge = Window.partitionBy(*part)
    local = materialize(
        local.withColumns(
            {
                "_opens": F.col("_first") == F.min("_first").over(edge),
                "_closes": F.col("_last") == F.max("_last").over(edge),
            }
        ),
        "runs",
    )

    outer = F.col("_opens") | F.col("_closes")
    we = Window.partitionBy(*keys).orderBy("_first")
    follows = (
        F.col("_opens")
        & F.lag("_closes").over(we)
        & (F.lag("_chunk").over(we) != F.col("_chunk"))
        & (F.lag("_v").over(we) == F.col("_v"))
    )
    if max_gap_us is not None:
        follows &= F.col("_first._us") - F.lag("_last._us").over(we) <= max_gap_us
    joined = (
        local.filter(outer)
        .withColumn("_new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(we.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_run")
        .agg(
            F.first("_v").alias("_v"),
            F.min("_first").alias("_first"),
            F.max("_last").alias("_last"),
            F.sum("_n").alias("_n"),
        )
    )
    cols = [*keys, "_v", "_first", "_last", "_n"]
    runs = local.filter(~outer).select(*cols).unionByName(joined.select(*cols))
    return (
        runs.filter(F.col("_v").isNotNull() & (F.col("_n") >= min_count))
        .withColumns({"_fu": F.col("_first._us"), "_lu": F.col("_last._us")})
        .select(
            *[F.col(k).alias(c) for k, c in zip(keys, entity)],
            F.col("_v").alias("value"),
            F.col("_first._id").alias("first_id"),
            F.col("_last._id").alias("last_id"),
            from_micros("_fu").alias("start_ts"),
            from_micros("_lu").alias("end_ts"),
            (F.col("_lu") - F.col("_fu")).alias("duration_us"),
            F.col("_n").alias("n_events"),
        )
    )


def stream_runs(raw_memories: DataFrame, max_gap_minutes: float = 10, min_count: int = 3) -> DataFrame:
    """Runs of the same ``type`` in each project's source of raw observations."""
    return consecutive_runs(
        stream_keys(raw_memories),
        ["stream_project", "stream_source"],
        "timestamp",
        "id",
        canonical(F.col("type")),
        int(max_gap_minutes * 60_000_000),
        min_count,
    )
