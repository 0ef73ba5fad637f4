"""Row numbers, previous rows and carried values of keys of any size, in range chunks.

A window partitioned by a key is one task for the key, however hot.  Here the rows are range-partitioned by key and
order and the chunks are written; a window runs inside each chunk and key only.  In this order only the first key of a
chunk can have rows in chunks before, so what has to be carried over is one row for each chunk, which is broadcast: its
bound is the number of partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairnflow.sources.tables import materialize


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``_p``, the number of the chunk of (keys, order) that a row lies in; written once."""
    by = [F.col(c) for c in (*keys, *order)]
    return materialize(df.repartitionByRange(*by).withColumn("_p", F.spark_partition_id()), "chunks")


def _carry(parts: DataFrame, keys: Sequence[str], ends: DataFrame, value: Column) -> DataFrame:
    """parts with ``_c``: ``value`` over the ``ends`` (``_p``, keys) of a key's chunks before; null where there is none."""
    w = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk of a key
    before = ends.withColumn("_c", value.over(w)).filter(F.col("_c").isNotNull())
    b = before.select(F.col("_p").alias("_q"), *[F.col(k).alias(f"_k_{k}") for k in keys], "_c")
    test = F.col("_p") == F.col("_q")
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return parts.join(F.broadcast(b), test, "left").drop("_q", *[f"_k_{k}" for k in keys])


def lagged(parts: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: ``value`` of the row before within the keys, as a struct ``(x)`` that is null for a key's first row."""
    w = Window.partitionBy("_p", *keys).orderBy(*order)
    x = F.struct(F.col(value).alias("x"))
    ends = parts.groupBy("_p", *keys).agg(F.max_by(x, F.struct(*order)).alias("_x"))
    out = _carry(parts, keys, ends, F.last("_x"))
    return out.withColumn(name, F.coalesce(F.lag(x).over(w), "_c")).drop("_c")


def carried(parts: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the last ``value`` that is not null up to each row within the keys."""
    w = Window.partitionBy("_p", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = parts.groupBy("_p", *keys).agg(F.max_by(value, known).alias("_x"))
    out = _carry(parts, keys, ends, F.last("_x", ignorenulls=True))
    return out.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(w), "_c")).drop("_c")


def numbered(parts: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``: the number of the row within the keys, from 1."""
    w = Window.partitionBy("_p", *keys).orderBy(*order)
    ends = parts.groupBy("_p", *keys).agg(F.count(F.lit(1)).alias("_x"))
    out = _carry(parts, keys, ends, F.sum("_x"))
    return out.withColumn(name, F.row_number().over(w) + F.coalesce("_c", F.lit(0))).drop("_c")


def nth(df: DataFrame, keys: Sequence[str], value: str, share: float) -> DataFrame:
    """keys, ``value``: the element at place ``int(share * n)`` of the sorted values of each key, nulls left out."""
    d = df.filter(F.col(value).isNotNull()).select(*keys, value)
    n = d.groupBy(*[F.col(k).alias(f"_n_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    counts = chunked(d.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_m")), keys, [value])
    w = Window.partitionBy("_p", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ends = counts.groupBy("_p", *keys).agg(F.sum("_m").alias("_x"))
    run = _carry(counts, keys, ends, F.sum("_x")).withColumn("_to", F.sum("_m").over(w) + F.coalesce("_c", F.lit(0)))
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"_n_{k}"))
    place = F.floor(F.col("_n") * share) + 1
    return run.join(n, test).filter((place <= F.col("_to")) & (place > F.col("_to") - F.col("_m"))).select(*keys, value)
