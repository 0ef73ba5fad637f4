"""Aggregations over memories, feedback and usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairnflow.functions import exprs as X
from cairnflow.operators import chunks


def state_counts(memories: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    states = ["active", "fading", "archived", "merged"]
    return memories.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in states]
    )


def top_values(df: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """keys, ``value, n, rank``: the most frequent values of each key, ties by value.

    Counted before ranked, so the window only sees one row per key and value."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), value)
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def usage_summary(usage: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals and totals by each key in one pass over the data (grouping sets)."""
    sets = [[], *[[k] for k in keys]]
    cols = [F.col(k) for k in keys]
    grouped = usage.groupingSets([[F.col(k) for k in s] for s in sets], *cols)
    return grouped.agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).alias("n"),
        F.sum("tokens").alias("tokens"),
        F.count_if(~F.col("success")).alias("errors"),
    ).select(
        F.when(F.col("gid") == (1 << len(keys)) - 1, "all").otherwise(F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in keys])).alias("dimension"),
        F.coalesce(*[F.col(k).cast("string") for k in keys], F.lit("")).alias("value"),
        "n", F.round("tokens", 4).alias("tokens"), "errors",
    )


def chart(usage: DataFrame, ts: str, minutes: int, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per time bucket (aligned to the epoch)."""
    bucket = F.window(F.col(ts), f"{minutes} minutes")
    return usage.groupBy(*keys, bucket.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("tokens"), 4).alias("tokens"), F.count_if(~F.col("success")).alias("errors")
    ).select(*keys, F.col("w.start").alias("bucket"), "n", "tokens", "errors")


def recall_bucket(count: Column) -> Column:
    return F.when(count == 0, "0").when(count <= 2, "1-2").when(count <= 5, "3-5").otherwise("6+")


def salience_tier(s: Column) -> Column:
    return F.when(s >= 0.8, "critical").when(s >= 0.5, "high").when(s >= 0.3, "medium").otherwise("low")


def mean_vector(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Element-wise mean of the usable vectors of a key: keys, ``pos, mean``; partial sums before the shuffle."""
    each = df.filter(X.usable_vector(F.col(vector))).select(*keys, F.posexplode(vector).alias("pos", "x"))
    return each.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def nth_percentile(df: DataFrame, keys: Sequence[str], value: str, share: float) -> DataFrame:
    """The element at place ``int(share * n)`` of the sorted values (not an interpolation), from counts per value."""
    return chunks.nth(df, keys, value, share).withColumnRenamed(value, "value")
