"""Snapshot semantics of a mutable row store: every write is a function from snapshot to snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairnflow.functions import exprs as X
from cairnflow.operators import chunks


def insert_ignore(snapshot: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the rows whose key is new; null keys never clash.  Of new rows with one key the first by all columns stays."""
    order = [c for c in rows.columns if dict(rows.dtypes)[c].split("<")[0] not in ("map",)]
    first = Window.partitionBy(*keys).orderBy(*order)
    known = F.lit(True)
    for k in keys:
        known &= F.col(k).isNotNull()
    keyed = rows.filter(known).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    fresh = keyed.join(snapshot.select(*keys).distinct(), list(keys), "left_anti")
    return snapshot.unionByName(fresh.select(snapshot.columns)).unionByName(rows.filter(~known).select(snapshot.columns))


def upsert_latest(snapshot: DataFrame, rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Of all rows of a key the one with the latest ``version`` stays; ties keep the incoming row."""
    both = snapshot.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(version), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_new")


def update(snapshot: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """New values where a change has one that is not null."""
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = snapshot.join(new, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}).drop(*[f"_{c}" for c in columns])


def increment_access(memories: DataFrame, accesses: DataFrame) -> DataFrame:
    """``access_count`` plus the number of accesses (``id, at``), ``last_accessed`` the latest of them."""
    n = accesses.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.max("at").alias("_at"))
    return (
        memories.join(n, "id", "left")
        .withColumns(
            {
                "access_count": F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0)),
                "last_accessed": F.greatest("last_accessed", "_at"),
            }
        )
        .drop("_n", "_at")
    )


def amend(memories: DataFrame, amendments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories with new content and summary and 0.05 more salience, at most 1; audit rows with old and new text)."""
    new = amendments.select(F.col("memory_id").alias("id"), F.col("new_content").alias("_c"), F.col("new_summary").alias("_s"), F.col("amended_at").alias("_at"))
    joined = memories.join(new, "id", "left")
    hit = F.col("_c").isNotNull() | F.col("_s").isNotNull()
    audit = joined.filter(hit).select(
        F.col("id").alias("memory_id"), F.col("content").alias("old_content"), F.coalesce("_c", "content").alias("new_content"),
        F.col("summary").alias("old_summary"), F.coalesce("_s", "summary").alias("new_summary"), F.col("_at").alias("amended_at"),
    )
    after = joined.withColumns(
        {
            "content": F.coalesce("_c", "content"),
            "summary": F.coalesce("_s", "summary"),
            "salience": F.when(hit, F.least(F.lit(1.0), F.col("salience") + 0.05)).otherwise(F.col("salience")),
        }
    ).drop("_c", "_s", "_at")
    return after, audit


def source_priority(source: Column) -> Column:
    s = F.lower(F.trim(source))
    return F.when(s == "mcp", 0).when(s == "terminal", 1).when(s == "clipboard", 2).otherwise(3)


def claim(raw: DataFrame, n: int) -> DataFrame:
    """The next ``n`` unprocessed observations by priority of the source, then arrival."""
    order = [source_priority(F.col("source")), F.col("created_at"), F.col("id")]
    return raw.filter(~F.coalesce("processed", F.lit(False))).orderBy(*order).limit(n)


def mark(raw: DataFrame, batch: DataFrame) -> DataFrame:
    """The observations of ``batch`` processed, if they were not yet: compare and set."""
    hit = batch.select("id", F.lit(True).alias("_m")).distinct()
    return raw.join(hit, "id", "left").withColumn("processed", F.coalesce("processed", F.lit(False)) | F.coalesce("_m", F.lit(False))).select(raw.columns)


def unclaim(raw: DataFrame, batch: DataFrame) -> DataFrame:
    """The observations of ``batch`` given back to the queue."""
    hit = batch.select("id", F.lit(True).alias("_m")).distinct()
    return raw.join(hit, "id", "left").withColumn("processed", F.when(F.col("_m"), False).otherwise(F.col("processed"))).select(raw.columns)


def seen_before(raw: DataFrame, hours: int = 24) -> DataFrame:
    """``id, timestamp, seen_before``: whether the same content hash occurred within the hours before."""
    order = ["timestamp", "id"]
    parts = chunks.lagged(chunks.chunked(raw.select("id", "timestamp", "content_hash"), ["content_hash"], order), ["content_hash"], order, "timestamp", "_b")
    again = F.coalesce(F.col("timestamp") - F.col("_b.x") <= F.expr(f"INTERVAL {hours} HOURS"), F.lit(False))
    return parts.select("id", "timestamp", (F.col("content_hash").isNotNull() & again).alias("seen_before"))


def latest_delivery(raw: DataFrame) -> DataFrame:
    """One row per id: the latest delivery."""
    w = Window.partitionBy("id").orderBy(F.desc_nulls_last("created_at"))
    return raw.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def mark_paths(raw: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Observations whose path contains one of the patterns."""
    path = F.get_json_object("metadata", "$.path")
    return raw.withColumn("path", path).filter(F.coalesce(X.any_of(path, patterns), F.lit(False)))


def violations(memories: DataFrame, edges: DataFrame, raw: DataFrame) -> DataFrame:
    """``check, violations`` of keys and references."""
    n = F.count(F.lit(1)).alias("violations")
    ids = memories.select("id")
    checks = {
        "memory id repeated": memories.groupBy("id").count().filter("count > 1"),
        "raw_id repeated": memories.filter("raw_id IS NOT NULL").groupBy("raw_id").count().filter("count > 1"),
        "raw_id unknown": memories.filter("raw_id IS NOT NULL").join(raw.select(F.col("id").alias("raw_id")), "raw_id", "left_anti"),
        "edge repeated": edges.groupBy("source_id", "target_id").count().filter("count > 1"),
        "edge source unknown": edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti"),
        "edge target unknown": edges.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti"),
        "edge to itself": edges.filter("source_id = target_id"),
    }
    out = None
    for name, df in checks.items():
        part = df.agg(n).select(F.lit(name).alias("check"), "violations")
        out = part if out is None else out.unionByName(part)
    return out
