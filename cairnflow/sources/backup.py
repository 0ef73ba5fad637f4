"""Snapshots, exports and imports of tables; token shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairnflow.operators.store import insert_ignore


def export_json(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """One folder of JSON lines per table and one of counts; written by the executors, committed by rename."""
    counts = None
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        counts = row if counts is None else counts.unionByName(row)
    counts.coalesce(1).write.mode("overwrite").json(f"{path}/_metadata")
    return counts


def import_json(spark: SparkSession, path: str, name: str, current: DataFrame, keys: Sequence[str], mode: str = "merge") -> DataFrame:
    """``merge`` adds the rows with new keys, ``replace`` takes the imported table alone."""
    rows = spark.read.schema(current.schema).json(f"{path}/{name}")
    if mode == "replace":
        return rows
    if mode != "merge":
        raise ValueError(f"mode {mode!r}: merge or replace")
    return insert_ignore(current, rows, keys)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line by a stated schema; no inference pass.  Broken lines come out as nulls."""
    return spark.read.schema(schema).json(path)


def write_snapshot(df: DataFrame, root: str, version: str) -> str:
    path = f"{root}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def versions_to_drop(versions: Sequence[str], keep: int) -> list[str]:
    """Versions beyond the ``keep`` latest."""
    return sorted(versions)[: max(0, len(versions) - keep)]


def write_token_shards(tokens: DataFrame, path: str, size: int) -> None:
    """``position, token`` as packed little-endian 16-bit shards: one row per shard with its bytes.

    Partitioned by shard, so a task holds one shard of bounded size at a time."""
    lo = F.lpad(F.conv(F.expr("token % 256").cast("string"), 10, 16), 2, "0")
    hi = F.lpad(F.conv(F.expr("token div 256").cast("string"), 10, 16), 2, "0")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", F.concat(lo, hi).alias("h")))), lambda x: x["h"])
    shard = F.expr(f"position div {size}")
    (
        tokens.groupBy(shard.alias("shard"))
        .agg(F.count(F.lit(1)).alias("n"), F.unhex(F.array_join(ordered, "")).alias("data"))
        .write.mode("overwrite").parquet(path)
    )


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """``shard, ids`` of packed shards."""
    h = F.hex("data")
    code = lambda i, k: F.conv(F.substr(h, i * 4 + k, F.lit(2)), 16, 10).cast("int")
    ids = F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda i: code(i, 1) + 256 * code(i, 3))
    return spark.read.parquet(path).select("shard", ids.alias("ids"))
