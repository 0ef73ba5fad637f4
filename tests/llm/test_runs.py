import datetime as dt
import random

from pyspark.sql import functions as F, types as T

from cairnflow.llm import runs

SCHEMA = T.StructType(
    [
        T.StructField("who", T.StringType()),
        T.StructField("at", T.TimestampNTZType()),
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)
T0 = dt.datetime(2024, 1, 1)


def brute(rows, gap):
    by = {}
    for who, at, i, v, _ in set(rows):
        if at is not None and i is not None:
            by.setdefault(who, []).append((at, i, v))
    out = set()
    for who, ev in by.items():
        ev.sort(key=lambda e: e[:2])
        run = []
        for e in ev + [None]:
            if run and e is not None and e[2] is not None and e[2] == run[-1][2] and e[0] - run[-1][0] <= gap:
                run.append(e)
                continue
            if run and run[0][2] is not None:
                out.add((who, run[0][2], run[0][1], run[-1][1], len(run)))
            run = [e]
    return out


def test_runs_across_many_chunks(spark):
    rng = random.Random(5)
    rows, at = [], T0
    for k in range(700):
        at += dt.timedelta(seconds=rng.choice([0, 5, 30, 61]))
        who = rng.choice(["hot"] * 9 + ["a", None])
        v = "x" if 200 < k < 420 else rng.choice(["x", "x", "x", "y", None])
        rows.append((who, at, f"i{k:04d}", v, "clash"))
    rows += rows[:30] + [("a", None, "n", "x", ""), ("a", T0, None, "x", "")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        got = runs.consecutive_runs(df, ["who"], "at", "id", F.col("type"), 60 * 10**6).collect()
        assert {(r.who, r.value, r.first_id, r.last_id, r.n_events) for r in got} == brute(rows, dt.timedelta(seconds=60))
        assert len(got) == len(brute(rows, dt.timedelta(seconds=60)))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_and_canonical(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert runs.consecutive_runs(df, ["who"], "at", "id", F.col("type")).count() == 0
    df = spark.createDataFrame([("File_Modified ",), ("fileModified",), ("Größe-1",), (None,)], "t string")
    assert [r[0] for r in df.select(runs.canonical(F.col("t"))).collect()] == ["filemodified", "filemodified", "größe1", None]
