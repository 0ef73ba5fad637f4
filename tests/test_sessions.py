import datetime as dt
import random

import pytest
from pyspark.sql import functions as F, types as T

from cairnflow.operators import sessions as S

SCHEMA = T.StructType(
    [
        T.StructField("who", T.StringType()),
        T.StructField("at", T.TimestampNTZType()),
        T.StructField("id", T.StringType()),
        T.StructField("gap_us", T.StringType()),
    ]
)
T0 = dt.datetime(2024, 1, 1)


def brute(rows, gap_us):
    by = {}
    for who, at, i, _ in set(rows):
        if at is not None and i is not None:
            by.setdefault(who, []).append((at, i))
    out = set()
    for who, ev in by.items():
        ev.sort()
        start, n = ev[0], 1
        for a, b in zip(ev, ev[1:] + [None]):
            if b is None or (b[0] - a[0]) // dt.timedelta(microseconds=1) > gap_us:
                out.add((who, start[1], a[1], n))
                start, n = b, 0
            n += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_every_threshold_from_one_tree(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(600):
        who = rng.choice(["hot"] * 8 + ["a", "b", None])
        at = T0 + dt.timedelta(seconds=rng.choice([rng.randrange(50), rng.randrange(20_000), 7 * rng.randrange(900)]))
        rows.append((who, at, f"i{k:04d}", "clash"))
    rows += rows[:20]  # delivered twice
    rows += [("a", None, "x", None), ("b", T0, None, None)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    fan, S.FAN_IN = S.FAN_IN, 3
    try:
        nodes = S.gap_tree(spark.createDataFrame(rows, SCHEMA), ["who"], "at", "id").cache()
        for seconds in (0, 1, 7, 30, 60, 3600):
            got = S.cut(nodes, seconds * 10**6).select("who", "first_id", "last_id", "n_events").collect()
            assert len(got) == len(set(got))
            assert set(map(tuple, got)) == brute(rows, seconds * 10**6)
        assert nodes.filter(F.col("parent_gap_us") <= F.col("gap_us")).count() == 0
    finally:
        S.FAN_IN = fan
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert S.sessions(df, ["who"], "at", "id", 10).count() == 0
