import datetime as dt

from pyspark.sql import functions as F

from cairnflow.operators import events
from cairnflow.streaming import queries as S

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "u string, ts timestamp, id int"


def run(spark, tmp_path, rows, build, batches=3):
    src = tmp_path / "in"
    for b in range(batches):
        part = rows[b * len(rows) // batches : (b + 1) * len(rows) // batches]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    # a last event far in the future moves the watermark over everything
    spark.createDataFrame([("end", T0 + dt.timedelta(days=9), -1)], SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    out = str(tmp_path / "out")
    stream = build(S.file_stream(spark, str(src), SCHEMA, 1))
    S.drain(stream, str(tmp_path / "ck"), lambda df, _: df.write.mode("append").parquet(out))
    return spark.read.parquet(out)


def rows():
    minutes = [0, 3, 9, 10, 11, 12, 40, 41, 55, 90, 90, 91]
    return [(("a", "b")[k % 2], T0 + dt.timedelta(minutes=m), k) for k, m in enumerate(minutes)]


def test_anchored_episodes_match_the_batch_form(spark, tmp_path):
    got = run(spark, tmp_path, rows(), lambda s: S.anchored_episodes(s, "u", "ts", 10, "2 hours"))
    batch = events.anchored_windows(spark.createDataFrame(rows(), SCHEMA), ["u"], "ts", "id", 10)
    want = {(r.u, r.n_events, r.start_us // 10**6) for r in batch.collect()}
    assert {(r.u, r.n_events, int(r.t)) for r in got.filter("u <> 'end'").withColumn("t", F.unix_seconds("start")).collect()} == want


def test_windows_and_first_in_ttl(spark, tmp_path):
    got = run(spark, tmp_path, rows(), lambda s: S.windowed_counts(s, "ts", ["u"], "30 minutes", delay="2 hours"))
    assert got.filter("u <> 'end'").agg(F.sum("n")).first()[0] == 12
    (tmp_path / "x").mkdir()
    first = run(spark, tmp_path / "x", rows() + rows(), lambda s: S.first_in_ttl(s, ["u", "id"], "ts", "2 hours", "2 hours"))
    assert sorted(r.id for r in first.filter("u <> 'end'").collect()) == list(range(12))


def test_rate_limit(spark, tmp_path):
    got = run(spark, tmp_path, rows(), lambda s: S.rate_limited(s, "u", "ts", "id", 2, 15, "2 hours"))
    want = events.accepted_events(spark.createDataFrame(rows(), SCHEMA), ["u"], "ts", "id", 2, 15)
    assert {r.id for r in got.filter("u <> 'end'").collect()} == {r.id for r in want.collect()}


def test_tails_and_changes(spark, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "history").write_text(": 1700000000:0;git status\n\nls -la\n")
    out = str(tmp_path / "commands")
    S.drain(S.terminal_tail(spark, str(tmp_path / "h")), str(tmp_path / "ck_tail"), lambda df, _: df.write.mode("append").parquet(out))
    assert sorted(r.command for r in spark.read.parquet(out).collect()) == ["git status", "ls -la"]
    polled = [("clip", T0 + dt.timedelta(minutes=m), i) for m, i in ((0, 1), (1, 1), (2, 2), (3, None), (4, 2))]
    got = run(spark, tmp_path, polled, lambda s: S.changed_snapshots(s.withColumn("c", F.col("id").cast("string")), ["u"], "c", "2 hours", "ts", "2 hours"))
    assert sorted(str(r.id) for r in got.filter("u <> 'end'").collect()) == ["1", "2", "None"]
    (tmp_path / "y").mkdir()
    kinds = run(spark, tmp_path / "y", rows(), lambda s: S.subscribed(s.withColumn("event_type", F.when(F.col("id") % 3 == 0, "view").otherwise("click")), ["view"]))
    assert sorted(r.id for r in kinds.filter("u <> 'end'").collect()) == [0, 3, 6, 9]
