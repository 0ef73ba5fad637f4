"""Structured Streaming forms: the same event semantics with watermarks and keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairnflow.operators import events as E
from cairnflow.sources.ingest import history_line


def file_stream(spark: SparkSession, path: str, schema, per_trigger: int = 16) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def terminal_tail(spark: SparkSession, path: str, per_trigger: int = 16) -> DataFrame:
    """Shell history files of a folder as they arrive, a command a row, without time prefixes and blank lines."""
    lines = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path)
    return lines.select(history_line(F.col("value")).alias("command")).filter(F.trim("command") != "")


def changed_snapshots(stream: DataFrame, keys: list[str], content: str, ttl: str, ts: str, delay: str = "10 minutes") -> DataFrame:
    """Polled snapshots (a clipboard, a repository's head) by the MD5 of their content: each content once within the time to live."""
    digest = F.md5(F.coalesce(F.col(content), F.lit("")))
    return first_in_ttl(stream.withColumn("digest", digest), [*keys, "digest"], ts, ttl, delay)


def subscribed(stream: DataFrame, kinds: list[str]) -> DataFrame:
    """The events of a bus that a consumer subscribes to; every consumer is a query of its own with its own checkpoint, so a slow one
    loses nothing and holds nobody up."""
    return stream.filter(F.col("event_type").isin(kinds))


def fan_in(*streams: DataFrame) -> DataFrame:
    """Several watchers as one stream."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def first_in_ttl(stream: DataFrame, keys: list[str], ts: str, ttl: str, delay: str = "10 minutes") -> DataFrame:
    """The first event of equal keys within the time to live; state is dropped behind the watermark."""
    return stream.withWatermark(ts, delay if delay >= ttl else ttl).dropDuplicatesWithinWatermark(keys)


def scored(stream: DataFrame) -> DataFrame:
    """Events that pass the heuristic filter; stateless."""
    return E.heuristic_filter(stream).filter("passed")


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts per tumbling or sliding window and key, final once the watermark has passed."""
    w = F.window(F.col(ts), size, slide) if slide else F.window(F.col(ts), size)
    return stream.withWatermark(ts, delay).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n"
    )


def session_counts(stream: DataFrame, ts: str, keys: list[str], gap: str, delay: str = "10 minutes") -> DataFrame:
    """Gap sessions per key."""
    w = F.session_window(F.col(ts), gap)
    return stream.withWatermark(ts, delay).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n"
    )


def without_sentinels(stream: DataFrame, sentinels: DataFrame, key: str, ts: str, cooldown: str, delay: str = "10 minutes") -> DataFrame:
    """Events with no sentinel of their key in the cooldown before them: a stream-stream outer
    interval join whose unmatched rows come out when the watermark allows."""
    a = stream.withWatermark(ts, delay)
    b = sentinels.select(F.col(key).alias("_k"), F.col(ts).alias("_t")).withWatermark("_t", delay)
    test = F.expr(f"{key} = _k AND _t <= {ts} AND _t >= {ts} - INTERVAL {cooldown}")
    return a.join(b, test, "left_outer").filter(F.col("_k").isNull()).drop("_k", "_t")


def anchored_episodes(stream: DataFrame, key: str, ts: str, minutes: float, delay: str = "10 minutes") -> DataFrame:
    """Windows anchored at their first event, per key: ``key, start, end, n_events``.

    State per key is the open window and the events not yet behind the watermark; an event-time
    timer closes the window, so a late event within the delay still finds its place."""
    size = pd.Timedelta(minutes=minutes)
    key_type = dict(stream.dtypes)[key]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        for f in frames:
            times += [int(t.value) for t in f["_t"]]
        times.sort()
        mark = state.getCurrentWatermarkMs() * 1_000_000
        out = []
        while times:
            end = times[0] + size.value
            if end >= mark:
                break
            inside = [t for t in times if t <= end]
            out.append((k[0], pd.Timestamp(inside[0]), pd.Timestamp(inside[-1]), len(inside)))
            times = times[len(inside) :]
        if times:
            state.update((times,))
            state.setTimeoutTimestamp(max((times[0] + size.value) // 1_000_000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, "start", "end", "n_events"])

    slim = stream.select(key, F.col(ts).cast("timestamp").alias("_t")).withWatermark("_t", delay)
    return slim.groupBy(key).applyInPandasWithState(
        run,
        f"{key} {key_type}, start timestamp, end timestamp, n_events long",
        "times array<bigint>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def rate_limited(stream: DataFrame, key: str, ts: str, event_id: str, limit: int, minutes: float, delay: str = "10 minutes") -> DataFrame:
    """Events accepted by a limiter per key; rejected ones are not recorded.  ``key, event_id, ts``."""
    span = pd.Timedelta(minutes=minutes).value
    types = dict(stream.dtypes)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["_t", event_id])
        kept = []
        for i, t in zip(rows[event_id], rows["_t"]):
            recent = [x for x in recent if x > t.value - span]
            if len(recent) < limit:
                recent.append(int(t.value))
                kept.append((k[0], i, t))
        state.update((recent[-limit:],))
        yield pd.DataFrame(kept, columns=[key, event_id, ts])

    slim = stream.select(key, event_id, F.col(ts).cast("timestamp").alias("_t")).withWatermark("_t", delay)
    return slim.groupBy(key).applyInPandasWithState(
        run, f"{key} {types[key]}, {event_id} {types[event_id]}, {ts} timestamp", "recent array<bigint>", "append", GroupStateTimeout.NoTimeout
    )


def drain(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything that is there, batch by batch, exactly once per checkpoint, then stop."""
    q = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(handle).start()
    )
    q.awaitTermination()
