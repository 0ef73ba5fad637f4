"""Event operators in batch form: filters, limits, duplicates, windows, as-of joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cairnflow.functions import exprs as X, word_lists as W
from cairnflow.functions.streams import micros
from cairnflow.operators import chunks


def source_score(source: Column, kind: Column, path: Column, content: Column) -> tuple[Column, Column]:
    """(score, rejected) of an event by its source's rules."""
    p, low = F.coalesce(path, F.lit("")), F.lower(F.coalesce(path, F.lit("")))
    base = F.element_at(F.split(p, "/"), -1)
    rejected_path = (
        X.any_of(base, W.LOCK_FILES, whole=True) | X.any_of(p, W.IGNORED_PATHS) | X.any_of(F.lower(base), W.EVENT_SENSITIVE_NAMES)
    )
    ends = lambda exts: reduce(lambda a, b: a | b, [low.endswith(e) for e in exts])
    add = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    fs = (
        0.3
        + F.when(low.contains("error") | low.contains(".log"), 0.2).when(ends(W.CONFIG_EXTENSIONS), 0.15).otherwise(0.0)
        + add(ends(W.SOURCE_EXTENSIONS), 0.1)
    )
    words = X.fields(content)
    first = F.lower(F.coalesce(F.get(words, F.lit(0)), F.lit("")))
    trivial = (F.size(words) == 1) & first.isin(W.TRIVIAL_COMMANDS)
    signal = reduce(lambda a, b: a | b, [first.startswith(c) for c in W.SIGNAL_COMMANDS])
    terminal = 0.3 + add(signal, 0.25)
    trimmed = F.regexp_replace(content, r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    url = (trimmed.startswith("http://") | trimmed.startswith("https://")) & ~trimmed.rlike(r"[ \t\n]")
    clipboard = 0.3 + add(X.any_of(content, W.CODE_INDICATORS), 0.2)
    mcp = 0.6 + X.weight_of(kind, {"decision": 0.25, "error": 0.2, "insight": 0.3, "learning": 0.2}, 0.0)
    score = F.when(source == "filesystem", fs).when(source == "terminal", terminal).when(source == "clipboard", clipboard).when(source == "mcp", mcp).otherwise(0.3)
    rejected = F.when(source == "filesystem", rejected_path).when(source == "terminal", trivial).when(source == "clipboard", url).otherwise(F.lit(False))
    return score, F.coalesce(rejected, F.lit(False))


def heuristic_filter(events: DataFrame, min_length: int = 10, max_length: int = 100_000, least: float = 0.2) -> DataFrame:
    """Adds ``score`` and ``passed`` to events (``source, type, path, content``): length bounds,
    blank, the source's rules with hard rejection, keywords, clamp, threshold.  An optional
    column ``boost`` is added to the score before the clamp."""
    score, rejected = source_score(F.col("source"), F.col("type"), F.col("path"), F.col("content"))
    n = F.octet_length("content")
    boost = F.coalesce("boost", F.lit(0.0)) if "boost" in events.columns else F.lit(0.0)
    total = X.clamp(score + boost + X.keyword_score(F.col("content")), 0.0, 1.0)
    bad = F.col("content").isNull() | (n < min_length) | (n > max_length) | ~F.col("content").rlike(r"\S") | rejected
    out = F.when(bad, 0.0).otherwise(total)
    return events.withColumn("score", F.round(out, 6)).withColumn("passed", ~bad & (out >= least))


def ttl_duplicates(events: DataFrame, keys: Sequence[str], ts: str, event_id: str, seconds: float) -> DataFrame:
    """Adds ``duplicate``: whether the event before with the same keys is at most ``seconds`` older."""
    e = chunks.chunked(events.withColumn("_us", micros(events, ts)), keys, ["_us", event_id])
    before = chunks.lagged(e, keys, ["_us", event_id], "_us", "_before")
    gap = F.col("_us") - F.col("_before.x")
    return before.withColumn("duplicate", F.coalesce(gap <= int(seconds * 1e6), F.lit(False))).drop("_us", "_before", "_p")


def _fold_stretches(events: DataFrame, keys: Sequence[str], ts: str, event_id: str, size: int, schema: str, fold: Callable) -> DataFrame:
    """``fold`` over the events of each key, cut where a key is silent for more than ``size``.

    The stretches are hashed to tasks and sorted there; ``fold`` takes the rows (keys, ``us``, ``id``) of a stretch one by one
    (``fold(None, row)`` opens one, ``fold(state, None)`` ends it) and returns (state, rows of the result), so a stretch of
    any length streams through a task and is never held."""
    e = events.filter(F.col(ts).isNotNull()).select(*keys, micros(events, ts).alias("_us"), F.col(event_id).alias("_id"))
    order = ["_us", "_id"]
    parts = chunks.chunked(e, keys, order)
    cut = chunks.lagged(parts, keys, order, "_us", "_before")
    starts = cut.withColumn("_s", F.when(F.coalesce(F.col("_us") - F.col("_before.x") > size, F.lit(True)), F.col("_us")))
    placed = chunks.carried(starts, keys, order, "_s", "_stretch").select(*keys, "_stretch", *order)
    by = [*keys, "_stretch"]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at, kinds = None, None, None

        def batch(out):
            return pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*out) if out else [[]] * len(names), kinds)], names=names)

        for b in batches:
            own = {"long": pa.int64(), "string": pa.string()}
            kinds = [*(b.schema.field(k).type for k in keys), *(own[f.split()[1]] if f.split()[0] != event_id else b.schema.field("_id").type for f in schema.split(", ")[len(keys) :])]
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if at is None or row[: len(by)] != at:
                    if at is not None:
                        out += [(*at[:-1], *r) for r in fold(state, None)[1]]
                    state, at = None, row[: len(by)]
                state, rows = fold(state, row[len(by) :])
                out += [(*at[:-1], *r) for r in rows]
            yield batch(out)
        if at is not None:
            yield batch([(*at[:-1], *r) for r in fold(state, None)[1]])

    return placed.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def accepted_events(events: DataFrame, keys: Sequence[str], ts: str, event_id: str, limit: int, minutes: float) -> DataFrame:
    """Events that pass a limiter: at most ``limit`` accepted ones per key within the last ``minutes``.

    Rejected events are not recorded, so acceptance is a recursion over each key's own events, a
    fold in the order of time.  A silence of the window's length resets the limiter, so a key is
    cut there; the fold keeps the last ``limit`` accepted times only."""
    window, kinds = int(minutes * 60_000_000), dict(events.dtypes)

    def fold(recent, row):
        if row is None:
            return None, []
        us, own = row
        recent = [t for t in recent or [] if t > us - window]
        if len(recent) < limit:
            return [*recent, us], [(own,)]
        return recent, []

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{event_id} {kinds[event_id]}"])
    return _fold_stretches(events, keys, ts, event_id, window, schema, fold)


def recent_count(events: DataFrame, keys: Sequence[str], ts: str, seconds: int) -> DataFrame:
    """Adds ``recent``: events of the key in the last ``seconds``, this one included (all, also rejected ones).

    Time is cut into buckets of that length and a row also goes to the bucket after its own, so a
    window sees one key and bucket, never a whole key."""
    size = seconds * 1_000_000
    e = events.withColumn("_us", micros(events, ts)).withColumn("_own", F.expr(f"_us div {size}"))
    e = e.withColumn("_b", F.explode(F.array("_own", F.col("_own") + 1)))
    w = Window.partitionBy(*keys, "_b").orderBy("_us").rangeBetween(-(size - 1), 0)
    return e.withColumn("recent", F.count(F.lit(1)).over(w)).filter(F.col("_b").eqNullSafe(F.col("_own"))).drop("_us", "_own", "_b")


def suppressed_by(events: DataFrame, sentinels: DataFrame, keys: Sequence[str], ts: str, seconds: int) -> DataFrame:
    """Events that no sentinel of the same key precedes within ``seconds``: an interval anti join.

    The interval is cut into buckets of its own length, so the join is an equality on key and
    bucket; the range condition only sees neighbours in time."""
    size = seconds * 1_000_000
    e = events.withColumn("_us", micros(events, ts)).withColumn("_b", F.expr(f"_us div {size}"))
    s = sentinels.select(*keys, micros(sentinels, ts).alias("_s"))
    s = s.withColumn("_b", F.explode(F.array(F.expr(f"_s div {size}"), F.expr(f"_s div {size} + 1"))))
    left, right = e.alias("e"), s.alias("s")
    test = (F.col("e._b") == F.col("s._b")) & (F.col("s._s") <= F.col("e._us")) & (F.col("e._us") - F.col("s._s") <= size)
    for k in keys:
        test &= F.col(f"e.{k}") == F.col(f"s.{k}")
    return left.join(right, test, "left_anti").drop("_us", "_b")


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """Adds ``value``: the latest of ``right`` (keys, ts, value) not after each row of ``left``.

    Both sides are stacked and the last value is carried forward in range chunks: one shuffle, no
    pairs, no task with a whole key.  A row of ``right`` at the same moment counts."""
    lc = left.columns
    a = left.withColumns({"_v": F.lit(None).cast(dict(right.dtypes)[value]), "_side": F.lit(1)})
    b = right.select(*keys, ts, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    for c in lc:
        if c not in b.columns:
            b = b.withColumn(c, F.lit(None).cast(left.schema[c].dataType))
    both = chunks.chunked(a.unionByName(b.select(a.columns)), keys, [ts, "_side"])
    return chunks.carried(both, keys, [ts, "_side"], "_v", value).filter("_side = 1").select(*lc, value)


def anchored_windows(events: DataFrame, keys: Sequence[str], ts: str, event_id: str, minutes: float) -> DataFrame:
    """keys, ``episode, start_us, end_us, n_events, first_id``: windows anchored at their first event.

    The first event opens a window, later ones join while they are at most ``minutes`` after its
    start, the next one opens another.  Neither session (gap) nor tumbling (aligned).  A silence
    longer than the window always opens a new one, so a key is cut there and folded stretch by
    stretch."""
    size, kinds = int(minutes * 60_000_000), dict(events.dtypes)

    def fold(open_, row):
        if row is None:
            return None, [open_]
        us, own = row
        if open_ is not None and us - open_[0] <= size:
            return (open_[0], us, open_[2] + 1, open_[3]), []
        return (us, us, 1, own), [open_] if open_ is not None else []

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "start_us long", "end_us long", "n_events long", "first_id string"])
    each = _fold_stretches(events.withColumn(event_id, F.col(event_id).cast("string")), keys, ts, event_id, size, schema, fold)
    parts = chunks.numbered(chunks.chunked(each, keys, ["start_us"]), keys, ["start_us"], "_n")
    return parts.select(*keys, (F.col("_n") - 1).cast("int").alias("episode"), "start_us", "end_us", "n_events", "first_id")


def rule_firings(events: DataFrame, keys: Sequence[str], ts: str, event_id: str, cooldown_seconds: float) -> DataFrame:
    """Events at which a rule with a cooldown fires: at most one accepted event per cooldown."""
    return accepted_events(events, keys, ts, event_id, 1, cooldown_seconds / 60)


def promoted_prefixes(rejected: DataFrame, ts: str, least: int = 50, hours: int = 1) -> DataFrame:
    """Path prefixes with at least ``least`` rejections within an aligned window."""
    prefix = F.array_join(F.slice(F.split("path", "/"), 1, 2), "/")
    w = F.window(F.col(ts), f"{hours} hours")
    return (
        rejected.filter(F.col("path").isNotNull()).groupBy(prefix.alias("prefix"), w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= least).groupBy("prefix").agg(F.max("n").alias("most"))
    )
