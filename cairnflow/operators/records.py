"""Rows of the smaller tables: episodes, conversations, usage, observations about the store, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairnflow.functions import exprs as X
from cairnflow.operators import events as E


def with_state(windows: DataFrame, keys: list[str], moment_us: int, minutes: float) -> DataFrame:
    """Episodes (keys, ``episode, start_us, end_us, n_events, first_id``) as they stand at a moment.

    Adds ``id``, ``state`` (open while the moment is within the window of the start, else closed) and ``sparse``, closed
    episodes of a single event, which get no synthesis."""
    closed = F.col("start_us") + int(minutes * 60_000_000) < moment_us
    return windows.filter(F.col("start_us") <= moment_us).withColumns(
        {
            "id": F.concat_ws("-", *keys, "episode"),
            "state": F.when(closed, "closed").otherwise("open"),
            "sparse": closed & (F.col("n_events") < 2),
        }
    )


def close_idle(episodes: DataFrame, moment_us: int, minutes: float, force: bool = False) -> DataFrame:
    """Open episodes whose window has passed (or all, with ``force``) closed."""
    due = F.lit(force) | (F.col("start_us") + int(minutes * 60_000_000) < moment_us)
    return episodes.withColumn("state", F.when((F.col("state") == "open") & due, "closed").otherwise(F.col("state")))


def episode_of(events: DataFrame, episodes: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Events with the ``episode`` that they belong to: the latest one of their key not after them, null before the first.

    An as-of join, so a long key is not paired with all of its episodes."""
    start = F.expr("timestampadd(MICROSECOND, start_us, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    right = episodes.select(*keys, start.alias(ts), F.col("episode"))
    return E.as_of_join(events, right, keys, ts, "episode")


def preceding(events: DataFrame, keys: list[str], ts: str, event_id: str, k: int = 5) -> DataFrame:
    """Adds ``before``: ids of up to ``k`` events of the same keys right before each, the oldest first; events without a key get none."""
    w = Window.partitionBy(*keys).orderBy(ts, event_id).rowsBetween(-k, -1)
    known = F.lit(True)
    for c in keys:
        known = known & F.col(c).isNotNull()
    return events.withColumn("before", F.when(known, F.collect_list(event_id).over(w)).otherwise(F.array()))


def conversations(turns: DataFrame, k: int | None = 50) -> DataFrame:
    """``conv_id, n_messages, title, preview, last_at`` of the ``k`` newest conversations.

    ``turns``: ``conv_id, turn, role, text, at``.  Messages of users and assistants count; the title is the first user
    message (60 characters), the preview the last message (100)."""
    said = turns.filter(F.col("role").isin("user", "assistant"))
    user = F.col("role") == "user"
    out = said.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_messages"), F.left(F.min_by("text", F.when(user, F.col("turn"))), F.lit(60)).alias("title"),
        F.left(F.max_by("text", "turn"), F.lit(100)).alias("preview"), F.max("at").alias("last_at"),
    )
    out = out.withColumn("title", F.coalesce("title", F.lit("")))
    return out if k is None else out.orderBy(F.desc("last_at"), "conv_id").limit(k)


def session_history(turns: DataFrame) -> DataFrame:
    """Totals of each agent session: ``conv_id, n, seconds, first_at, last_at``."""
    out = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    return out.withColumn("seconds", F.expr("timestampdiff(SECOND, first_at, last_at)"))


def usage_rows(calls: DataFrame) -> DataFrame:
    """Usage records of calls (``ts, caller, operation, request, response, latency_ms, error``): tokens are counted as a
    quarter of the characters, rounded up; a failed call has no response tokens."""
    count = lambda c: F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4).cast("long")
    ok = F.col("error").isNull()
    return calls.select(
        "ts", "caller", "operation", "latency_ms", ok.alias("success"), count(F.col("request")).alias("prompt_tokens"),
        F.when(ok, count(F.col("response"))).otherwise(F.lit(0)).cast("long").alias("completion_tokens"), X.truncate(F.col("error"), 200).alias("error"),
    )


def training_capture(calls: DataFrame) -> DataFrame:
    """``line``: one JSON object for each call that succeeded, with whether its response parses as JSON."""
    parsed = F.coalesce(F.try_parse_json("response").isNotNull() & F.trim("response").startswith("{"), F.lit(False))
    done = calls.filter(F.col("error").isNull() & (F.coalesce(F.trim("response"), F.lit("")) != ""))
    return done.select(F.to_json(F.struct(F.col("operation").alias("task_type"), "request", "response", parsed.alias("parse_success"))).alias("line"))


def cycle_age(log: DataFrame, as_of: str) -> DataFrame:
    """``hours, severity, dispatch``: the hours since the last cycle, what that is worth (above 72 warning, above 48 info) and
    whether it calls for one."""
    last = log.agg(F.max("created_at").alias("last"))
    hours = F.expr(f"timestampdiff(SECOND, last, TIMESTAMP_NTZ'{as_of}')") / 3600.0
    severity = F.when(hours > 72, "warning").when(hours > 48, "info").otherwise("ok")
    return last.select(F.round(hours, 4).alias("hours"), severity.alias("severity"), (severity == "warning").alias("dispatch"))


def fired(events: DataFrame, rules: list[dict], ts: str, event_id: str) -> DataFrame:
    """``rule, priority, event_id``: the firings of rules over an event stream.

    A rule: ``name, event_type, priority, condition`` (an expression over the event) and ``cooldown`` seconds since its last
    firing.  At one event the rules act in the order of priority, the greatest first.  The rules are a stated list."""
    out = None
    for r in rules:
        met = events.filter((F.col("event_type") == r["event_type"]) & F.expr(r["condition"])).withColumn("rule", F.lit(r["name"]))
        hits = E.rule_firings(met, ["rule"], ts, event_id, r["cooldown"]) if r["cooldown"] else met
        hits = hits.select("rule", F.lit(r["priority"]).alias("priority"), F.col(event_id).alias("event_id"))
        out = hits if out is None else out.unionByName(hits)
    return out


def store_size_exceeds(memories: DataFrame, most_mb: int) -> DataFrame:
    """``estimated_mb, exceeds``: ten kilobytes a memory, whole megabytes."""
    n = memories.agg(F.count(F.lit(1)).alias("n"))
    mb = F.expr("n * 10 div 1024")
    return n.select(mb.alias("estimated_mb"), (mb > most_mb).alias("exceeds"))


def subscribed(events: DataFrame, subscriptions: dict[str, list[str]]) -> DataFrame:
    """One row for each event and consumer that subscribes to its ``event_type``: nothing is dropped when a consumer lags."""
    pairs = [(consumer, kind) for consumer, kinds in subscriptions.items() for kind in kinds]
    table = events.sparkSession.createDataFrame(pairs, "consumer string, event_type string")
    return events.join(F.broadcast(table), "event_type")  # the stated subscriptions


def changes(snapshots: DataFrame, keys: list[str], ts: str, snapshot_id: str, content: Column) -> DataFrame:
    """Polled snapshots (a clipboard, a file head) that differ from the one before, by the MD5 of their content."""
    w = Window.partitionBy(*keys).orderBy(ts, snapshot_id)
    digest = F.md5(F.coalesce(content, F.lit("")))
    return snapshots.withColumn("digest", digest).withColumn("_b", F.lag("digest").over(w)).filter(~F.col("_b").eqNullSafe(F.col("digest"))).drop("_b")


def resolve_project(path: Column, aliases: dict[str, str], prefixes: dict[str, str], parents: list[str]) -> Column:
    """Project of a path or name: an alias, the longest registered prefix at a folder's end, the folder below a known
    parent (by its alias if it has one), else empty."""
    name = F.coalesce(path, F.lit(""))

    def alias(c: Column) -> Column:
        out = F.lit(None).cast("string")
        for a, p in aliases.items():
            out = F.when(F.lower(c) == a.lower(), p).otherwise(out)
        return out

    by_prefix = F.lit(None).cast("string")
    for p in sorted(prefixes, key=len):  # the longest is tested last and so wins
        by_prefix = F.when((name == p) | name.startswith(p.rstrip("/") + "/"), prefixes[p]).otherwise(by_prefix)
    parts = F.split(name, "/")
    at = F.array_position(F.transform(parts, lambda x: x.isin(parents)), F.lit(True)).cast("int")
    child = F.when(at > 0, F.get(parts, at))
    below = F.when(F.coalesce(child, F.lit("")) != "", F.coalesce(alias(child), child))
    return F.coalesce(alias(name), by_prefix, below, F.lit(""))


def fallback_encoding(raw: DataFrame, most: int = 8_000) -> DataFrame:
    """What an observation is encoded to without a model: ``id, gist, summary, content, concepts, salience``.

    The summary names the file where the metadata holds a path, else it is the content; mark-up is stripped, or replaced by
    a general description where little is left."""
    path = F.get_json_object("metadata", "$.path")
    named = F.concat(F.lit("File "), F.when(F.coalesce("type", F.lit("")) == "", "changed").otherwise(F.col("type")), F.lit(": "), path)
    text = F.when(F.coalesce(path, F.lit("")) != "", named).otherwise(F.coalesce("content", F.lit("")))
    plain = X.strip_tags(text)
    general = F.concat(F.lit("File activity ("), F.coalesce("source", F.lit("")), F.lit(", "), F.coalesce("type", F.lit("")), F.lit(")"))
    markup = F.trim(text).startswith("<") | (X.markup_share(text) > 0.15)
    summary = F.left(F.when(markup, F.when(F.length(plain) > 20, plain).otherwise(general)).otherwise(text), F.lit(80))
    return raw.select(
        "id", X.truncate(summary, 60).alias("gist"), summary.alias("summary"), X.truncate(F.col("content"), most).alias("content"),
        X.default_concepts(F.col("content"), F.col("type"), F.col("source")).alias("concepts"), X.first_salience(F.col("source"), F.col("content")).alias("salience"),
    )


def parsed_synthesis(responses: DataFrame, response: str) -> DataFrame:
    """Adds title, summary (500 characters), narrative (2,000 bytes), tone and concepts of an episode from a model's text, with
    defaults where the JSON lacks them or there is none."""
    shape = "title string, summary string, narrative string, emotional_tone string, concepts array<string>"
    x = F.from_json(X.json_in_prose(F.col(response)), shape)
    blank = lambda c, other: F.when(F.coalesce(F.trim(c), F.lit("")) == "", other).otherwise(c)
    return responses.withColumn("_x", x).withColumns(
        {
            "title": blank(F.col("_x.title"), F.lit("Untitled session")),
            "summary": F.left(blank(F.col("_x.summary"), F.coalesce(F.col(response), F.lit(""))), F.lit(500)),
            "narrative": F.decode(F.substring(F.encode(F.coalesce("_x.narrative", F.lit("")), "UTF-8"), 1, 2000), "UTF-8"),
            "emotional_tone": blank(F.col("_x.emotional_tone"), F.lit("neutral")),
            "concepts": F.coalesce("_x.concepts", F.array().cast("array<string>")),
        }
    ).drop("_x")


def density_salience(text: Column, vocabulary: list[str]) -> Column:
    """0.3 and up to 0.6 more by the share of words that are in a vocabulary, at most 0.9."""
    words = X.tokens(text)
    hits = F.size(F.filter(words, lambda w: w.isin(vocabulary)))
    return F.least(F.lit(0.9), 0.3 + 0.6 * hits / F.greatest(F.size(words), F.lit(1)))


def vocabulary_concepts(text: Column, vocabulary: list[str], k: int = 5) -> Column:
    """The words of a vocabulary that a text uses most often, ties by name."""
    found = F.filter(X.tokens(text), lambda w: w.isin(vocabulary))
    counted = F.transform(F.array_distinct(found), lambda w: F.struct((-F.size(F.filter(found, lambda x: x == w))).alias("n"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(counted), 1, k), lambda x: x["w"])


def merged_maps(first: Column, second: Column) -> Column:
    """Both maps' entries; the second's value wins."""
    kept = F.map_filter(first, lambda k, v: ~F.array_contains(F.map_keys(second), k))
    return F.coalesce(F.map_concat(kept, second), first, second)
