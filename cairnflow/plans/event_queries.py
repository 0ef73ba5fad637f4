"""Event operators over the observations and the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnflow.functions import exprs as X, word_lists as W
from cairnflow.functions.streams import from_micros
from cairnflow.operators import events as E, store
from cairnflow.plans.registry import Registry

_R = Registry()
query, QUERIES, SQL = _R.query, _R.QUERIES, _R.SQL

_OBS = """obs AS (SELECT id, timestamp, lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) AS source, type, content, project,
  CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.path') END AS path
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST) AS n FROM raw_memories) WHERE n = 1)"""


def _obs(t):
    from cairnflow.functions.streams import folded

    r = store.latest_delivery(t("raw_memories"))
    return r.select("id", "timestamp", folded("source").alias("source"), "type", "content", "project", F.get_json_object("metadata", "$.path").alias("path"))


def _any(col: str, parts, op: str = "contains({c}, '{p}')") -> str:
    return "(" + " OR ".join(op.format(c=col, p=p.replace("'", "''")) for p in parts) + ")"


_BASE = "list_extract(string_split(coalesce(path, ''), '/'), -1)"
_LOW = "lower(coalesce(path, ''))"
_W = "list_filter(string_split_regex(coalesce(content, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')"
_FIRST = f"lower(coalesce(({_W})[1], ''))"
_TRIM = "regexp_replace(content, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')"
_END = "ends_with({c}, '{p}')"
_KW = " + ".join(f"CASE WHEN contains(lower(content), '{w}') THEN {x} ELSE 0.0 END" for x, ws in W.KEYWORD_WEIGHTS for w in ws)
_SCORE = f"""CASE source
  WHEN 'filesystem' THEN 0.3 + CASE WHEN contains({_LOW}, 'error') OR contains({_LOW}, '.log') THEN 0.2 WHEN {_any(_LOW, W.CONFIG_EXTENSIONS, _END)} THEN 0.15 ELSE 0.0 END + CASE WHEN {_any(_LOW, W.SOURCE_EXTENSIONS, _END)} THEN 0.1 ELSE 0.0 END
  WHEN 'terminal' THEN 0.3 + CASE WHEN {_any(_FIRST, W.SIGNAL_COMMANDS, "starts_with({c}, '{p}')")} THEN 0.25 ELSE 0.0 END
  WHEN 'clipboard' THEN 0.3 + CASE WHEN {_any('content', W.CODE_INDICATORS)} THEN 0.2 ELSE 0.0 END
  WHEN 'mcp' THEN 0.6 + CASE type WHEN 'decision' THEN 0.25 WHEN 'error' THEN 0.2 WHEN 'insight' THEN 0.3 WHEN 'learning' THEN 0.2 ELSE 0.0 END ELSE 0.3 END"""
_REJECT = f"""coalesce(CASE source WHEN 'filesystem' THEN {_any(_BASE, W.LOCK_FILES, "{c} = '{p}'")} OR {_any("coalesce(path, '')", W.IGNORED_PATHS)} OR {_any(f"lower({_BASE})", W.EVENT_SENSITIVE_NAMES)}
  WHEN 'terminal' THEN len({_W}) = 1 AND {_FIRST} IN ({", ".join(f"'{c}'" for c in W.TRIVIAL_COMMANDS)})
  WHEN 'clipboard' THEN (starts_with({_TRIM}, 'http://') OR starts_with({_TRIM}, 'https://')) AND NOT regexp_matches({_TRIM}, '[ \\t\\n]') ELSE false END, false)"""


@query(f"WITH {_OBS} SELECT id, round({_KW}, 6) AS score FROM obs")
def heuristic_keyword_score(t):
    return _obs(t).select("id", F.round(X.keyword_score(F.col("content")), 6).alias("score"))


@query(f"WITH {_OBS} SELECT id, round(({_SCORE})::DOUBLE, 6) AS score, {_REJECT} AS rejected FROM obs")
def heuristic_source_score(t):
    s, r = E.source_score(F.col("source"), F.col("type"), F.col("path"), F.col("content"))
    return _obs(t).select("id", F.round(s, 6).alias("score"), r.alias("rejected"))


@query(
    f"""WITH {_OBS}, s AS (SELECT id, content IS NULL OR strlen(content) < 10 OR strlen(content) > 100000 OR NOT regexp_matches(content, '\\S') OR {_REJECT} AS bad,
      greatest(0.0, least(1.0, ({_SCORE}) + {_KW}))::DOUBLE AS x FROM obs)
    SELECT id, round(CASE WHEN bad THEN 0.0 ELSE x END, 6) AS score, NOT bad AND round(x, 9) >= 0.2 AS passed FROM s"""
)
def heuristic_pass(t):
    return E.heuristic_filter(_obs(t)).select("id", "score", "passed")


@query(f"WITH {_OBS} SELECT id, coalesce(epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY source, type, content ORDER BY timestamp, id)) <= 3600000000, false) AS duplicate FROM obs")
def ttl_dedup(t):
    return E.ttl_duplicates(_obs(t), ["source", "type", "content"], "timestamp", "id", 3600).select("id", "duplicate")


@query(f"WITH {_OBS} SELECT id, count(*) OVER (PARTITION BY project ORDER BY epoch_us(timestamp) RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) AS recent FROM obs WHERE source = 'filesystem'")
def batch_edit_window(t):
    """Edits of a project in the last five minutes, each edit included."""
    e = _obs(t).filter("source = 'filesystem'")
    return E.recent_count(e, ["project"], "timestamp", 300).select("id", "recent")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS recent FROM events")
def freq_window_count(t):
    return E.recent_count(t("events"), ["user_id", "event_type"], "ts", 86400).select("event_id", "recent")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    r AS (SELECT user_id, event_id, k, true AS ok, [us] AS recent FROM e WHERE k = 1
      UNION ALL SELECT e.user_id, e.event_id, e.k, len(list_filter(r.recent, lambda x: x > e.us - 86400000000)) < 3,
        CASE WHEN len(list_filter(r.recent, lambda x: x > e.us - 86400000000)) < 3 THEN list_append(list_filter(r.recent, lambda x: x > e.us - 86400000000), e.us) ELSE list_filter(r.recent, lambda x: x > e.us - 86400000000) END
      FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
    SELECT user_id, event_id FROM r WHERE ok"""
)
def frequency_limiter(t):
    """At most three accepted events of a user within a day."""
    return E.accepted_events(t("events"), ["user_id"], "ts", "event_id", 3, 1440)


@query(
    """WITH RECURSIVE e AS (SELECT event_type, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
    r AS (SELECT event_type, event_id, k, us AS last, true AS ok FROM e WHERE k = 1 UNION ALL
      SELECT e.event_type, e.event_id, e.k, CASE WHEN r.last <= e.us - 7200000000 THEN e.us ELSE r.last END, r.last <= e.us - 7200000000 FROM r JOIN e ON e.event_type = r.event_type AND e.k = r.k + 1)
    SELECT event_type, event_id FROM r WHERE ok"""
)
def rule_cooldown(t):
    """Firings of a rule per event type with a cooldown of two hours."""
    return E.rule_firings(t("events"), ["event_type"], "ts", "event_id", 7200)


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) AS k FROM events),
    r AS (SELECT user_id, event_id, us, k, us AS start_us, event_id AS first_id FROM e WHERE k = 1
      UNION ALL SELECT e.user_id, e.event_id, e.us, e.k, CASE WHEN e.us - r.start_us <= 36000000000 THEN r.start_us ELSE e.us END, CASE WHEN e.us - r.start_us <= 36000000000 THEN r.first_id ELSE e.event_id END
      FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
    SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY start_us) - 1)::INT AS episode, start_us, max(us) AS end_us, count(*) AS n_events, first_id::VARCHAR AS first_id FROM r GROUP BY user_id, start_us, first_id"""
)
def anchored_episodes(t):
    """Windows of ten hours anchored at a user's first event."""
    return E.anchored_windows(t("events"), ["user_id"], "ts", "event_id", 600)


@query(
    f"""WITH {_OBS}, h AS (SELECT *, date_trunc('hour', timestamp) AS h FROM obs WHERE project <> '')
    SELECT project, h AS hour, count(*) AS n_events, count(DISTINCT path) AS n_files, list_sort(list(DISTINCT source))::VARCHAR[] IS NOT NULL AS has_sources, arg_min(left(content, 80), (timestamp, id)) AS brief FROM h GROUP BY ALL"""
)
def episode_enrich(t):
    """Hourly episodes of a project with their files and the start of their first observation."""
    h = _obs(t).filter("project <> ''").withColumn("hour", F.date_trunc("HOUR", "timestamp").cast("timestamp_ntz"))
    return h.groupBy("project", "hour").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_distinct("path").alias("n_files"), F.lit(True).alias("has_sources"),
        F.min_by(F.left("content", F.lit(80)), F.struct("timestamp", "id")).alias("brief"),
    )


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS cut FROM events),
    s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start_ts, count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_window_3h(t):
    w = F.session_window(F.col("ts"), "3 hours")
    return t("events").groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start_ts"), "n")


@query("SELECT time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01') AS start_ts, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_10m(t):
    w = F.window(F.col("ts"), "10 minutes")
    return t("events").groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start_ts"), "event_type", "n")


@query("SELECT lower(concept) AS concept, max(timestamp) AS last_seen, count(*) AS n FROM (SELECT unnest(concepts) AS concept, timestamp FROM memories) GROUP BY ALL")
def activity_last_seen(t):
    c = t("memories").select(F.explode("concepts").alias("c"), "timestamp")
    return c.groupBy(F.lower("c").alias("concept")).agg(F.max("timestamp").alias("last_seen"), F.count(F.lit(1)).alias("n"))


@query(
    """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, ts AS viewed_at FROM events WHERE event_type = 'view')
    SELECT l.event_id, l.user_id, max(r.viewed_at) AS viewed_at, round(coalesce(greatest(0, 0.2 * (1 - date_sub('second', max(r.viewed_at), l.ts) / 86400.0)), 0), 9) AS boost
    FROM l LEFT JOIN r ON r.user_id = l.user_id AND r.ts <= l.ts GROUP BY l.event_id, l.user_id, l.ts"""
)
def recall_boost_asof(t):
    """The user's latest view not after each purchase, and a boost that fades over a day."""
    e = t("events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'view'").select("user_id", "ts", F.col("ts").alias("viewed_at"))
    j = E.as_of_join(left, right, ["user_id"], "ts", "viewed_at")
    boost = 0.2 * (1 - F.expr("timestampdiff(SECOND, viewed_at, ts)") / 86400.0)
    return j.select("event_id", "user_id", "viewed_at", F.round(F.coalesce(F.greatest(F.lit(0.0), boost), F.lit(0.0)), 9).alias("boost"))


@query(
    """SELECT event_id FROM events e WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'error' AND s.user_id = e.user_id AND s.ts <= e.ts AND epoch_us(e.ts) - epoch_us(s.ts) <= 7200000000)"""
)
def sentinel_suppression(t):
    """Events with no error of the same user in the two hours before."""
    e = t("events")
    return E.suppressed_by(e.filter("event_type <> 'error'"), e.filter("event_type = 'error'").select("user_id", "ts"), ["user_id"], "ts", 7200).select("event_id")


@query(
    f"""WITH {_OBS}, w AS (SELECT array_to_string(string_split(path, '/')[1:2], '/') AS prefix, time_bucket(INTERVAL 24 HOUR, timestamp, TIMESTAMP '1970-01-01') AS b, count(*) AS n FROM obs WHERE path IS NOT NULL GROUP BY ALL)
    SELECT prefix, max(n) AS most FROM w WHERE n >= 2 GROUP BY prefix"""
)
def adaptive_exclusion(t):
    return E.promoted_prefixes(_obs(t), "timestamp", 2, 24)


@query(f"WITH {_OBS} SELECT id, type, coalesce(lag(type) OVER (PARTITION BY project ORDER BY timestamp, id) IS DISTINCT FROM type, true) AS changed FROM obs WHERE source = 'git'")
def git_state_change(t):
    """Observations of a repository that differ from the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy("project").orderBy("timestamp", "id")
    g = _obs(t).filter("source = 'git'")
    return g.select("id", "type", (~F.lag("type").over(w).eqNullSafe(F.col("type"))).alias("changed"))


@query(f"WITH {_OBS} SELECT source, count(*) AS n, max(timestamp) AS high_mark FROM obs WHERE timestamp > TIMESTAMP '2026-05-10' GROUP BY source")
def cursor_hydrate(t):
    e = _obs(t).filter("timestamp > TIMESTAMP_NTZ'2026-05-10 00:00:00'")
    return e.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("high_mark"))


@query(
    """SELECT id, round(least(1.0, CASE source WHEN 'user' THEN 0.7 WHEN 'terminal' THEN 0.5 WHEN 'filesystem' THEN 0.4 WHEN 'clipboard' THEN 0.45 WHEN 'ingest' THEN 0.6 ELSE 0.5 END
      + CASE WHEN contains(c, 'error') OR contains(c, 'fail') OR contains(c, 'panic') THEN 0.15 ELSE 0 END + CASE WHEN contains(c, 'todo') OR contains(c, 'important') OR contains(c, 'fixme') THEN 0.1 ELSE 0 END
      + CASE WHEN contains(c, 'decision') OR contains(c, 'decided') OR contains(c, 'chose') THEN 0.1 ELSE 0 END + CASE WHEN strlen(content) > 500 THEN 0.05 ELSE 0 END)::DOUBLE, 6) AS salience FROM (SELECT id, source, content, lower(content) AS c FROM memories)"""
)
def first_salience(t):
    return t("memories").select("id", F.round(X.first_salience(F.col("source"), F.col("content")), 6).alias("salience"))


_N = ", ".join(f"'{w}'" for w in W.PATH_NOISE)


@query(
    f"""WITH {_OBS} SELECT id, array_to_string(list_distinct_keep, '|') AS concepts FROM (SELECT id, list_sort(list_distinct(list_filter(list_transform(string_split_regex(regexp_replace(path, '\\.[^./]*$', ''), '[/\\\\_.\\-]'), lambda x: lower(x)),
      lambda x: length(x) > 2 AND x NOT IN ({_N}) AND NOT regexp_full_match(x, '[0-9x]+')))) AS list_distinct_keep FROM obs WHERE path IS NOT NULL)"""
)
def path_concepts(t):
    return _obs(t).filter("path IS NOT NULL").select("id", F.array_join(F.array_sort(X.path_concepts(F.col("path"))), "|").alias("concepts"))


@query(
    f"""WITH {_OBS}, w AS (SELECT id, {_W} AS w FROM obs WHERE source = 'terminal')
    SELECT id, coalesce(lower(w[1]), '') || CASE WHEN lower(w[1]) IN ({", ".join(f"'{c}'" for c in W.COMPOUND_COMMANDS)}) AND len(list_filter(w[2:], lambda x: NOT starts_with(x, '-'))) > 0
      THEN '|' || lower(list_filter(w[2:], lambda x: NOT starts_with(x, '-'))[1]) ELSE '' END AS concepts FROM w"""
)
def command_concepts(t):
    return _obs(t).filter("source = 'terminal'").select("id", F.array_join(X.command_concepts(F.col("content")), "|").alias("concepts"))


@query(
    f"""WITH {_OBS} SELECT count(*) AS n, count(*) FILTER ({_any("lower(list_extract(string_split(path, '/'), -1))", W.SENSITIVE_NAMES)}) AS sensitive,
    count(*) FILTER (list_extract(string_split(lower(list_extract(string_split(path, '/'), -1)), '.'), -1) IN ({", ".join(f"'{x}'" for x in W.BINARY_EXTENSIONS)}) AND contains(list_extract(string_split(path, '/'), -1), '.')) AS binaries,
    count(*) FILTER ({_any("path || '/'", W.IGNORED_PATHS)}) AS excluded FROM obs WHERE path IS NOT NULL"""
)
def path_filters(t):
    p = F.col("path")
    return _obs(t).filter("path IS NOT NULL").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(X.sensitive_file(p)).alias("sensitive"), F.count_if(X.binary_file(p)).alias("binaries"),
        F.count_if(X.excluded_path(p, W.IGNORED_PATHS)).alias("excluded"),
    )
