"""Episodes, conversations, usage, rules and the smaller tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from cairnflow.functions import exprs as X
from cairnflow.operators import events as E, records as D, store
from cairnflow.plans.event_queries import _OBS, _obs
from cairnflow.plans.registry import AS_OF, Registry

_R = Registry()
query, QUERIES, SQL = _R.query, _R.QUERIES, _R.SQL

#: The moment at which the event stream is looked at, and the window of an episode.
MOMENT, MOMENT_US, MINUTES = "2024-01-30 12:00:00", 1_706_616_000_000_000, 600

_EP = f"""e AS (SELECT user_id, event_id, ts, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) AS k FROM events),
  r AS (SELECT user_id, event_id, ts, us, k, us AS start_us, event_id AS first_id FROM e WHERE k = 1
    UNION ALL SELECT e.user_id, e.event_id, e.ts, e.us, e.k, CASE WHEN e.us - r.start_us <= 36000000000 THEN r.start_us ELSE e.us END, CASE WHEN e.us - r.start_us <= 36000000000 THEN r.first_id ELSE e.event_id END
    FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1),
  ep AS (SELECT user_id, start_us, (row_number() OVER (PARTITION BY user_id ORDER BY start_us) - 1)::INT AS episode, max(us) AS end_us, count(*) AS n_events FROM r GROUP BY user_id, start_us),
  st AS (SELECT *, user_id || '-' || episode AS id, CASE WHEN start_us + 36000000000 < {MOMENT_US} THEN 'closed' ELSE 'open' END AS state FROM ep WHERE start_us <= {MOMENT_US})"""


def _windows(t):
    return E.anchored_windows(t("events"), ["user_id"], "ts", "event_id", MINUTES)


def _episodes(t):
    return D.with_state(_windows(t), ["user_id"], MOMENT_US, MINUTES)


@query(f"WITH RECURSIVE {_EP} SELECT id, user_id, episode, start_us, n_events, state, state = 'closed' AND n_events < 2 AS sparse FROM st")
def episode_states(t):
    """Every episode as it stands at the moment."""
    return _episodes(t).select("id", "user_id", "episode", "start_us", "n_events", "state", "sparse")


@query(f"WITH RECURSIVE {_EP} SELECT id, end_us, n_events FROM st WHERE state = 'closed' ORDER BY end_us DESC, id LIMIT 50 OFFSET 50")
def episode_list(t):
    """The second page of closed episodes, the newest first."""
    return _episodes(t).filter("state = 'closed'").orderBy(F.desc("end_us"), "id").offset(50).limit(50).select("id", "end_us", "n_events")


@query(f"WITH RECURSIVE {_EP} SELECT user_id, arg_max(id, start_us) AS id, max(start_us) AS start_us FROM st WHERE state = 'open' GROUP BY user_id")
def episode_open(t):
    """The open episode of each user."""
    return _episodes(t).filter("state = 'open'").groupBy("user_id").agg(F.max_by("id", "start_us").alias("id"), F.max("start_us").alias("start_us"))


@query(f"WITH RECURSIVE {_EP} SELECT CASE WHEN start_us + 36000000000 < {MOMENT_US} + 7200000000 THEN 'closed' ELSE state END AS state, count(*) AS n FROM st GROUP BY 1")
def episode_close(t):
    """Episodes by state two hours later, the idle ones closed."""
    return D.close_idle(_episodes(t), MOMENT_US + 7_200_000_000, MINUTES).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {_EP} SELECT count(*) AS n_closed, sum(n_events) AS n_events FROM st")
def episode_drain(t):
    """All episodes closed by force, as at the end of a run."""
    d = D.close_idle(_episodes(t), MOMENT_US, MINUTES, force=True).filter("state = 'closed'")
    return d.agg(F.count(F.lit(1)).alias("n_closed"), F.sum("n_events").alias("n_events"))


@query(f"WITH RECURSIVE {_EP} SELECT event_id, CASE WHEN st.state = 'open' THEN st.id ELSE '' END AS open_episode FROM r JOIN st USING (user_id, start_us) WHERE us <= {MOMENT_US}")
def raw_open_episode(t):
    """Each event's open episode, empty where it is closed."""
    e = t("events").filter(F.col("ts") <= F.lit(MOMENT).cast("timestamp_ntz"))
    placed = D.episode_of(e, _windows(t), ["user_id"], "ts")
    s = _episodes(t).select("user_id", "episode", "id", "state")
    return placed.join(s, ["user_id", "episode"]).select("event_id", F.when(F.col("state") == "open", F.col("id")).otherwise("").alias("open_episode"))


@query(
    f"""WITH RECURSIVE {_EP} SELECT event_id, coalesce(array_to_string(list(event_id) OVER (PARTITION BY user_id, start_us ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), ','), '') AS before FROM r"""
)
def preceding_context(t):
    """Up to five events of the same episode before each."""
    placed = D.episode_of(t("events"), _windows(t), ["user_id"], "ts")
    return D.preceding(placed, ["user_id", "episode"], "ts", "event_id").select("event_id", F.array_join("before", ",").alias("before"))


_TURNS = """turns AS (SELECT session_id AS conv_id, row_number() OVER (PARTITION BY session_id ORDER BY timestamp, id) AS turn, content AS text, timestamp AS ts, id FROM (SELECT * FROM raw_memories QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST) = 1) WHERE session_id IS NOT NULL),
  said AS (SELECT *, CASE WHEN turn % 5 = 0 THEN 'tool' WHEN turn % 2 = 1 THEN 'user' ELSE 'assistant' END AS role FROM turns)"""


def _turns(t):
    """The observations of agent sessions as turns of a conversation."""
    r = store.latest_delivery(t("raw_memories")).filter("session_id IS NOT NULL")
    turn = F.row_number().over(Window.partitionBy("session_id").orderBy("timestamp", "id"))
    s = r.select(F.col("session_id").alias("conv_id"), turn.alias("turn"), F.col("content").alias("text"), F.col("timestamp").alias("at"), "id")
    return s.withColumn("role", F.when(F.col("turn") % 5 == 0, "tool").when(F.col("turn") % 2 == 1, "user").otherwise("assistant"))


@query(
    f"""WITH {_TURNS} SELECT conv_id, count(*) AS n_messages, coalesce(left(arg_min(text, turn) FILTER (role = 'user'), 60), '') AS title, left(arg_max(text, turn), 100) AS preview, max(ts) AS last_at
    FROM said WHERE role IN ('user', 'assistant') GROUP BY conv_id ORDER BY last_at DESC, conv_id LIMIT 50"""
)
def conversation_list(t):
    return D.conversations(_turns(t))


@query(
    f"""WITH {_TURNS} SELECT conv_id, turn, text FROM (SELECT conv_id, turn, text FROM turns WHERE turn % 3 <> 0 UNION ALL SELECT conv_id, turn, upper(text) FROM turns WHERE turn % 3 = 0) WHERE conv_id NOT IN (SELECT conv_id FROM turns GROUP BY 1 HAVING count(*) < 3)"""
)
def conversation_upsert(t):
    """Streamed turns written again, the last version kept, and conversations below three turns deleted."""
    s = _turns(t).select("conv_id", "turn", "text", F.lit(1).alias("version"))
    again = s.filter("turn % 3 = 0").withColumns({"text": F.upper("text"), "version": F.lit(2)})
    kept = store.upsert_latest(s, again, ["conv_id", "turn"], "version")
    small = s.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n < 3")
    return kept.join(small, "conv_id", "left_anti").select("conv_id", "turn", "text")


@query(f"WITH {_TURNS} SELECT conv_id, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at, date_sub('second', min(ts), max(ts)) AS seconds FROM said GROUP BY conv_id")
def agent_session_history(t):
    return D.session_history(_turns(t))


@query(f"WITH {_TURNS} SELECT conv_id, count(*) AS n FROM said WHERE role = 'user' GROUP BY conv_id")
def session_digest_count(t):
    return _turns(t).filter("role = 'user'").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


def _calls(t):
    """Events as calls of a model: the props are the request, the type and value the response."""
    e = t("events")
    failed = F.col("event_type") == "error"
    return e.select(
        "ts", F.col("user_id").cast("string").alias("caller"), F.col("event_type").alias("operation"), F.col("props").alias("request"),
        F.when(~failed, F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.col("event_type"))).alias("response"), F.col("value").alias("latency_ms"),
        F.when(failed, F.concat(F.lit("failed: "), F.col("props"))).alias("error"),
    )


_CALLS = "c AS (SELECT *, CASE WHEN event_type <> 'error' THEN CASE WHEN event_id % 3 = 0 THEN props ELSE event_type END END AS response FROM events)"


@query(
    f"""WITH {_CALLS} SELECT ts, user_id::VARCHAR AS caller, event_type AS operation, value AS latency_ms, event_type <> 'error' AS success, ceil(length(coalesce(props, '')) / 4.0)::BIGINT AS prompt_tokens,
    CASE WHEN event_type <> 'error' THEN ceil(length(coalesce(response, '')) / 4.0)::BIGINT ELSE 0 END AS completion_tokens, CASE WHEN event_type = 'error' THEN left('failed: ' || props, 200) END AS error FROM c"""
)
def usage_record(t):
    """Usage records of model calls."""
    return D.usage_rows(_calls(t))


@query(f"SELECT tool, n, errors FROM (SELECT lower(event_type) AS tool, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)")
def tool_usage_record(t):
    return D.usage_rows(_calls(t)).groupBy(F.lower("operation").alias("tool")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("success")).alias("errors"))


@query(
    f"""WITH {_CALLS} SELECT '{{"task_type":' || to_json(event_type) || ',"request":' || to_json(props) || ',"response":' || to_json(response) || ',"parse_success":' || CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END || '}}' AS line
    FROM c WHERE event_type <> 'error' AND props IS NOT NULL"""
)
def training_capture(t):
    """Captured successes as JSON lines."""
    return D.training_capture(_calls(t).filter("request IS NOT NULL"))


def _log(t):
    """A cycle for every day on which memories were made."""
    day = F.to_date("created_at").alias("day")
    return t("memories").groupBy(day).agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("state") == "merged").alias("merged"), F.max("updated_at").alias("created_at"))


_LOG = "lg AS (SELECT created_at::DATE AS day, count(*) AS processed, count(*) FILTER (state = 'merged') AS merged, max(updated_at) AS created_at FROM memories GROUP BY 1)"


@query(f"WITH {_LOG} SELECT created_at::DATE::VARCHAR AS day, count(*) AS cycles, sum(processed)::BIGINT AS processed, sum(merged)::BIGINT AS merged FROM lg WHERE created_at IS NOT NULL GROUP BY 1 ORDER BY day DESC LIMIT 30")
def consolidation_daily(t):
    lg = _log(t).filter("created_at IS NOT NULL").groupBy(F.to_date("created_at").cast("string").alias("day"))
    return lg.agg(F.count(F.lit(1)).alias("cycles"), F.sum("processed").alias("processed"), F.sum("merged").alias("merged")).orderBy(F.desc("day")).limit(30)


@query(f"WITH {_LOG} SELECT day::VARCHAR AS day, processed, merged, created_at FROM lg ORDER BY created_at DESC NULLS LAST, day DESC LIMIT 1")
def consolidation_last(t):
    last = _log(t).agg(F.max_by(F.struct(F.col("day").cast("string").alias("day"), "processed", "merged", "created_at"), F.struct("created_at", "day")).alias("x"))
    return last.select("x.*")


@query(
    f"""WITH {_LOG}, h AS (SELECT date_sub('second', max(created_at), {{AS_OF}}) / 3600.0 AS h FROM lg)
    SELECT round(h, 4) AS hours, CASE WHEN h > 72 THEN 'warning' WHEN h > 48 THEN 'info' ELSE 'ok' END AS severity, h > 72 AS dispatch FROM h"""
)
def consolidation_age(t):
    """The hours since the last cycle and whether they call for one."""
    return D.cycle_age(_log(t), AS_OF)


_RULES = [
    {"name": "slow_view", "event_type": "view", "priority": 3, "condition": "value > 20", "cooldown": 7200},
    {"name": "any_error", "event_type": "error", "priority": 5, "condition": "true", "cooldown": 0},
    {"name": "big_purchase", "event_type": "purchase", "priority": 1, "condition": "value > 50", "cooldown": 21600},
]


def _rule_sql(r: dict) -> str:
    n, met = r["name"], f"FROM events WHERE event_type = '{r['event_type']}' AND {r['condition']}"
    if not r["cooldown"]:
        return f"f_{n} AS (SELECT '{n}' AS rule, {r['priority']} AS priority, event_id {met})"
    us = r["cooldown"] * 1_000_000
    return f"""m_{n} AS (SELECT event_id, epoch_us(ts) AS us, row_number() OVER (ORDER BY ts, event_id) AS k {met}),
    r_{n} AS (SELECT event_id, k, us AS last, true AS ok FROM m_{n} WHERE k = 1 UNION ALL SELECT e.event_id, e.k, CASE WHEN r.last <= e.us - {us} THEN e.us ELSE r.last END, r.last <= e.us - {us} FROM r_{n} r JOIN m_{n} e ON e.k = r.k + 1),
    f_{n} AS (SELECT '{n}' AS rule, {r['priority']} AS priority, event_id FROM r_{n} WHERE ok)"""


@query(f"WITH RECURSIVE {', '.join(map(_rule_sql, _RULES))} " + " UNION ALL ".join(f"SELECT * FROM f_{r['name']}" for r in _RULES))
def rule_engine(t):
    """Three rules with conditions, priorities and cooldowns over the event stream."""
    return D.fired(t("events"), _RULES, "ts", "event_id")


@query("SELECT (count(*) * 10) // 1024 AS estimated_mb, (count(*) * 10) // 1024 > 5 AS exceeds FROM memories")
def rule_conditions(t):
    return D.store_size_exceeds(t("memories"), 5)


@query(
    """SELECT consumer, count(*) AS n, max(event_id) AS newest FROM events JOIN (VALUES ('encoder', 'view'), ('encoder', 'click'), ('dreamer', 'purchase'), ('monitor', 'error'), ('monitor', 'purchase')) s(consumer, event_type) USING (event_type) GROUP BY consumer"""
)
def event_subscriptions(t):
    """What each consumer of the event bus receives."""
    s = D.subscribed(t("events"), {"encoder": ["view", "click"], "dreamer": ["purchase"], "monitor": ["error", "purchase"]})
    return s.groupBy("consumer").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("newest"))


@query(f"WITH {_OBS} SELECT id, digest FROM (SELECT id, md5(coalesce(content, '')) AS digest, lag(md5(coalesce(content, ''))) OVER (PARTITION BY coalesce(project, '') ORDER BY timestamp, id) AS b FROM obs WHERE source = 'clipboard') WHERE digest IS DISTINCT FROM b")
def clipboard_changes(t):
    """Clipboard snapshots that differ from the one before."""
    o = _obs(t).filter("source = 'clipboard'").withColumn("project", F.coalesce("project", F.lit("")))
    return D.changes(o, ["project"], "timestamp", "id", F.col("content")).select("id", "digest")


@query(
    f"""WITH {_OBS} SELECT id, CASE WHEN lower(coalesce(path, '')) = 'mem' THEN 'memory' WHEN path LIKE 'src/lagoon%/%' AND false THEN '' WHEN starts_with(path, 'pkg/') OR path = 'pkg' THEN 'packages' WHEN starts_with(path, 'docs/') THEN 'handbook'
      WHEN path LIKE 'lib/_%' THEN CASE WHEN lower(split_part(path, '/', 2)) = 'mem' THEN 'memory' ELSE split_part(path, '/', 2) END WHEN path LIKE 'src/_%' THEN CASE WHEN lower(split_part(path, '/', 2)) = 'mem' THEN 'memory' ELSE split_part(path, '/', 2) END ELSE '' END AS project FROM obs"""
)
def project_resolve(t):
    """The project of each observation's path."""
    p = D.resolve_project(F.col("path"), {"mem": "memory"}, {"pkg": "packages", "docs": "handbook"}, ["lib", "src"])
    return _obs(t).select("id", p.alias("project"))


@query()
def fallback_encode(t):
    """Observations encoded without a model."""
    f = D.fallback_encoding(store.latest_delivery(t("raw_memories")))
    return f.select("id", "gist", "summary", "content", F.array_join("concepts", "|").alias("concepts"), F.round("salience", 6).alias("salience"))


@query()
def episode_synthesis(t):
    """Episode texts parsed from captured answers, whole and broken ones."""
    m = t("memories").select("id", F.length("content").alias("n"), F.to_json(F.struct(F.col("summary").alias("title"), F.col("content").alias("narrative"), "concepts")).alias("j"))
    text = F.when(F.col("n") % 3 == 0, F.col("j")).when(F.col("n") % 3 == 1, F.concat(F.lit("Here it is:\n```json\n"), F.col("j"), F.lit("\n```"))).otherwise(F.left("j", F.lit(30)))
    return D.parsed_synthesis(m.select("id", text.alias("response")), "response").select("id", "title", "summary", "narrative", "emotional_tone", F.array_join("concepts", "|").alias("concepts"))


_VOC = "(" + ", ".join(f"'{w}'" for w in ("worker", "queue", "index", "memory", "cache", "harbor", "amber", "stone")) + ")"
_VOCABULARY = "worker queue index memory cache harbor amber stone".split()


@query(
    f"""WITH w AS (SELECT id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS w FROM memories), n AS (SELECT id, count(*) AS n, count(*) FILTER (w IN {_VOC}) AS hits FROM w GROUP BY id),
    c AS (SELECT id, string_agg(w, '|' ORDER BY k) AS top FROM (SELECT id, w, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, w) AS k FROM w WHERE w IN {_VOC} GROUP BY id, w) WHERE k <= 5 GROUP BY id)
    SELECT id, round(least(0.9, 0.3 + 0.6 * coalesce(hits, 0) / greatest(coalesce(n, 0), 1)), 9) AS salience, coalesce(top, '') AS concepts FROM memories LEFT JOIN n USING (id) LEFT JOIN c USING (id) WHERE content IS NOT NULL"""
)
def vocabulary_salience(t):
    """Salience and concepts of memories by a vocabulary."""
    m = t("memories").filter("content IS NOT NULL")
    c = F.col("content")
    return m.select("id", F.round(D.density_salience(c, _VOCABULARY), 9).alias("salience"), F.array_join(D.vocabulary_concepts(c, _VOCABULARY), "|").alias("concepts"))


@query("SELECT id, CASE WHEN source = 'mcp' THEN 'agent' ELSE coalesce(type, '') END AS kind, coalesce(project, '') AS project, 2 + (source = 'mcp')::INT AS n FROM memories")
def merge_maps(t):
    """Two maps merged, the later value winning."""
    a = F.create_map(F.lit("kind"), F.coalesce("type", F.lit("")), F.lit("project"), F.coalesce("project", F.lit("")))
    b = F.when(F.col("source") == "mcp", F.create_map(F.lit("kind"), F.lit("agent"), F.lit("tool"), F.lit("x"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    m = t("memories").select("id", D.merged_maps(a, b).alias("m"))
    return m.select("id", F.col("m")["kind"].alias("kind"), F.col("m")["project"].alias("project"), F.size("m").alias("n"))


@query("SELECT id, array_to_string(a || list_filter(b, lambda x: NOT list_contains(a, x)), ',') AS evidence FROM (SELECT id, list_filter(coalesce(gist_of, []), lambda x: true) AS a, [id, coalesce(raw_id, id)] AS b FROM memories WHERE raw_id IS NOT NULL)")
def evidence_union(t):
    """Evidence lists united in order, repeated ids once."""
    m = t("memories").filter("raw_id IS NOT NULL")
    return m.select("id", F.array_join(F.array_union(F.coalesce("gist_of", F.array().cast("array<string>")), F.array("id", "raw_id")), ",").alias("evidence"))


@query("SELECT id, 'both' AS side FROM (SELECT source_id AS id FROM associations INTERSECT SELECT target_id FROM associations) UNION ALL SELECT id, 'source' FROM (SELECT source_id AS id FROM associations EXCEPT SELECT target_id FROM associations)")
def edge_end_sets(t):
    """Ids that are both ends of edges, and those that are sources only."""
    a, b = t("associations").select(F.col("source_id").alias("id")), t("associations").select(F.col("target_id").alias("id"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("source")))


@query("SELECT memory_id, gist, created_at FROM (SELECT id AS memory_id, CASE WHEN v = 2 THEN content ELSE summary END AS gist, CASE WHEN v = 2 THEN updated_at ELSE created_at END AS created_at, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN v = 2 THEN updated_at ELSE created_at END DESC NULLS LAST, v DESC) AS k FROM memories, (VALUES (1), (2)) x(v)) WHERE k = 1")
def resolution_upsert(t):
    """Resolutions (gist levels of a memory) written at creation and again at the update: the last stays."""
    m = t("memories")
    old = m.select(F.col("id").alias("memory_id"), F.col("summary").alias("gist"), "created_at")
    new = m.select(F.col("id").alias("memory_id"), F.col("content").alias("gist"), F.col("updated_at").alias("created_at"))
    return store.upsert_latest(old, new, ["memory_id"], "created_at")


@query("SELECT id AS memory_id, len(concepts) AS n_topics, concepts[1] AS first_topic, 'project' AS entity_type, project AS entity FROM memories WHERE concepts IS NOT NULL")
def concept_set_upsert(t):
    """Concept sets stored as JSON text and read back."""
    m = t("memories").filter("concepts IS NOT NULL")
    stored = m.select(F.col("id").alias("memory_id"), F.to_json("concepts").alias("topics"), F.to_json(F.struct(F.lit("project").alias("type"), F.col("project").alias("name")), {"ignoreNullFields": "false"}).alias("entity"))
    read = stored.select("memory_id", F.from_json("topics", "array<string>").alias("topics"), F.from_json("entity", "type string, name string").alias("e"))
    return read.select("memory_id", F.size("topics").alias("n_topics"), F.get("topics", F.lit(0)).alias("first_topic"), F.col("e.type").alias("entity_type"), F.col("e.name").alias("entity"))


@query("SELECT id AS memory_id, CASE WHEN feedback_score > 0 THEN 'important' ELSE 'routine' END AS significance, CASE WHEN type = 'error' THEN 'frustrating' ELSE 'neutral' END AS tone FROM memories")
def attributes_upsert(t):
    """Attributes with defaults, overwritten where feedback or the type says more."""
    m = t("memories")
    base = m.select(F.col("id").alias("memory_id"), F.lit("routine").alias("significance"), F.lit("neutral").alias("tone"))
    new = m.select(F.col("id").alias("memory_id"), F.when(F.col("feedback_score") > 0, "important").alias("significance"), F.when(F.col("type") == "error", "frustrating").alias("tone"))
    return store.update(base, new, "memory_id", ["significance", "tone"])


@query("SELECT id, salience AS strength, state FROM memories WHERE len(gist_of) > 0 AND state = 'active' AND salience >= 0.3 ORDER BY salience DESC, id LIMIT 100")
def pattern_list(t):
    """Active patterns of some strength, the strongest first."""
    p = t("memories").filter((F.size("gist_of") > 0) & (F.col("state") == "active") & (F.col("salience") >= 0.3))
    return p.orderBy(F.desc("salience"), "id").limit(100).select("id", F.col("salience").alias("strength"), "state")


@query("SELECT id, CASE WHEN state = 'active' THEN 'archived' ELSE state END AS state FROM memories WHERE len(gist_of) > 0")
def pattern_archive_all(t):
    p = t("memories").filter(F.size("gist_of") > 0)
    done = p.filter("state = 'active'").select("id", F.lit("archived").alias("state"))
    return store.update(p.select("id", "state"), done, "id", ["state"])


@query("SELECT type, state, count(*) AS n, round(max(salience), 6) AS top FROM memories WHERE type IN ('decision', 'insight') GROUP BY ALL")
def abstraction_by_state(t):
    a = t("memories").filter("type IN ('decision', 'insight')")
    return a.groupBy("type", "state").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("salience"), 6).alias("top"))


_META = """mo AS (SELECT event_id AS id, ts AS created_at, event_type AS kind, CASE WHEN event_type = 'error' THEN 'critical' WHEN value > 20 THEN 'warning' ELSE 'info' END AS severity FROM events)"""


def _meta(t):
    e = t("events")
    severity = F.when(F.col("event_type") == "error", "critical").when(F.col("value") > 20, "warning").otherwise("info")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("kind"), severity.alias("severity"))


@query(f"WITH {_META} SELECT id, kind, severity FROM mo WHERE severity <> 'info' ORDER BY created_at DESC, id LIMIT 100")
def meta_observations_list(t):
    return _meta(t).filter("severity <> 'info'").orderBy(F.desc("created_at"), "id").limit(100).select("id", "kind", "severity")


@query(f"WITH {_META} SELECT severity, count(*) AS n FROM mo WHERE created_at >= TIMESTAMP '2024-01-15' GROUP BY severity")
def meta_observations_prune(t):
    """Observations after the old ones are deleted."""
    kept = _meta(t).filter("created_at >= TIMESTAMP_NTZ'2024-01-15 00:00:00'")
    return kept.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_OBS} SELECT DISTINCT split_part(path, '/', 1) AS pattern FROM obs WHERE path IS NOT NULL AND split_part(path, '/', 1) <> 'docs'")
def exclusions(t):
    """Exclusions added (repeated ones once), one removed, listed."""
    rows = _obs(t).filter("path IS NOT NULL").select(F.get(F.split("path", "/"), F.lit(0)).alias("pattern"))
    added = store.insert_ignore(rows.limit(0), rows, ["pattern"])
    return added.filter("pattern <> 'docs'")


@query("SELECT 'last_' || event_type AS key, arg_max(event_id, (ts, event_id))::VARCHAR AS value FROM events GROUP BY event_type")
def meta_upsert(t):
    """A key-value table in which the last write of a key stays."""
    e = t("events").select(F.concat(F.lit("last_"), F.col("event_type")).alias("key"), F.col("event_id").cast("string").alias("value"), F.struct("ts", "event_id").alias("version"))
    return store.upsert_latest(e.limit(0), e, ["key"], "version").select("key", "value")


@query(
    """WITH q AS (SELECT id, row_number() OVER (ORDER BY CASE lower(trim(source)) WHEN 'mcp' THEN 0 WHEN 'terminal' THEN 1 WHEN 'clipboard' THEN 2 ELSE 3 END, created_at, id) AS k FROM
      (SELECT * FROM raw_memories QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST) = 1) WHERE NOT coalesce(processed, false)) SELECT id, k <= 100 AND k % 3 <> 0 AS processed FROM q"""
)
def claim_unclaim(t):
    """Unprocessed observations after a batch is claimed and every third of it is given back."""
    r = store.latest_delivery(t("raw_memories"))
    batch = store.claim(r, 100)
    k = F.row_number().over(Window.orderBy(store.source_priority(F.col("source")), "created_at", "id"))  # the claimed batch only
    failed = batch.withColumn("k", k).filter("k % 3 = 0")
    after = store.unclaim(store.mark(r, batch), failed)
    return after.join(r.filter(~F.coalesce("processed", F.lit(False))).select("id"), "id", "left_semi").select("id", "processed")


@query(
    """SELECT 'memories ' || count(*) || ', active ' || count(*) FILTER (state = 'active') || ', edges ' || (SELECT count(*) FROM associations) || ', waiting ' || (SELECT count(DISTINCT id) FROM raw_memories WHERE NOT coalesce(processed, false)) AS report FROM memories"""
)
def health_report(t):
    """Totals as a line of text."""
    m = t("memories").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "active").alias("a"))
    e = t("associations").agg(F.count(F.lit(1)).alias("e"))
    w = t("raw_memories").filter(~F.coalesce("processed", F.lit(False))).agg(F.count_distinct("id").alias("w"))
    return m.crossJoin(e).crossJoin(w).select(F.format_string("memories %d, active %d, edges %d, waiting %d", "n", "a", "e", "w").alias("report"))


@query("SELECT id, summary FROM memories WHERE trim(summary) <> ''")
def hide_empty_summaries(t):
    return t("memories").filter(F.trim("summary") != "").select("id", "summary")


@query(
    """SELECT id, printf('salience %.3f, accesses %d, state %s', salience + 1e-9, coalesce(access_count, 0), state) AS explanation, '{"id":' || to_json(id) || ',"state":' || to_json(state) || ',"n_concepts":' || len(concepts) || '}' AS shaped FROM memories WHERE concepts IS NOT NULL"""
)
def result_shapes(t):
    """Results with an explanation in words and as JSON."""
    m = t("memories").filter("concepts IS NOT NULL")
    text = F.format_string("salience %.3f, accesses %d, state %s", F.col("salience") + 1e-9, F.coalesce("access_count", F.lit(0)), "state")
    return m.select("id", text.alias("explanation"), F.to_json(F.struct("id", "state", F.size("concepts").alias("n_concepts"))).alias("shaped"))


@query("SELECT id, md5(coalesce(content, '')) AS md5, left(sha256(coalesce(project, '')), 32) AS project_hash FROM memories")
def content_hashes(t):
    return t("memories").select("id", F.md5(F.coalesce("content", F.lit(""))).alias("md5"), X.content_hash(F.col("project")).alias("project_hash"))
