"""The named operations as queries over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnflow.functions import exprs as X, word_lists as W
from cairnflow.plans import tools as T
from cairnflow.plans.registry import AS_OF, Registry

_R = Registry()
query, QUERIES, SQL = _R.query, _R.QUERIES, _R.SQL

_VISIBLE = "NOT coalesce(recall_suppressed, false)"


def _tables(t):
    return {n: t(n) for n in ("raw_memories", "memories", "associations", "retrieval_feedback")}


def _new(t):
    """Memories handed in as observations, some under ids that are known."""
    m = t("memories").filter("raw_id IS NOT NULL")
    return m.select(F.when(F.length("content") % 2 == 0, F.col("raw_id")).otherwise(F.concat(F.lit("new-"), "id")).alias("id"), F.lit("mcp").alias("source"), "type", "content")


_WEIGHT = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in W.TYPE_SALIENCE.items()) + " ELSE 0.7 END"


@query(f"SELECT 'new-' || id AS id, {_WEIGHT}::DOUBLE AS initial_salience FROM memories WHERE raw_id IS NOT NULL AND length(content) % 2 <> 0")
def tool_remember(t):
    """What is new among the observations handed in, with its first salience."""
    return T.remember(_tables(t), _new(t)).filter(F.col("id").startswith("new-")).select("id", "initial_salience")


@query("SELECT 'new-' || id AS id, 'handoff' AS type, 0.95::DOUBLE AS initial_salience FROM memories WHERE raw_id IS NOT NULL AND length(content) % 2 <> 0")
def tool_create_handoff(t):
    return T.create_handoff(_tables(t), _new(t)).filter(F.col("id").startswith("new-")).select("id", "type", "initial_salience")


@query(f"SELECT id, timestamp FROM memories WHERE project = 'tidepool' AND state IN ('active', 'fading') AND {_VISIBLE} ORDER BY timestamp DESC, id LIMIT 5")
def tool_get_context(t):
    return T.get_context(_tables(t), "tidepool").select("id", "timestamp")


@query("SELECT id, CASE WHEN id = (SELECT min(id) FROM memories) THEN 'archived' ELSE state END AS state FROM memories")
def tool_forget(t):
    one = t("memories").agg(F.min("id")).first()[0]
    return T.forget(_tables(t), [one]).select("id", "state")


@query(
    """SELECT count(*) AS total, count(*) FILTER (state = 'active') AS active, count(*) FILTER (state = 'fading') AS fading, count(*) FILTER (state = 'archived') AS archived, count(*) FILTER (state = 'merged') AS merged,
    (SELECT count(DISTINCT id) FROM raw_memories WHERE NOT coalesce(processed, false)) AS pending FROM memories"""
)
def tool_status(t):
    return T.status(_tables(t))


@query(
    f"""SELECT 'memory' AS part, id, salience AS score FROM memories WHERE project = 'tidepool' AND salience >= 0.7 AND {_VISIBLE} UNION ALL SELECT 'pattern', id, salience FROM memories WHERE project = 'tidepool' AND len(gist_of) > 0 AND state = 'active' AND salience >= 0.3
    UNION ALL SELECT 'summary', state, count(*)::DOUBLE FROM memories WHERE project = 'tidepool' GROUP BY state"""
)
def tool_recall_project(t):
    return T.project_overview(_tables(t), "tidepool")


@query(f"SELECT id, timestamp FROM memories WHERE timestamp >= {{AS_OF}} - INTERVAL 240 HOUR AND {_VISIBLE} ORDER BY timestamp DESC, id LIMIT 50")
def tool_recall_timeline(t):
    return T.recall_timeline(_tables(t), AS_OF, 240).select("id", "timestamp")


@query("SELECT session_id, min(timestamp) AS start_ts, max(timestamp) AS end_ts, count(*) AS n FROM memories WHERE session_id IS NOT NULL GROUP BY session_id")
def tool_list_sessions(t):
    return T.list_sessions(_tables(t))


@query("SELECT id, timestamp FROM memories WHERE session_id = (SELECT min(session_id) FROM memories)")
def tool_recall_session(t):
    one = t("memories").agg(F.min("session_id")).first()[0]
    return T.recall_session(_tables(t), one).select("id", "timestamp")


@query("SELECT id, salience AS strength, state, len(gist_of) AS n FROM memories WHERE len(gist_of) > 0 AND salience >= 0.3")
def tool_get_patterns(t):
    return T.get_patterns(_tables(t)).select("id", "strength", "state", F.size("evidence_ids").alias("n"))


@query("SELECT id, salience FROM memories WHERE type = 'insight' ORDER BY salience DESC, id LIMIT 10")
def tool_get_insights(t):
    return T.get_insights(_tables(t)).select("id", "salience")


@query("SELECT query_id, CASE WHEN feedback = 'irrelevant' THEN 'partial' ELSE feedback END AS feedback FROM retrieval_feedback")
def tool_feedback(t):
    """Ratings sent again for some queries: the later ones stay."""
    again = t("retrieval_feedback").filter("feedback = 'irrelevant'").withColumns({"feedback": F.lit("partial"), "created_at": F.expr("created_at + INTERVAL 1 DAY")})
    return T.feedback(_tables(t), again).select("query_id", "feedback")


@query(
    """WITH n AS (SELECT * FROM (SELECT * FROM raw_memories QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST) = 1) ORDER BY created_at DESC, id LIMIT 60)
    SELECT n.id, m.id AS memory_id, m.summary FROM n LEFT JOIN memories m ON m.raw_id = n.id WHERE n.source = 'filesystem' ORDER BY n.created_at DESC, n.id LIMIT 20"""
)
def tool_audit_encodings(t):
    return T.audit_encodings(_tables(t), 20, "filesystem").select("id", "memory_id", "summary")


@query("SELECT feedback AS value, count(*) AS n FROM retrieval_feedback WHERE feedback <> '' GROUP BY feedback")
def tool_coach(t):
    """The shares of ratings that coaching is written from."""
    out = T.coach(_tables(t))
    return out.select(F.col(out.columns[0]).alias("value"), "n")


@query("SELECT DISTINCT split_part(json_extract_string(metadata, '$.path'), '/', 2) AS pattern FROM raw_memories WHERE json_valid(metadata) AND json_extract_string(metadata, '$.path') IS NOT NULL UNION SELECT 'vendor'")
def tool_exclude_path(t):
    """Exclusions with those of the observations' folders, repeated ones ignored, listed."""
    known = t("memories").sparkSession.createDataFrame([("vendor",)], "pattern string")
    path = F.get_json_object("metadata", "$.path")
    new = t("raw_memories").filter(path.isNotNull()).select(F.get(F.split(path, "/"), F.lit(1)).alias("pattern"))
    return T.list_exclusions(T.exclude_path(known, new))


@query("SELECT id, CASE WHEN type = 'error' THEN upper(summary) ELSE summary END AS summary, round(CASE WHEN type = 'error' THEN least(1.0, salience + 0.05) ELSE salience END, 9) AS salience FROM memories")
def tool_amend(t):
    new = t("memories").filter("type = 'error' AND summary IS NOT NULL").select(
        F.col("id").alias("memory_id"), F.lit(None).cast("string").alias("new_content"), F.upper("summary").alias("new_summary"), F.col("updated_at").alias("amended_at")
    )
    return T.amend(_tables(t), new)[0].select("id", "summary", F.round("salience", 9).alias("salience"))


@query("WITH o AS (SELECT min(id) AS id FROM memories) SELECT m.id, state, (SELECT count(*) FROM associations WHERE source_id = o.id OR target_id = o.id) AS links FROM memories m JOIN o USING (id)")
def tool_check_memory(t):
    one = t("memories").agg(F.min("id")).first()[0]
    return T.check_memory(_tables(t), one).select("id", "state", "links")


@query("WITH o AS (SELECT min(id) AS id FROM memories WHERE len(gist_of) > 0) SELECT m.id, CASE WHEN m.id = o.id THEN 'archived' ELSE state END AS state FROM memories m, o WHERE len(gist_of) > 0")
def tool_dismiss_pattern(t):
    p = t("memories").filter(F.size("gist_of") > 0)
    return T.dismiss_pattern(_tables(t), p.agg(F.min("id")).first()[0]).filter(F.size("gist_of") > 0).select("id", "state")


@query(
    f"""WITH q AS (SELECT query_id, unnest(list_distinct(list_filter(string_split_regex(lower(query_text), '[^a-z0-9]+'), lambda w: length(w) >= 5))) AS c FROM retrieval_feedback),
    m AS (SELECT DISTINCT id, salience, lower(c) AS c FROM (SELECT id, salience, unnest(concepts) AS c FROM memories WHERE {_VISIBLE})), h AS (SELECT query_id, id, max(salience) AS salience, count(*) AS hits FROM q JOIN m USING (c) GROUP BY ALL)
    SELECT query_id, id, hits, row_number() OVER (PARTITION BY query_id ORDER BY salience DESC, id) AS rank FROM h QUALIFY rank <= 7"""
)
def tool_recall_by_concepts(t):
    """The short way of a recall, by concepts that the queries name."""
    q = t("retrieval_feedback").select("query_id", F.filter(X.tokens(F.col("query_text")), lambda w: F.length(w) >= 5).alias("concepts"))
    return T.recall_by_concepts(_tables(t), q).select("query_id", "id", "hits", "rank")


@query(
    """WITH r AS (SELECT query_id, unnest(retrieved_memory_ids) AS id FROM retrieval_feedback), l AS (SELECT source_id AS id, target_id AS other, strength, relation_type FROM associations UNION ALL SELECT target_id, source_id, strength, relation_type FROM associations),
    b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY strength DESC, other, relation_type) AS place FROM l QUALIFY place <= 3) SELECT query_id, id, other, strength, relation_type, place FROM r JOIN b USING (id)"""
)
def tool_recall_associations(t):
    """The three strongest links of every returned memory."""
    r = t("retrieval_feedback").select("query_id", F.explode("retrieved_memory_ids").alias("id"))
    return T.with_associations(r, t("associations"))


@query("SELECT query_id, query_text, array_to_string(retrieved_memory_ids[1:7], ',') AS ids FROM retrieval_feedback WHERE len(retrieved_memory_ids) > 0")
def tool_recall_record(t):
    """The record that a recall leaves for its rating."""
    f = t("retrieval_feedback")
    ranked = f.select("query_id", F.posexplode("retrieved_memory_ids").alias("rank", "id")).filter("rank < 7")
    return T.feedback_record(ranked, f, AS_OF).select("query_id", "query_text", F.array_join("retrieved_memory_ids", ",").alias("ids"))
