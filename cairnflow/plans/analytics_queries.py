"""Aggregations, charts and self-observation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnflow.operators import analytics as A
from cairnflow.operators.lifecycle import at
from cairnflow.plans.registry import AS_OF, Registry

_R = Registry()
query, QUERIES, SQL = _R.query, _R.QUERIES, _R.SQL

_STATES = "count(*) AS total, count(*) FILTER (state = 'active') AS active, count(*) FILTER (state = 'fading') AS fading, count(*) FILTER (state = 'archived') AS archived, count(*) FILTER (state = 'merged') AS merged"


@query(f"SELECT {_STATES}, (SELECT count(*) FROM associations) AS edges, round((SELECT count(*) FROM associations) / count(*)::DOUBLE, 6) AS edges_per_memory FROM memories")
def stats_by_state(t):
    e = t("associations").agg(F.count(F.lit(1)).alias("edges"))
    return A.state_counts(t("memories")).crossJoin(e).withColumn("edges_per_memory", F.round(F.col("edges") / F.col("total"), 6))


@query(f"SELECT project, {_STATES}, max(timestamp) AS last_seen, round(max(salience), 6) AS top_salience FROM memories WHERE project <> '' GROUP BY project")
def project_summary(t):
    m = t("memories").filter("project <> ''")
    last = m.groupBy("project").agg(F.max("timestamp").alias("last_seen"), F.round(F.max("salience"), 6).alias("top_salience"))
    return A.state_counts(m, ["project"]).join(last, "project")


@query(
    """WITH c AS (SELECT project, lower(trim(c)) AS concept, count(*) AS n FROM (SELECT project, unnest(concepts) AS c FROM memories WHERE project <> '') WHERE trim(c) <> '' GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, concept) AS rank FROM c) WHERE rank <= 10"""
)
def project_top_concepts(t):
    c = t("memories").filter("project <> ''").select("project", F.explode("concepts").alias("c")).select("project", F.lower(F.trim("c")).alias("concept")).filter("concept <> ''")
    return A.top_values(c, ["project"], "concept", 10)


@query("SELECT DISTINCT project FROM memories WHERE project <> ''")
def distinct_projects(t):
    return t("memories").filter("project <> ''").select("project").distinct()


@query(
    """WITH s AS (SELECT session_id, min(timestamp) AS start_ts, max(timestamp) AS end_ts, count(*) AS n FROM memories WHERE session_id IS NOT NULL GROUP BY ALL),
    c AS (SELECT session_id, lower(c) AS c, count(*) AS k FROM (SELECT session_id, unnest(concepts) AS c FROM memories WHERE session_id IS NOT NULL) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY k DESC, c) AS rank FROM c)
    SELECT s.*, coalesce((SELECT string_agg(c, ', ' ORDER BY rank) FROM r WHERE r.session_id = s.session_id AND rank <= 5), '') AS topics FROM s"""
)
def session_summary_topk(t):
    m = t("memories").filter("session_id IS NOT NULL")
    s = m.groupBy("session_id").agg(F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"), F.count(F.lit(1)).alias("n"))
    c = m.select("session_id", F.explode("concepts").alias("c")).select("session_id", F.lower("c").alias("c"))
    top = A.top_values(c, ["session_id"], "c", 5).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rank", "c"))).alias("t"))
    topics = F.coalesce(F.array_join(F.transform("t", lambda x: x["c"]), ", "), F.lit(""))
    return s.join(top, "session_id", "left").select("session_id", "start_ts", "end_ts", "n", topics.alias("topics"))


@query("SELECT source, count(*) AS n FROM memories WHERE source IS NOT NULL GROUP BY source")
def source_distribution(t):
    return t("memories").filter("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT source, count(*) AS total, count(*) FILTER (state = 'active') AS active, round(sum(salience), 4) AS salience, round(count(*) FILTER (state = 'active') / count(*)::DOUBLE, 6) AS survival
    FROM memories WHERE state <> 'merged' AND source IS NOT NULL GROUP BY source"""
)
def signal_noise(t):
    m = t("memories").filter("state <> 'merged' AND source IS NOT NULL")
    active = F.count_if(F.col("state") == "active")
    return m.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"), active.alias("active"), F.round(F.sum("salience"), 4).alias("salience"), F.round(active / F.count(F.lit(1)), 6).alias("survival")
    )


@query("SELECT CASE WHEN access_count = 0 THEN '0' WHEN access_count <= 2 THEN '1-2' WHEN access_count <= 5 THEN '3-5' ELSE '6+' END AS bucket, count(*) AS n, min(access_count) AS low FROM memories GROUP BY ALL")
def recall_buckets(t):
    return t("memories").groupBy(A.recall_bucket(F.col("access_count")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("access_count").alias("low"))


@query(
    """SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) FILTER (feedback = 'helpful') AS helpful, count(*) FILTER (feedback = 'partial') AS partial, count(*) FILTER (feedback = 'irrelevant') AS irrelevant
    FROM retrieval_feedback WHERE feedback <> '' GROUP BY ALL ORDER BY day DESC LIMIT 30"""
)
def feedback_trend(t):
    f = t("retrieval_feedback").filter("feedback <> ''")
    return f.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(
        *[F.count_if(F.col("feedback") == k).alias(k) for k in ("helpful", "partial", "irrelevant")]
    ).orderBy(F.desc("day")).limit(30)


@query(f"SELECT strftime(created_at, '%Y-%m-%d') AS day, {_STATES} FROM memories GROUP BY ALL")
def survival_cohort(t):
    return A.state_counts(t("memories").withColumn("day", F.date_format("created_at", "yyyy-MM-dd")), ["day"])


@query("SELECT CASE WHEN salience >= 0.8 THEN 'critical' WHEN salience >= 0.5 THEN 'high' WHEN salience >= 0.3 THEN 'medium' ELSE 'low' END AS tier, source, count(*) AS n FROM memories WHERE source IS NOT NULL GROUP BY ALL")
def salience_tiers(t):
    return t("memories").filter("source IS NOT NULL").groupBy(A.salience_tier(F.col("salience")).alias("tier"), "source").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH r AS (SELECT DISTINCT id, lower(trim(source)) AS source, processed FROM raw_memories), e AS (SELECT DISTINCT raw_id FROM memories WHERE raw_id IS NOT NULL)
    SELECT source, count(*) AS n_raw, count(*) FILTER (processed) AS n_processed, count(raw_id) AS n_encoded, round(count(raw_id) / count(*)::DOUBLE, 6) AS encoding_rate FROM r LEFT JOIN e ON raw_id = id GROUP BY source"""
)
def pipeline_rates(t):
    r = t("raw_memories").select("id", F.lower(F.trim("source")).alias("source"), "processed").distinct()
    e = t("memories").filter("raw_id IS NOT NULL").select("raw_id").distinct()
    return r.join(e, F.col("id") == F.col("raw_id"), "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_raw"), F.count_if("processed").alias("n_processed"), F.count("raw_id").alias("n_encoded"),
        F.round(F.try_divide(F.count("raw_id"), F.count(F.lit(1))), 6).alias("encoding_rate"),
    )


def _usage(t):
    return t("events").select("ts", "event_id", F.col("event_type").alias("operation"), F.col("user_id").alias("caller"), F.col("value").alias("tokens"), (F.col("event_type") != "error").alias("success"))


_USAGE = "u AS (SELECT ts, event_id, event_type AS operation, user_id AS caller, value AS tokens, event_type <> 'error' AS success FROM events)"
_SUMS = "count(*) AS n, round(sum(tokens), 4) AS tokens, count(*) FILTER (NOT success) AS errors"


@query(
    f"""WITH {_USAGE} SELECT 'all' AS dimension, '' AS value, {_SUMS} FROM u UNION ALL SELECT 'operation', operation, {_SUMS} FROM u GROUP BY operation
    UNION ALL SELECT 'caller', CAST(caller AS VARCHAR), {_SUMS} FROM u GROUP BY caller"""
)
def usage_summary_grouping_sets(t):
    return A.usage_summary(_usage(t), ["operation", "caller"])


@query(f"WITH {_USAGE} SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS bucket, {_SUMS} FROM u GROUP BY ALL")
def usage_chart_hourly(t):
    return A.chart(_usage(t), "ts", 60)


@query(f"WITH {_USAGE} SELECT operation, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS bucket, {_SUMS} FROM u GROUP BY ALL")
def usage_chart_by_operation(t):
    return A.chart(_usage(t), "ts", 360, ["operation"])


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 100")
def usage_log_topn(t):
    return t("events").orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "ts", "event_type")


@query("SELECT user_id, element_at(list_sort(list(value)), CAST(floor(count(*) * 0.95) AS INT) + 1)::DOUBLE AS value FROM events WHERE value IS NOT NULL GROUP BY user_id".replace("element_at(list_sort(list(value)), CAST(floor(count(*) * 0.95) AS INT) + 1)", "list_sort(list(value))[CAST(floor(count(*) * 0.95) AS INT) + 1]"))
def value_p95(t):
    return A.nth_percentile(t("events"), ["user_id"], "value", 0.95)


@query("SELECT project, pos - 1 AS pos, round(avg(embedding[pos]::DOUBLE), 6) AS mean FROM (SELECT project, embedding, unnest(generate_series(1, len(embedding))) AS pos FROM memories WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0) GROUP BY ALL")
def vector_mean(t):
    return A.mean_vector(t("memories"), ["project"], "embedding").withColumn("mean", F.round("mean", 6))


@query("SELECT concept, project FROM (SELECT concept, project, row_number() OVER (PARTITION BY concept ORDER BY count(*) DESC, project) AS k FROM (SELECT lower(unnest(concepts)) AS concept, project FROM memories WHERE project <> '') GROUP BY concept, project) WHERE k = 1")
def concept_mode_project(t):
    c = t("memories").filter("project <> ''").select(F.explode("concepts").alias("c"), "project").select(F.lower("c").alias("concept"), "project")
    return A.top_values(c, ["concept"], "project", 1).select("concept", "project")


@query(
    """SELECT count(*) AS n, count(*) FILTER (trim(coalesce(summary, '')) = '') AS no_summary, count(*) FILTER (concepts IS NULL OR len(concepts) = 0) AS no_concepts, count(*) FILTER (embedding IS NULL OR len(embedding) = 0) AS no_embedding,
    CASE WHEN count(*) FILTER (trim(coalesce(summary, '')) = '' OR concepts IS NULL OR len(concepts) = 0 OR embedding IS NULL OR len(embedding) = 0) / count(*)::DOUBLE > 0.2 THEN 'warning' ELSE 'info' END AS severity FROM memories"""
)
def metacog_quality(t):
    s, c, e = F.trim(F.coalesce("summary", F.lit(""))) == "", F.coalesce(F.size("concepts") <= 0, F.lit(True)), F.coalesce(F.size("embedding") <= 0, F.lit(True))
    s2, c2, e2 = s, F.col("concepts").isNull() | c, F.col("embedding").isNull() | e
    return t("memories").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(s2).alias("no_summary"), F.count_if(c2).alias("no_concepts"), F.count_if(e2).alias("no_embedding"),
        F.when(F.count_if(s2 | c2 | e2) / F.count(F.lit(1)) > 0.2, "warning").otherwise("info").alias("severity"),
    )


@query("SELECT arg_max(source, n) AS source, round(max(n) / sum(n)::DOUBLE, 6) AS share, max(n) / sum(n)::DOUBLE > 0.8 AS dominant FROM (SELECT source, count(*) AS n FROM memories WHERE source IS NOT NULL GROUP BY source)")
def metacog_balance(t):
    n = t("memories").filter("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    share = F.max("n") / F.sum("n")
    return n.agg(F.max_by("source", "n").alias("source"), F.round(share, 6).alias("share"), (share > 0.8).alias("dominant"))


@query(
    """SELECT round(avg((last_accessed IS NULL OR last_accessed < {AS_OF} - INTERVAL 30 DAY)::INT), 6) AS dead_ratio,
    CASE WHEN avg((last_accessed IS NULL OR last_accessed < {AS_OF} - INTERVAL 30 DAY)::INT) > 0.5 THEN 'critical' WHEN avg((last_accessed IS NULL OR last_accessed < {AS_OF} - INTERVAL 30 DAY)::INT) > 0.2 THEN 'warning' ELSE 'info' END AS severity FROM memories WHERE state = 'active'"""
)
def metacog_dead_ratio(t):
    r = F.avg((F.col("last_accessed").isNull() | (F.col("last_accessed") < at(AS_OF, 30))).cast("int"))
    return t("memories").filter("state = 'active'").agg(
        F.round(r, 6).alias("dead_ratio"), F.when(r > 0.5, "critical").when(r > 0.2, "warning").otherwise("info").alias("severity")
    )


@query(
    """SELECT count(*) AS rated, round(count(*) FILTER (feedback = 'helpful') / count(*)::DOUBLE, 6) AS helpful_share, round(count(*) FILTER (feedback = 'irrelevant') / count(*)::DOUBLE, 6) AS irrelevant_share
    FROM retrieval_feedback WHERE feedback IN ('helpful', 'partial', 'irrelevant') HAVING count(*) >= 3"""
)
def metacog_feedback(t):
    n = F.count(F.lit(1))
    share = lambda k: F.round(F.count_if(F.col("feedback") == k) / n, 6)
    return t("retrieval_feedback").filter("feedback IN ('helpful', 'partial', 'irrelevant')").agg(
        n.alias("rated"), share("helpful").alias("helpful_share"), share("irrelevant").alias("irrelevant_share")
    ).filter("rated >= 3")


@query(
    """WITH n AS (SELECT id, count(*) AS k FROM (SELECT unnest(retrieved_memory_ids) AS id FROM retrieval_feedback WHERE feedback = 'irrelevant') GROUP BY id HAVING count(*) >= 2)
    SELECT m.id, round(greatest(0.05, salience - 0.05), 6) AS salience FROM memories m JOIN n USING (id)"""
)
def irrelevant_demote(t):
    n = t("retrieval_feedback").filter("feedback = 'irrelevant'").select(F.explode("retrieved_memory_ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("k")).filter("k >= 2")
    return t("memories").join(n, "id", "left_semi").select("id", F.round(F.greatest(F.lit(0.05), F.col("salience") - 0.05), 6).alias("salience"))


@query(
    """WITH l AS (SELECT * FROM retrieval_feedback ORDER BY created_at DESC, query_id LIMIT 50)
    SELECT coalesce(nullif(feedback, ''), 'unrated') AS feedback, count(*) AS n FROM l GROUP BY ALL"""
)
def status_report(t):
    """Ratings among the fifty latest queries."""
    last = t("retrieval_feedback").orderBy(F.desc("created_at"), "query_id").limit(50)
    return last.groupBy(F.coalesce(F.nullif(F.col("feedback"), F.lit("")), F.lit("unrated")).alias("feedback")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT session_id, count(*) AS n, count(*) FILTER (contains(lower(content), 'decid')) AS decisions, count(*) FILTER (contains(lower(content), 'error') OR contains(lower(content), 'fail')) AS errors
    FROM (SELECT DISTINCT id, session_id, content FROM raw_memories) WHERE session_id IS NOT NULL GROUP BY session_id"""
)
def session_keywords(t):
    r = t("raw_memories").select("id", "session_id", "content").distinct().filter("session_id IS NOT NULL")
    low = F.lower("content")
    return r.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(low.contains("decid")).alias("decisions"), F.count_if(low.contains("error") | low.contains("fail")).alias("errors")
    )


# joins and groupings over the relational tables, where an operator has no memory table to run on
@query(
    """SELECT c_mktsegment AS segment, o_orderpriority AS priority, count(*) AS n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY ALL"""
)
def relational_join_aggregate(t):
    li = t("lineitem").filter(F.col("l_shipdate") >= F.lit("1995-01-01 00:00:00").cast("timestamp_ntz"))
    j = li.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")
    )


@query(
    """SELECT o_custkey AS custkey, o_orderkey AS orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5"""
)
def unnest_join_top5(t):
    from cairnflow.operators.search import top_k

    o = t("orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), "o_totalprice")
    return top_k(o, ["custkey"], [F.desc("o_totalprice"), F.col("orderkey")], 5).select("custkey", "orderkey", "rank")
