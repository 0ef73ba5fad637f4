"""Scans, writes and the association graph."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from cairnflow.functions import exprs as X
from cairnflow.operators import graph, search, store
from cairnflow.plans.registry import AS_OF, Registry

_R = Registry()
query, QUERIES, SQL = _R.query, _R.QUERIES, _R.SQL

_DIST = "(SELECT * FROM raw_memories QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST) = 1)"


@query(
    """WITH m AS (SELECT * FROM memories) SELECT * FROM (
    SELECT 'memory id repeated' AS check, count(*) AS violations FROM (SELECT id FROM m GROUP BY id HAVING count(*) > 1) UNION ALL
    SELECT 'raw_id repeated', count(*) FROM (SELECT raw_id FROM m WHERE raw_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1) UNION ALL
    SELECT 'raw_id unknown', count(*) FROM m WHERE raw_id IS NOT NULL AND raw_id NOT IN (SELECT id FROM raw_memories) UNION ALL
    SELECT 'edge repeated', count(*) FROM (SELECT source_id, target_id FROM associations GROUP BY ALL HAVING count(*) > 1) UNION ALL
    SELECT 'edge source unknown', count(*) FROM associations WHERE source_id NOT IN (SELECT id FROM m) UNION ALL
    SELECT 'edge target unknown', count(*) FROM associations WHERE target_id NOT IN (SELECT id FROM m) UNION ALL
    SELECT 'edge to itself', count(*) FROM associations WHERE source_id = target_id)"""
)
def integrity_check(t):
    return store.violations(t("memories"), t("associations"), t("raw_memories"))


@query("SELECT id, timestamp, source, created_at, project FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST) AS n FROM raw_memories) WHERE n = 1")
def latest_delivery(t):
    return store.latest_delivery(t("raw_memories")).select("id", "timestamp", "source", "created_at", "project")


@query(
    """SELECT id, len(embedding) AS dims, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM memories
    WHERE state IN ('active', 'fading') AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"""
)
def vector_scan(t):
    m = t("memories").filter(F.col("state").isin("active", "fading")).select("id", "embedding").filter(X.usable_vector(F.col("embedding")))
    return m.select("id", F.size("embedding").alias("dims"), F.round(X.norm(F.col("embedding")), 6).alias("norm"))


@query("SELECT id, created_at FROM memories WHERE state = 'active' ORDER BY created_at DESC, id LIMIT 50 OFFSET 50")
def paged_scan(t):
    return t("memories").filter("state = 'active'").orderBy(F.desc("created_at"), "id").offset(50).limit(50).select("id", "created_at")


_PRIO = "CASE lower(trim(source)) WHEN 'mcp' THEN 0 WHEN 'terminal' THEN 1 WHEN 'clipboard' THEN 2 ELSE 3 END"


@query(f"SELECT id, source, created_at FROM {_DIST} WHERE NOT coalesce(processed, false) ORDER BY {_PRIO}, created_at, id LIMIT 100")
def priority_queue_scan(t):
    return store.claim(store.latest_delivery(t("raw_memories")), 100).select("id", "source", "created_at")


@query(f"SELECT id, timestamp FROM {_DIST} WHERE timestamp > TIMESTAMP '2026-05-01' ORDER BY timestamp, id LIMIT 200")
def cursor_scan(t):
    r = store.latest_delivery(t("raw_memories").filter("timestamp > TIMESTAMP_NTZ'2026-05-01 00:00:00'"))
    return r.orderBy("timestamp", "id").limit(200).select("id", "timestamp")


@query("SELECT id, timestamp, state FROM memories WHERE timestamp BETWEEN TIMESTAMP '2026-04-10' AND TIMESTAMP '2026-05-10' AND state IN ('active', 'fading')")
def time_range_scan(t):
    low, high = F.lit("2026-04-10 00:00:00").cast("timestamp_ntz"), F.lit("2026-05-10 00:00:00").cast("timestamp_ntz")
    return t("memories").filter(F.col("timestamp").between(low, high) & F.col("state").isin("active", "fading")).select("id", "timestamp", "state")


@query("SELECT session_id, id, rank FROM (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY timestamp, id) AS rank FROM memories WHERE session_id IS NOT NULL) WHERE rank <= 10")
def session_scan(t):
    m = t("memories").filter("session_id IS NOT NULL").select("session_id", "id", "timestamp")
    return search.top_k(m, ["session_id"], [F.col("timestamp"), F.col("id")], 10).select("session_id", "id", "rank")


@query("SELECT project, id, rank FROM (SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY timestamp DESC, id) AS rank FROM memories WHERE project <> '' AND state IN ('active', 'fading')) WHERE rank <= 10")
def project_recent_scan(t):
    m = t("memories").filter("project <> '' AND state IN ('active', 'fading')").select("project", "id", "timestamp")
    return search.top_k(m, ["project"], [F.desc("timestamp"), F.col("id")], 10).select("project", "id", "rank")


@query("SELECT id FROM memories WHERE embedding IS NULL OR len(embedding) = 0")
def embedding_backfill(t):
    return t("memories").filter("embedding IS NULL OR size(embedding) = 0").select("id")


@query(
    """SELECT r.source, count(*) AS n_new FROM (SELECT DISTINCT id, source FROM raw_memories) r WHERE r.id NOT IN (SELECT raw_id FROM memories WHERE raw_id IS NOT NULL) GROUP BY r.source"""
)
def insert_unique_raw_id(t):
    """Observations not encoded yet: an insert that ignores known raw ids."""
    known = t("memories").filter("raw_id IS NOT NULL").select(F.col("raw_id").alias("id")).withColumn("source", F.lit(None).cast("string")).select("id", "source")
    every = store.insert_ignore(known, t("raw_memories").select("id", "source"), ["id"])
    return every.filter("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n_new"))


@query(
    f"""WITH w AS (SELECT id, timestamp, content_hash, lag(timestamp) OVER (PARTITION BY content_hash ORDER BY timestamp, id) AS before FROM {_DIST})
    SELECT id, timestamp, coalesce(content_hash IS NOT NULL AND timestamp - before <= INTERVAL 24 HOUR, false) AS seen_before FROM w"""
)
def hash_seen_24h(t):
    return store.seen_before(store.latest_delivery(t("raw_memories")))


@query(
    f"""SELECT split_part(path, '/', 1) AS top, count(*) AS n FROM (SELECT CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.path') END AS path FROM {_DIST})
    WHERE contains(path, '/vault') OR contains(path, 'index') OR contains(path, '.sql') GROUP BY ALL"""
)
def path_pattern_counts(t):
    hit = store.mark_paths(store.latest_delivery(t("raw_memories")), ["/vault", "index", ".sql"])
    return hit.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("top")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH a AS (SELECT unnest(retrieved_memory_ids) AS id, created_at AS t0 FROM retrieval_feedback), n AS (SELECT id, count(*) AS k, max(t0) AS t1 FROM a GROUP BY id)
    SELECT m.id, m.access_count + coalesce(k, 0) AS access_count, greatest(last_accessed, t1) AS last_accessed FROM memories m LEFT JOIN n USING (id)"""
)
def increment_access(t):
    a = t("retrieval_feedback").select(F.explode("retrieved_memory_ids").alias("id"), F.col("created_at").alias("at"))
    return store.increment_access(t("memories"), a).select("id", "access_count", "last_accessed")


@query(
    """SELECT id AS memory_id, content AS old_content, trim(content) || ' [amended]' AS new_content, round(least(1.0, salience + 0.05), 6) AS salience FROM memories WHERE type = 'error'"""
)
def amend_audit(t):
    m = t("memories")
    changes = m.filter("type = 'error'").select(
        F.col("id").alias("memory_id"), F.concat(F.trim("content"), F.lit(" [amended]")).alias("new_content"),
        F.lit(None).cast("string").alias("new_summary"), F.col("updated_at").alias("amended_at"),
    )
    after, audit = store.amend(m, changes)
    return audit.select("memory_id", "old_content", "new_content").join(
        after.select(F.col("id").alias("memory_id"), F.round("salience", 6).alias("salience")), "memory_id"
    )


@query(
    """WITH u AS (SELECT query_id, feedback, created_at, 0 AS n FROM retrieval_feedback UNION ALL
      SELECT query_id, coalesce(feedback, 'partial'), created_at + INTERVAL 1 HOUR, 1 FROM retrieval_feedback WHERE len(retrieved_memory_ids) > 2)
    SELECT query_id, feedback, created_at FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, n DESC) AS k FROM u) WHERE k = 1"""
)
def upsert_feedback(t):
    f = t("retrieval_feedback").select("query_id", "feedback", "created_at", "retrieved_memory_ids")
    later = f.filter(F.size("retrieved_memory_ids") > 2).select(
        "query_id", F.coalesce("feedback", F.lit("partial")).alias("feedback"), F.expr("created_at + INTERVAL 1 HOUR").alias("created_at")
    )
    return store.upsert_latest(f.drop("retrieved_memory_ids"), later, ["query_id"], "created_at")


@query("SELECT raw_id, id FROM (SELECT raw_id, id, row_number() OVER (PARTITION BY raw_id ORDER BY created_at, id) AS n FROM memories WHERE raw_id IS NOT NULL) WHERE n = 1")
def migration_rownumber_dedup(t):
    m = t("memories").filter("raw_id IS NOT NULL").select("raw_id", "id", "created_at")
    return search.top_k(m, ["raw_id"], [F.col("created_at"), F.col("id")], 1).select("raw_id", "id")


@query(
    """SELECT m.id, m.raw_id, r.source AS raw_source, coalesce(d.degree, 0) AS degree FROM memories m LEFT JOIN (SELECT DISTINCT id, source FROM raw_memories) r ON r.id = m.raw_id
    LEFT JOIN (SELECT node, count(*) AS degree FROM (SELECT source_id AS node FROM associations UNION ALL SELECT target_id FROM associations) GROUP BY node) d ON d.node = m.id"""
)
def memory_detail(t):
    raw = t("raw_memories").select(F.col("id").alias("raw_id"), F.col("source").alias("raw_source")).distinct()
    d = graph.degrees(t("associations")).select(F.col("node").alias("id"), "degree")
    return t("memories").select("id", "raw_id").join(raw, "raw_id", "left").join(d, "id", "left").select(
        "id", "raw_id", "raw_source", F.coalesce("degree", F.lit(0)).alias("degree")
    )


@query(
    """SELECT count(*) AS n_memories, sum(len(concepts)) AS n_concepts, (SELECT count(*) FROM associations) AS n_associations, (SELECT count(DISTINCT id) FROM raw_memories) AS n_raw FROM memories"""
)
def export_metadata(t):
    m = t("memories").agg(F.count(F.lit(1)).alias("n_memories"), F.sum(F.when(F.col("concepts").isNotNull(), F.size("concepts"))).alias("n_concepts"))
    return m.crossJoin(t("associations").agg(F.count(F.lit(1)).alias("n_associations"))).crossJoin(t("raw_memories").agg(F.count_distinct("id").alias("n_raw")))


_UND = "(SELECT source_id AS node, target_id AS other, strength FROM associations UNION ALL SELECT target_id, source_id, strength FROM associations)"


@query(f"SELECT node, count(*) AS degree, round(sum(strength), 4) AS total_strength, max(strength) AS max_strength FROM {_UND} GROUP BY node")
def node_degree(t):
    return graph.degrees(t("associations"))


@query("SELECT source_id, target_id, strength FROM associations WHERE source_id IN (SELECT id FROM memories WHERE project = 'tidepool') AND target_id IN (SELECT id FROM memories WHERE project = 'tidepool')")
def edge_induced_subgraph(t):
    return graph.induced(t("associations"), t("memories").filter("project = 'tidepool'")).select("source_id", "target_id", "strength")


@query("SELECT source_id, target_id, strength FROM associations WHERE strength >= 0.5")
def edge_prune_weak(t):
    return graph.prune(t("associations"), 0.5).select("source_id", "target_id", "strength")


@query("SELECT source_id, target_id FROM associations WHERE source_id IN (SELECT id FROM memories WHERE state = 'active') AND target_id IN (SELECT id FROM memories WHERE state = 'active')")
def edge_orphan_prune(t):
    return graph.induced(t("associations"), t("memories").filter("state = 'active'")).select("source_id", "target_id")


@query(
    """SELECT e.source_id, e.target_id, len(list_filter(coalesce(b.concepts, []), lambda y: list_contains(list_transform(coalesce(a.concepts, []), lambda x: lower(x)), lower(y)))) AS shared
    FROM associations e JOIN memories a ON a.id = e.source_id JOIN memories b ON b.id = e.target_id"""
)
def edge_shared_concepts(t):
    m = t("memories").select("id", "concepts")
    return (
        t("associations").join(m.select(F.col("id").alias("source_id"), F.col("concepts").alias("ca")), "source_id")
        .join(m.select(F.col("id").alias("target_id"), F.col("concepts").alias("cb")), "target_id")
        .select("source_id", "target_id", X.shared_count(F.col("ca"), F.col("cb")).alias("shared"))
    )


_OPP = " OR ".join(
    f"(contains(x, '{p}') AND contains(y, '{q}')) OR (contains(x, '{q}') AND contains(y, '{p}'))"
    for p, q in [("succeeded", "failed"), ("enabled", "disabled"), ("true", "false"), ("added", "removed"), ("created", "deleted"), ("started", "stopped"), ("working", "broken")]
)


@query(
    f"""WITH e AS (SELECT e.source_id, e.target_id, lower(a.content) AS x, lower(b.content) AS y, a.source AS s, abs(date_sub('second', a.timestamp, b.timestamp)) AS gap,
      len(list_filter(coalesce(b.concepts, []), lambda y: list_contains(list_transform(coalesce(a.concepts, []), lambda x: lower(x)), lower(y)))) AS shared
      FROM associations e JOIN memories a ON a.id = e.source_id JOIN memories b ON b.id = e.target_id)
    SELECT source_id, target_id, CASE WHEN coalesce(s, '') <> '' AND gap > 0 AND gap < 300 THEN 'temporal' WHEN shared >= 2 THEN 'reinforces' WHEN {_OPP} THEN 'contradicts' ELSE 'similar' END AS relation FROM e"""
)
def relation_classify(t):
    m = t("memories").select("id", "concepts", "content", "source", "timestamp")
    a, b = (m.select(*[F.col(c).alias(f"{p}_{c}") for c in m.columns]) for p in "ab")
    e = t("associations").join(a, F.col("source_id") == F.col("a_id")).join(b, F.col("target_id") == F.col("b_id"))
    gap = F.abs(F.expr("timestampdiff(SECOND, a_timestamp, b_timestamp)"))
    return e.select(
        "source_id", "target_id",
        graph.relation_of(gap, F.coalesce("a_source", F.lit("")) != "", X.shared_count(F.col("a_concepts"), F.col("b_concepts")), X.contradicts(F.col("a_content"), F.col("b_content"))).alias("relation"),
    )


@query(
    """WITH r AS (SELECT id FROM memories WHERE state = 'active' AND salience >= 0.5)
    SELECT source_id, target_id, round(least(1.0, strength * pow(1.05, (source_id IN (SELECT id FROM r))::INT + (target_id IN (SELECT id FROM r))::INT)), 9) AS strength,
    activation_count + (source_id IN (SELECT id FROM r))::INT + (target_id IN (SELECT id FROM r))::INT AS activation_count FROM associations"""
)
def strengthen_replayed(t):
    out = graph.strengthen(t("associations"), t("memories").filter("state = 'active' AND salience >= 0.5"))
    return out.select("source_id", "target_id", F.round("strength", 9).alias("strength"), "activation_count")


_PAIRS = """held AS (SELECT DISTINCT id, lower(c) AS c FROM (SELECT id, unnest(concepts) AS c FROM memories WHERE state IN ('active', 'fading'))),
  pairs AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM held x JOIN held y ON x.c = y.c AND x.id < y.id GROUP BY ALL)"""


@query(
    f"""WITH {_PAIRS} SELECT a, b, shared FROM pairs p WHERE shared >= 2 AND NOT EXISTS (SELECT 1 FROM associations e
    WHERE (e.source_id = a AND e.target_id = b) OR (e.source_id = b AND e.target_id = a))"""
)
def cross_pollinate(t):
    known = t("associations").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"))
    return graph.shared_concept_pairs(t("memories").filter("state IN ('active', 'fading')"), 2, without=known)


@query(
    f"""WITH v AS (SELECT id, coalesce(project, '') AS p, list_distinct(list_filter(list_transform(concepts, lambda q: lower(q)), lambda q: q IS NOT NULL)) AS c, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM memories WHERE state IN ('active', 'fading') AND len(embedding) = 128
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    n AS (SELECT x.id AS source_id, y.id AS target_id, x.p AS px, y.p AS py, x.c AS cx, y.c AS cy, round(list_cosine_similarity(x.v, y.v), 9) AS s FROM v x JOIN v y ON x.id <> y.id QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY s DESC, y.id) <= 10)
    SELECT source_id, target_id, len(list_intersect(cx, cy)) AS shared, round(0.5 * s, 6) AS strength FROM n WHERE px <> py AND s >= 0.2 AND len(list_intersect(cx, cy)) > 0"""
)
def cross_project_link(t):
    """Links to those of the ten nearest memories that are of another project and share a concept (cosine here at least 0.2)."""
    m = t("memories").filter("state IN ('active', 'fading')")
    v = m.filter(X.usable_vector(F.col("embedding")) & (F.size("embedding") == 128)).select(
        "id", F.coalesce("project", F.lit("")).alias("p"), F.col("embedding").alias("v"), X.folded_set(F.col("concepts")).alias("c")
    )
    near = search.vector_top_k(v, "id", "v", v, "id", "v", 10, exclude_self=True).filter("score >= 0.2")
    a, b = (v.select(F.col("id").alias(i), F.col("p").alias(f"p{i}"), F.col("c").alias(f"c{i}")) for i in ("source_id", "target_id"))
    j = near.select(F.col("query_id").alias("source_id"), F.col("id").alias("target_id"), "score").join(a, "source_id").join(b, "target_id")
    shared = F.size(F.array_intersect("csource_id", "ctarget_id"))
    j = j.filter((F.col("psource_id") != F.col("ptarget_id")) & (shared > 0))
    return j.select("source_id", "target_id", shared.alias("shared"), F.round(0.5 * F.col("score"), 6).alias("strength"))


@query(
    """WITH tr AS (SELECT f.feedback, f.ids[i] AS source_id, f.ids[j] AS target_id FROM (SELECT feedback, retrieved_memory_ids AS ids FROM retrieval_feedback WHERE feedback IN ('helpful', 'irrelevant')) f,
      generate_series(1, len(f.ids)) a(i), generate_series(1, len(f.ids)) b(j) WHERE i <> j),
    d AS (SELECT source_id, target_id, sum(CASE feedback WHEN 'helpful' THEN 0.05 ELSE -0.05 END)::DOUBLE AS d FROM tr GROUP BY ALL)
    SELECT source_id, target_id, round(greatest(0.05, least(1.0, strength + coalesce(d, 0))), 6) AS strength FROM associations LEFT JOIN d USING (source_id, target_id)"""
)
def feedback_edge_update(t):
    f = t("retrieval_feedback").filter("feedback IN ('helpful', 'irrelevant')")
    one = f.select("feedback", F.col("retrieved_memory_ids").alias("ids"), F.posexplode("retrieved_memory_ids").alias("i", "source_id"))
    tr = one.select("feedback", "i", "source_id", F.posexplode("ids").alias("j", "target_id")).filter("i <> j")
    d = tr.groupBy("source_id", "target_id").agg(F.sum(F.when(F.col("feedback") == "helpful", 0.05).otherwise(-0.05)).alias("d"))
    e = t("associations").join(d, ["source_id", "target_id"], "left")
    return e.select("source_id", "target_id", F.round(X.clamp(F.col("strength") + F.coalesce("d", F.lit(0.0)), 0.05, 1.0), 6).alias("strength"))


_MAP = "(SELECT id, min(gist_id) AS gist_id FROM (SELECT id AS gist_id, unnest(gist_of) AS id FROM memories) GROUP BY id)"


@query(
    f"""WITH m AS {_MAP}, r AS (SELECT coalesce(a.gist_id, source_id) AS source_id, coalesce(b.gist_id, target_id) AS target_id, a.gist_id IS NOT NULL OR b.gist_id IS NOT NULL AS moved, created_at, strength, relation_type
      FROM associations LEFT JOIN m a ON a.id = source_id LEFT JOIN m b ON b.id = target_id)
    SELECT source_id, target_id, strength, relation_type FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY moved, created_at, strength DESC, relation_type) AS n FROM r WHERE source_id <> target_id) WHERE n = 1"""
)
def merge_redirect(t):
    mapping = t("memories").select(F.col("id").alias("gist_id"), F.explode("gist_of").alias("id")).groupBy("id").agg(F.min("gist_id").alias("gist_id"))
    return graph.redirect(t("associations"), mapping).select("source_id", "target_id", "strength", "relation_type")


@query(
    """WITH RECURSIVE e AS (SELECT source_id AS a, target_id AS b FROM associations WHERE strength >= 0.8 UNION SELECT target_id, source_id FROM associations WHERE strength >= 0.8),
    r AS (SELECT a AS id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
    SELECT id, min(c) AS component FROM r GROUP BY id"""
)
def dedup_components(t):
    return graph.connected_components(t("associations").filter("strength >= 0.8"), "source_id", "target_id")


@query(
    """WITH RECURSIVE e AS (SELECT source_id AS a, target_id AS b FROM associations WHERE strength >= 0.8 UNION SELECT target_id, source_id FROM associations WHERE strength >= 0.8),
    r AS (SELECT a AS id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id), k AS (SELECT id, min(c) AS component FROM r GROUP BY id)
    SELECT component, id AS survivor, n FROM (SELECT component, id, count(*) OVER (PARTITION BY component) AS n, row_number() OVER (PARTITION BY component ORDER BY salience DESC, last_accessed DESC NULLS LAST, created_at DESC, id) AS k
    FROM k JOIN memories USING (id)) WHERE k = 1"""
)
def dedup_survivor(t):
    """Of every component the memory that stays: salience, last access, age, id."""
    c = graph.connected_components(t("associations").filter("strength >= 0.8"), "source_id", "target_id").join(
        t("memories").select("id", "salience", "last_accessed", "created_at"), "id"
    )
    w = Window.partitionBy("component").orderBy(F.desc("salience"), F.desc_nulls_last("last_accessed"), F.desc("created_at"), "id")
    n = F.count(F.lit(1)).over(Window.partitionBy("component"))
    return c.withColumns({"n": n, "k": F.row_number().over(w)}).filter("k = 1").select("component", F.col("id").alias("survivor"), "n")


@query(
    f"""WITH ep AS (SELECT project, date_trunc('hour', timestamp) AS h, min(timestamp) AS t0, max(timestamp) AS t1 FROM memories WHERE project <> '' GROUP BY ALL),
    o AS (SELECT *, lag(t1) OVER (PARTITION BY project ORDER BY t0) AS before, lag(h) OVER (PARTITION BY project ORDER BY t0) AS hb FROM ep)
    SELECT project, hb AS a, h AS b, round(0.8 - 0.6 * date_sub('second', before, t0) / 1800.0, 6) AS strength FROM o WHERE t0 - before <= INTERVAL 30 MINUTE"""
)
def episode_temporal_edges(t):
    """Edges between hourly episodes of a project that follow each other within 30 minutes."""
    ep = t("memories").filter("project <> ''").groupBy("project", F.date_trunc("HOUR", "timestamp").cast("timestamp_ntz").alias("h")).agg(
        F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1")
    )
    w = Window.partitionBy("project").orderBy("t0")
    o = ep.withColumns({"before": F.lag("t1").over(w), "a": F.lag("h").over(w)}).filter("t0 - before <= INTERVAL 30 MINUTES")
    gap = F.expr("timestampdiff(SECOND, before, t0)")
    return o.select("project", "a", F.col("h").alias("b"), F.round(0.8 - 0.6 * gap / 1800.0, 6).alias("strength"))


@query(
    """WITH x AS (SELECT source_id, target_id, relation_type AS kind, strength, 0 AS is_auto FROM associations UNION ALL
      SELECT target_id, source_id, 'mirror', strength / 2, 1 FROM associations)
    SELECT a, b, kind, strength, is_auto FROM (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, kind, strength, is_auto,
      row_number() OVER (PARTITION BY least(source_id, target_id), greatest(source_id, target_id) ORDER BY is_auto, strength DESC, kind) AS n FROM x) WHERE n = 1"""
)
def strongest_edge_per_pair(t):
    e = t("associations")
    real = e.select("source_id", "target_id", F.col("relation_type").alias("kind"), "strength", F.lit(0).alias("is_auto"))
    derived = e.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.lit("mirror").alias("kind"), (F.col("strength") / 2).alias("strength"), F.lit(1).alias("is_auto"))
    return graph.strongest_per_pair(real.unionByName(derived))
