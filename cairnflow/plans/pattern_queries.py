"""Gists, patterns and abstractions, their links and the whole maintenance cycle.

Merged memories serve as patterns (what they stand for is their evidence), decisions and insights as abstractions of
levels 2 and 3.  Folds whose result depends on an order have no SQL; they are tested against plain loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnflow.functions import exprs as X
from cairnflow.operators import clusters as K, graph, lifecycle as L, patterns as P, search
from cairnflow.plans.cluster_queries import _COS, _LOWC, _ROWS, _SHARED, _VEC, fold_sql
from cairnflow.plans.registry import AS_OF, Registry

_R = Registry()
query, QUERIES, SQL = _R.query, _R.QUERIES, _R.SQL

_OK = """{x} IS NOT NULL AND len({x}) = 128 AND len(list_filter({x}, lambda q: q IS NULL OR isnan(q) OR isinf(q))) = 0 AND len(list_filter({x}, lambda q: q <> 0)) > 0"""
_V = "list_transform(embedding, lambda q: q::DOUBLE) AS v"
_LOW = "list_distinct(list_filter(list_transform({x}, lambda q: lower(q)), lambda q: q IS NOT NULL))"
_USABLE = f"u AS (SELECT *, {_V} FROM memories WHERE {_OK.format(x='embedding')})"


def _patterns(t):
    """Merged memories as patterns: ``id, title, v, concepts, project, strength, state, created_at``."""
    m = t("memories").filter(F.size("gist_of") > 0)
    ok = X.usable_vector(F.col("embedding")) & (F.size("embedding") == 128)
    v = F.when(ok, F.col("embedding")).otherwise(F.array().cast("array<float>"))
    return m.select("id", F.coalesce("summary", F.lit("")).alias("title"), v.alias("v"), "concepts", F.coalesce("project", F.lit("")).alias("project"), F.col("salience").alias("strength"), "state", "created_at")


def _evidence(t):
    return t("memories").select(F.col("id").alias("pattern_id"), F.explode("gist_of").alias("memory_id"))


def _abstractions(t):
    m = t("memories").filter(F.col("type").isin("decision", "insight"))
    ok = X.usable_vector(F.col("embedding")) & (F.size("embedding") == 128)
    return m.select(
        "id", F.coalesce("summary", F.lit("")).alias("title"), F.when(ok, F.col("embedding")).otherwise(F.array().cast("array<float>")).alias("v"),
        F.when(F.col("type") == "decision", 2).otherwise(3).alias("level"), F.pow("salience", F.lit(4.0)).alias("confidence"), "state", "created_at",
    )


def _usable(t):
    return t("memories").filter(X.usable_vector(F.col("embedding")) & (F.size("embedding") == 128)).withColumn("v", F.col("embedding"))


_MEMBERS = "mem AS (SELECT DISTINCT cluster, m.* FROM (SELECT id AS cluster, unnest(gist_of) AS id FROM memories) c JOIN memories m USING (id))"


@query(
    f"""WITH {_MEMBERS}, n AS (SELECT cluster, count(*) AS n_sources, max(salience) AS salience, arg_max(coalesce(raw_id, ''), (created_at, id)) AS raw_id,
      arg_max(CASE WHEN trim(coalesce(summary, '')) = '' THEN CASE WHEN length(content) > 100 THEN left(content, 100) || '...' ELSE content END ELSE summary END, (created_at, id)) AS summary FROM mem GROUP BY cluster),
    p AS (SELECT cluster, project FROM (SELECT cluster, project, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, project) AS k FROM mem WHERE coalesce(project, '') <> '' GROUP BY cluster, project) WHERE k = 1),
    h AS (SELECT cluster, c, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, c) AS k FROM (SELECT cluster, unnest({_LOW.format(x='concepts')}) AS c FROM mem) GROUP BY cluster, c),
    c AS (SELECT cluster, string_agg(c, '|' ORDER BY k) AS concepts FROM h WHERE k <= 7 GROUP BY cluster),
    e AS (SELECT cluster, i, sum(x) AS x FROM (SELECT cluster, unnest(list_transform(embedding, lambda q: q::DOUBLE)) AS x, generate_subscripts(embedding, 1) AS i FROM mem WHERE {_OK.format(x='embedding')}) GROUP BY ALL),
    v AS (SELECT cluster, count(*) AS dims, round(sqrt(sum(power(x / n_sources, 2))), 5) AS length FROM e JOIN n USING (cluster) GROUP BY cluster)
    SELECT cluster, n_sources, salience, project, raw_id, summary, coalesce(concepts, '') AS concepts, coalesce(dims, 0) AS dims, length FROM n LEFT JOIN p USING (cluster) LEFT JOIN c USING (cluster) LEFT JOIN v USING (cluster)"""
)
def gist_build(t):
    """Gists of the sources that the merged memories name."""
    members = t("memories").select(F.col("id").alias("cluster"), F.explode("gist_of").alias("id"))
    g = P.gists(members, t("memories").withColumn("raw_id", F.coalesce("raw_id", F.lit(""))))
    length = F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 5)
    return g.select("cluster", "n_sources", "salience", "project", "raw_id", "summary", F.array_join("concepts", "|").alias("concepts"), F.coalesce(F.size("v"), F.lit(0)).alias("dims"), length.alias("length"))


_LEADERS = fold_sql(_ROWS, f"{_COS} >= 0.85", 3)


@query(
    f"""WITH RECURSIVE {_LEADERS}, m AS (SELECT id, 'gist-' || leader AS gist_id FROM led), r AS (SELECT coalesce(a.gist_id, source_id) AS source_id, coalesce(b.gist_id, target_id) AS target_id, a.gist_id IS NOT NULL OR b.gist_id IS NOT NULL AS moved, created_at, strength, relation_type
      FROM associations LEFT JOIN m a ON a.id = source_id LEFT JOIN m b ON b.id = target_id)
    SELECT source_id, target_id, strength, relation_type FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY moved, created_at, strength DESC, relation_type) AS n FROM r WHERE source_id <> target_id) WHERE n = 1"""
)
def merge_driver(t):
    """Clusters of active memories merged into gists: the redirected edges of the whole graph."""
    m = t("memories").filter("state = 'active'").select("id", F.coalesce("project", F.lit("")).alias("project"), F.col("embedding").alias("v"), "created_at")
    members = K.by_vector(m, ["project"]).select(F.col("leader").alias("cluster"), "id")
    return P.merge(t("memories"), t("associations"), members, AS_OF)[1].select("source_id", "target_id", "strength", "relation_type")


@query()
def pattern_extract(t):
    """New patterns of every project from concept clusters of salient memories."""
    return P.extract(t("memories"))[0].select("id", "project", "title", F.array_join("concepts", "|").alias("concepts"), F.round("strength", 9).alias("strength"))


@query(
    f"""WITH {_USABLE}, n AS (SELECT coalesce(project, '') AS cluster, count(*) AS n FROM memories GROUP BY 1),
    s AS (SELECT cluster, list(x ORDER BY i) AS v FROM (SELECT coalesce(project, '') AS cluster, i, sum(x) / any_value(n) AS x FROM (SELECT project, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u) w JOIN n ON n.cluster = coalesce(w.project, '') GROUP BY 1, 2) GROUP BY cluster),
    p AS (SELECT id, v FROM u WHERE len(gist_of) > 0), c AS (SELECT cluster, p.id, list_cosine_similarity(s.v, p.v) AS x FROM s, p)
    SELECT cluster, id, round(x, 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(x, 12) DESC, id) = 1 AND x >= 0.2"""
)
def cluster_pattern_match(t):
    """The pattern nearest to the mean vector of each project."""
    m = t("memories").select(F.coalesce("project", F.lit("")).alias("cluster"), "embedding")
    found = K.mean_vector_match(P.mean_vectors(m, "cluster", "embedding", 128), _patterns(t), 0.2)
    return found.select("cluster", "id", F.round("score", 6).alias("score"))


@query("SELECT id, n, round(least(CASE WHEN n > 50 THEN 1.0 ELSE 0.95 END, 0.5 + 0.03 * log2(1 + n)), 9) AS strength FROM (SELECT id, len(gist_of) AS n FROM memories WHERE len(gist_of) > 0)")
def pattern_reset(t):
    p = t("memories").filter(F.size("gist_of") > 0).select("id", F.size("gist_of").alias("n"))
    return p.select("id", "n", F.round(P.reset_strength(F.col("n")), 9).alias("strength"))


_NW = "len(list_filter(string_split_regex(coalesce(summary, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')) AS nw"
_JAC = "CASE WHEN len(list_distinct(x.w || y.w)) = 0 THEN 1.0 ELSE len(list_intersect(x.w, y.w)) / len(list_distinct(x.w || y.w))::DOUBLE END"


def _near_sql(jaccard: float, cosine: float) -> str:
    words, near = f"{_JAC} >= {jaccard}", f"{_COS} >= {cosine}"
    return f"CASE WHEN x.nw <= 4 OR y.nw <= 4 THEN {words} AND {near} ELSE {words} OR {near} END"


_TW = "list_distinct(list_filter(string_split_regex(lower(coalesce({x}, '')), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> ''))"
_V128 = _VEC.replace("len(embedding) > 0", "len(embedding) = 128")


@query(
    f"""WITH RECURSIVE {fold_sql(f"SELECT 1 AS key, id, salience AS o, {_V128}, {_TW.format(x='summary')} AS w, {_NW} FROM memories WHERE state = 'active' AND len(gist_of) > 0", _near_sql(0.5, 0.75), 1)},
    p AS (SELECT m.id, m.state, m.salience, coalesce(l.leader, m.id) AS leader FROM memories m LEFT JOIN led l USING (id) WHERE len(m.gist_of) > 0), b AS (SELECT leader, max(salience) AS best FROM p GROUP BY 1),
    e AS (SELECT p.leader AS id, count(DISTINCT g) AS n FROM (SELECT id, unnest(gist_of) AS g FROM memories) x JOIN p USING (id) GROUP BY 1)
    SELECT p.id, CASE WHEN p.leader <> p.id THEN 'archived' ELSE state END AS state, round(CASE WHEN p.leader = p.id THEN best ELSE salience END, 9) AS strength, coalesce(n, 0) AS n_evidence FROM p LEFT JOIN b ON b.leader = p.id LEFT JOIN e ON e.id = p.id"""
)
def dedup_patterns(t):
    """Patterns after the fold of near-duplicates: the strongest stands, with all evidence."""
    found = P.duplicates(_patterns(t).filter("state = 'active'").withColumn("scope", F.lit("all")), ["scope"], F.col("strength"), 0.5, 0.75)
    p, ev = P.fold_duplicates(_patterns(t), _evidence(t), found)
    n = ev.groupBy(F.col("pattern_id").alias("id")).agg(F.count(F.lit(1)).alias("n_evidence"))
    return p.join(n, "id", "left").select("id", "state", F.round("strength", 9).alias("strength"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


@query(
    f"""WITH RECURSIVE {fold_sql(f"SELECT CASE WHEN type = 'decision' THEN 2 ELSE 3 END AS key, id, -epoch_us(created_at) AS o, {_V128}, {_TW.format(x='summary')} AS w, {_NW} FROM memories WHERE state = 'active' AND type IN ('decision', 'insight')", _near_sql(0.6, 0.75), 1)}
    SELECT key AS level, id, leader FROM led WHERE id <> leader"""
)
def dedup_abstractions(t):
    """Abstractions of a level that repeat an older one."""
    live = _abstractions(t).filter("state = 'active'")
    return P.duplicates(live, ["level"], -F.unix_micros(F.col("created_at").cast("timestamp")), 0.6, 0.75).filter("id <> leader")


@query(
    f"""WITH x AS (SELECT id, type, created_at, {_TW.format(x='summary')} AS w, CASE WHEN {_OK.format(x='embedding')} THEN list_transform(embedding, lambda q: q::DOUBLE) END AS v FROM memories),
    h AS (SELECT * FROM x WHERE type IN ('decision', 'insight')), r AS (SELECT * FROM x WHERE type = 'learning')
    SELECT r.id, arg_min(h.id, (h.created_at, h.id)) AS match FROM r, h WHERE CASE WHEN len(list_distinct(r.w || h.w)) = 0 THEN 1.0 ELSE len(list_intersect(r.w, h.w)) / len(list_distinct(r.w || h.w))::DOUBLE END >= 0.4
      OR coalesce(CASE WHEN r.v IS NOT NULL AND h.v IS NOT NULL THEN list_cosine_similarity(r.v, h.v) END, 0) >= 0.75 GROUP BY r.id"""
)
def similar_abstraction(t):
    """For every learning the oldest abstraction of like title or vector."""
    m = t("memories").filter("type = 'learning'")
    ok = X.usable_vector(F.col("embedding")) & (F.size("embedding") == 128)
    rows = m.select("id", F.coalesce("summary", F.lit("")).alias("title"), F.when(ok, F.col("embedding")).otherwise(F.array().cast("array<float>")).alias("v"))
    return P.first_similar(rows, _abstractions(t), 0.4, 0.75)


@query(f"""WITH RECURSIVE {fold_sql(f"SELECT 'all' AS key, id, created_at AS o, {_V128} FROM memories WHERE len(gist_of) > 0", f'{_COS} >= 0.8', 2)} SELECT key AS scope, id, leader FROM led""")
def pattern_clusters(t):
    """Leader clusters of patterns by vector."""
    return K.by_vector(_patterns(t).withColumn("scope", F.lit("all")), ["scope"], 0.8, 2)


@query(f"""WITH RECURSIVE {fold_sql(f"SELECT 'all' AS key, id, created_at AS o, {_V128} FROM memories WHERE type = 'decision'", f'{_COS} >= 0.85', 2)} SELECT key AS scope, id, leader FROM led""")
def principle_clusters(t):
    return K.by_vector(_abstractions(t).filter("level = 2").withColumn("scope", F.lit("all")), ["scope"], 0.85, 2)


@query(f"""WITH RECURSIVE {fold_sql(f"SELECT coalesce(project, '') AS key, id, access_count AS o, {_LOWC} FROM memories WHERE state = 'active'", f'{_SHARED} >= 2', 2)} SELECT key AS project, id, leader FROM led""")
def insight_clusters(t):
    """Leader clusters of memories that share two concepts, in the order of their accesses."""
    m = t("memories").filter("state = 'active'").select("id", F.coalesce("project", F.lit("")).alias("project"), "concepts", F.col("access_count").alias("created_at"))
    return K.by_shared(m, ["project"], 2, 2)


_PAIR_CTE = f"""{_USABLE}, reps AS (SELECT v, min(id) AS r FROM u GROUP BY v), prs AS (SELECT a.r AS a, b.r AS b FROM reps a JOIN reps b ON a.r < b.r AND list_cosine_similarity(a.v, b.v) >= 0.9)"""


@query(f"WITH {_PAIR_CTE} SELECT a, b FROM prs")
def cosine_pairs(t):
    """Pairs of memories with a cosine of at least 0.9, equal vectors folded to one representative."""
    return K.cosine_pairs(_usable(t).select("id", "v"), 0.9)[0]


@query(
    f"""WITH RECURSIVE {_PAIR_CTE}, e AS (SELECT a, b FROM prs UNION SELECT b, a FROM prs UNION SELECT r, id FROM reps JOIN u USING (v) WHERE r <> id UNION SELECT id, r FROM reps JOIN u USING (v) WHERE r <> id),
    c AS (SELECT a AS id, a AS c FROM e UNION SELECT e.b, c.c FROM c JOIN e ON e.a = c.id), k AS (SELECT id, min(c) AS component FROM c GROUP BY id)
    SELECT component, id, row_number() OVER (PARTITION BY component ORDER BY salience DESC, last_accessed DESC NULLS LAST, created_at DESC, id) = 1 AS survives FROM k JOIN memories USING (id)"""
)
def vector_dedup(t):
    """Groups of near-equal vectors (cosine of at least 0.9) and the memory of each that stays."""
    from pyspark.sql import Window

    pairs, members = K.cosine_pairs(_usable(t).select("id", "v"), 0.9)
    links = pairs.unionByName(members.filter("id <> representative").select(F.col("representative").alias("a"), F.col("id").alias("b")))
    c = graph.connected_components(links).join(t("memories").select("id", "salience", "last_accessed", "created_at"), "id")
    w = Window.partitionBy("component").orderBy(F.desc("salience"), F.desc_nulls_last("last_accessed"), F.desc("created_at"), "id")
    return c.select("component", "id", (F.row_number().over(w) == 1).alias("survives"))


@query(
    f"""WITH {_USABLE}, p AS (SELECT * FROM u WHERE len(gist_of) > 0), r AS (SELECT * FROM u WHERE state = 'active' AND salience >= 0.5),
    n AS (SELECT r.id AS memory_id, p.id AS pattern_id, r.concepts AS ca, p.concepts AS cb, row_number() OVER (PARTITION BY r.id ORDER BY round(list_cosine_similarity(r.v, p.v), 12) DESC, p.id) AS k FROM r, p),
    l AS (SELECT * FROM n WHERE k <= 3 AND len(list_intersect({_LOW.format(x='ca')}, {_LOW.format(x='cb')})) > 0), g AS (SELECT pattern_id, memory_id FROM l ANTI JOIN (SELECT id AS pattern_id, unnest(gist_of) AS memory_id FROM memories) e USING (pattern_id, memory_id)),
    c AS (SELECT pattern_id AS id, count(*) AS n FROM g GROUP BY 1) SELECT id, coalesce(n, 0) AS n_new, round(least(1.0, salience + 0.02 * coalesce(n, 0)), 9) AS strength FROM memories LEFT JOIN c USING (id) WHERE len(gist_of) > 0"""
)
def link_to_patterns(t):
    """Replayed memories join the patterns near to them that share a concept."""
    new, p = P.link_evidence(_usable(t).filter("state = 'active' AND salience >= 0.5"), _patterns(t), _evidence(t))
    n = new.groupBy(F.col("pattern_id").alias("id")).agg(F.count(F.lit(1)).alias("n_new"))
    return p.join(n, "id", "left").select("id", F.coalesce("n_new", F.lit(0)).alias("n_new"), F.round("strength", 9).alias("strength"))


@query(
    f"""WITH {_USABLE}, p AS (SELECT * FROM u WHERE len(gist_of) > 0), n AS (SELECT p.id AS pattern_id, x.id AS memory_id, row_number() OVER (PARTITION BY p.id ORDER BY round(list_cosine_similarity(x.v, p.v), 12) DESC, x.id) AS k FROM p, u x),
    e AS (SELECT id AS pattern_id, unnest(gist_of) AS memory_id FROM memories), h AS (SELECT DISTINCT pattern_id FROM n JOIN e USING (pattern_id, memory_id) WHERE k <= 10)
    SELECT DISTINCT pattern_id AS id, pattern_id IN (SELECT pattern_id FROM h) AS passed FROM e"""
)
def pattern_self_test(t):
    """Whether a search by a pattern's own vector finds its evidence."""
    return P.self_test(_patterns(t), _evidence(t), _usable(t))


@query(
    f"""WITH {_USABLE}, q AS (SELECT * FROM u WHERE state = 'active'), p AS (SELECT * FROM u WHERE len(gist_of) > 0 AND state = 'active')
    SELECT q.id AS query_id, p.id, round(list_cosine_similarity(q.v, p.v), 5) AS score FROM q, p QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.v, p.v), 12) DESC, p.id) <= 5"""
)
def pattern_vector_topk(t):
    """The five active patterns nearest to every active memory."""
    out = search.vector_top_k(_patterns(t).filter("state = 'active'"), "id", "v", _usable(t).filter("state = 'active'").select("id", "v"), "id", "v", 5)
    return out.select("query_id", "id", F.round("score", 5).alias("score"))


@query(
    f"""WITH {_USABLE}, q AS (SELECT * FROM u WHERE state = 'active'), p AS (SELECT * FROM u WHERE type IN ('decision', 'insight') AND state = 'active')
    SELECT q.id AS query_id, p.id, round(list_cosine_similarity(q.v, p.v), 5) AS score FROM q, p QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.v, p.v), 12) DESC, p.id) <= 5"""
)
def abstraction_vector_topk(t):
    out = search.vector_top_k(_abstractions(t).filter("state = 'active'"), "id", "v", _usable(t).filter("state = 'active'").select("id", "v"), "id", "v", 5)
    return out.select("query_id", "id", F.round("score", 5).alias("score"))


@query(
    """SELECT id, round(c, 3) AS confidence FROM (SELECT id, CASE WHEN d > 14 THEN round(salience * power(0.98, d - 14), 3) ELSE salience END AS c, d FROM
    (SELECT id, salience, floor(date_sub('second', coalesce(last_accessed, created_at), {AS_OF}) / 86400.0) AS d FROM memories WHERE type = 'decision')) WHERE d <= 14 OR c >= 0.3"""
)
def principle_decay(t):
    m = t("memories").filter("type = 'decision'").select("id", F.col("salience").alias("confidence"), F.coalesce("last_accessed", "created_at").alias("last_confirmed"))
    return P.decay_principles(m, AS_OF).select("id", F.round("confidence", 3).alias("confidence"))


@query("SELECT id, round(salience * power(0.92, 5), 9) AS salience FROM memories")
def simulated_aging(t):
    return L.age(t("memories"), 5).select("id", F.round("salience", 9).alias("salience"))


@query()
def full_cycle(t):
    """One whole maintenance cycle; the record of what each step changed."""
    return L.full_cycle(t("memories"), t("associations"), _patterns(t), _evidence(t), _abstractions(t), t("retrieval_feedback"), AS_OF)["record"]


@query(
    f"""WITH {_USABLE}, q AS (SELECT * FROM u WHERE created_at >= {{AS_OF}} - INTERVAL 30 DAY AND state = 'active'),
    n AS (SELECT q.id AS source_id, x.id AS target_id, round(list_cosine_similarity(q.v, x.v), 12) AS s FROM q JOIN u x ON x.id <> q.id AND x.state IN ('active', 'fading') QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY s DESC, x.id) <= 5),
    k AS (SELECT n.*, abs(date_sub('second', a.timestamp, b.timestamp)) AS gap, coalesce(a.source, '') <> '' AS known, len(list_filter(coalesce(b.concepts, []), lambda y: list_contains(list_transform(coalesce(a.concepts, []), lambda x: lower(x)), lower(y)))) AS shared FROM n JOIN memories a ON a.id = source_id JOIN memories b ON b.id = target_id WHERE s > 0.3)
    SELECT source_id, target_id, round(s, 6) AS strength, CASE WHEN known AND gap > 0 AND gap < 300 THEN 'temporal' WHEN shared >= 2 THEN 'reinforces' ELSE 'other' END AS relation FROM k"""
)
def link_new_memories(t):
    """New memories linked with the five nearest ones above a cosine of 0.3; the relation by its rules."""
    v = _usable(t)
    new = v.filter(F.col("created_at") >= F.expr(f"TIMESTAMP_NTZ'{AS_OF}' - INTERVAL 30 DAYS")).filter("state = 'active'").select("id", "v")
    near = search.vector_top_k(v.filter("state IN ('active', 'fading')").select("id", "v"), "id", "v", new, "id", "v", 5, exclude_self=True).filter("score > 0.3")
    m = t("memories").select("id", "concepts", "source", "timestamp", "content")
    a, b = (m.select(*[F.col(c).alias(f"{p}_{c}") for c in m.columns]) for p in "ab")
    e = near.join(a, F.col("query_id") == F.col("a_id")).join(b, F.col("id") == F.col("b_id"))
    gap = F.abs(F.expr("timestampdiff(SECOND, a_timestamp, b_timestamp)"))
    kind = graph.relation_of(gap, F.coalesce("a_source", F.lit("")) != "", X.shared_count(F.col("a_concepts"), F.col("b_concepts")), X.contradicts(F.col("a_content"), F.col("b_content")))
    return e.select(
        F.col("query_id").alias("source_id"), F.col("id").alias("target_id"), F.round("score", 6).alias("strength"),
        F.when(kind.isin("temporal", "reinforces"), kind).otherwise("other").alias("relation"),
    )


@query("SELECT source_id, target_id, 0.9 AS strength, relation_type, 1 AS activation_count FROM associations")
def explicit_edges(t):
    """The graph written into metadata, one JSON object for each memory, and read back as explicit edges."""
    e = t("associations").select("source_id", F.struct(F.col("target_id").alias("memory_id"), F.col("relation_type").alias("relation")).alias("x"))
    meta = e.groupBy("source_id").agg(F.to_json(F.struct(F.lit("x").alias("tool"), F.collect_list("x").alias("associations"))).alias("metadata"))
    return graph.explicit_edges(meta, "source_id", "metadata")


@query(
    """WITH c AS (SELECT least(target_id, source_id) AS a, greatest(target_id, source_id) AS b, max(strength / 2) AS s FROM associations WHERE relation_type = 'temporal' GROUP BY ALL)
    SELECT source_id, target_id, round(coalesce(s, strength), 9) AS strength FROM associations LEFT JOIN c ON a = least(source_id, target_id) AND b = greatest(source_id, target_id)"""
)
def set_edge_strength(t):
    """Strength set for pairs written the other way round: both directions follow."""
    e = t("associations")
    changes = e.filter("relation_type = 'temporal'").select(F.col("target_id").alias("a"), F.col("source_id").alias("b"), (F.col("strength") / 2).alias("strength"))
    return graph.set_strength(e, changes).select("source_id", "target_id", F.round("strength", 9).alias("strength"))


@query(
    """WITH en AS (SELECT DISTINCT query_id, unnest(retrieved_memory_ids) AS id FROM retrieval_feedback), tr AS (SELECT DISTINCT query_id, source_id, target_id FROM associations e JOIN en ON en.id = e.source_id OR en.id = e.target_id),
    n AS (SELECT source_id, target_id, count(*) AS n FROM tr GROUP BY ALL) SELECT source_id, target_id, coalesce(activation_count, 0) + coalesce(n, 0) AS activation_count, CASE WHEN n IS NULL THEN last_activated ELSE {AS_OF} END AS last_activated FROM associations LEFT JOIN n USING (source_id, target_id)"""
)
def traversal_activate(t):
    """Edges that the queries' entry points pass on, activated once for each query."""
    entry = t("retrieval_feedback").select("query_id", F.explode("retrieved_memory_ids").alias("id")).distinct()
    e = t("associations")
    ends = [e.join(entry, F.col("id") == F.col(c)).select("query_id", "source_id", "target_id") for c in ("source_id", "target_id")]
    return graph.activate(e, ends[0].unionByName(ends[1]).distinct(), AS_OF).select("source_id", "target_id", "activation_count", "last_activated")


_GB = """g AS (SELECT id, sum((feedback = 'helpful')::INT) AS g, sum((feedback = 'irrelevant')::INT) AS b FROM (SELECT feedback, unnest(retrieved_memory_ids) AS id FROM retrieval_feedback WHERE feedback IN ('helpful', 'irrelevant')) GROUP BY id)"""


def _adjusted(t):
    f = t("retrieval_feedback").select("feedback", F.explode("retrieved_memory_ids").alias("id"))
    return graph.adjust(t("memories"), t("associations"), f.filter("feedback = 'helpful'").select("id"), f.filter("feedback = 'irrelevant'").select("id"))


@query(
    f"""WITH {_GB} SELECT id, round(CASE WHEN coalesce(b, 0) > 0 THEN greatest(0.05, least(1.0, salience + 0.02 * coalesce(g, 0)) - 0.01 * b) ELSE least(1.0, salience + 0.02 * coalesce(g, 0)) END, 9) AS salience FROM memories LEFT JOIN g USING (id)"""
)
def feedback_adjust_memories(t):
    return _adjusted(t)[0].select("id", F.round("salience", 9).alias("salience"))


@query(
    f"""WITH {_GB}, x AS (SELECT source_id, target_id, strength, coalesce(p.g, 0) + coalesce(q.g, 0) AS g, coalesce(p.b, 0) + coalesce(q.b, 0) AS b FROM associations LEFT JOIN g p ON p.id = source_id LEFT JOIN g q ON q.id = target_id),
    y AS (SELECT *, CASE WHEN g > 0 THEN least(1.0, strength * power(1.05, g)) ELSE strength END AS up FROM x)
    SELECT source_id, target_id, round(CASE WHEN b > 0 THEN greatest(0.05, up * power(0.95, b)) ELSE up END, 9) AS strength FROM y"""
)
def feedback_adjust_edges(t):
    return _adjusted(t)[1].select("source_id", "target_id", F.round("strength", 9).alias("strength"))


@query(f"WITH {_USABLE} SELECT count(*) AS n_vectors, min(len(v)) AS dims, count(DISTINCT v) AS n_distinct FROM u WHERE state IN ('active', 'fading')")
def vector_index_stats(t):
    v = _usable(t).filter("state IN ('active', 'fading')")
    return v.agg(F.count(F.lit(1)).alias("n_vectors"), F.min(F.size("v")).cast("long").alias("dims"), F.count_distinct("v").alias("n_distinct"))
