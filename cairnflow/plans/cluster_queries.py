"""Clustering and duplicate rules; folds are tested against a plain loop, they have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnflow.functions import exprs as X
from cairnflow.operators import clusters, graph, store
from cairnflow.plans.registry import Registry

_R = Registry()
query, QUERIES, SQL = _R.query, _R.QUERIES, _R.SQL


def fold_sql(rows: str, absorbs: str, least: int, key: str = "key") -> str:
    """CTEs of the leader fold over ``rows`` (key, id, o: the order, descending): ``led`` (key, id, leader).  ``absorbs`` is a
    condition on the leader ``x`` and a later row ``y``."""
    return f"""rows_ AS ({rows}), num AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o DESC, id) AS k FROM rows_),
    adj AS (SELECT x.key, x.k, x.id, list(y.k ORDER BY y.k) FILTER (y.k IS NOT NULL) AS js FROM num x LEFT JOIN num y ON x.key = y.key AND y.k > x.k AND ({absorbs}) GROUP BY ALL),
    fold AS (SELECT key, k, id, coalesce(js, [])::BIGINT[] || [k] AS used, coalesce(js, [])::BIGINT[] || [k] AS got FROM adj WHERE k = 1
      UNION ALL SELECT a.key, a.k, a.id, CASE WHEN list_contains(f.used, a.k) THEN f.used ELSE f.used || list_filter(coalesce(a.js, [])::BIGINT[] || [a.k], lambda j: NOT list_contains(f.used, j)) END,
        CASE WHEN list_contains(f.used, a.k) THEN NULL ELSE list_filter(coalesce(a.js, [])::BIGINT[] || [a.k], lambda j: NOT list_contains(f.used, j)) END FROM fold f JOIN adj a ON a.key = f.key AND a.k = f.k + 1),
    led AS (SELECT m.key, m.id, g.id AS leader FROM (SELECT key, id, unnest(got) AS k FROM fold WHERE len(got) >= {least}) g JOIN num m ON m.key = g.key AND m.k = g.k)"""


_OKV = "{e} IS NOT NULL AND len({e}) > 0 AND len(list_filter({e}, lambda q: q IS NULL OR isnan(q) OR isinf(q))) = 0 AND len(list_filter({e}, lambda q: q <> 0)) > 0"
_VEC = f"CASE WHEN {_OKV.format(e='embedding')} THEN list_transform(embedding, lambda q: q::DOUBLE) END AS v"
_LOWC = "list_filter(list_transform(coalesce(concepts, []), lambda q: lower(q)), lambda q: q IS NOT NULL) AS c"
_COS = "coalesce(CASE WHEN x.v IS NOT NULL AND y.v IS NOT NULL AND len(x.v) = len(y.v) THEN list_cosine_similarity(x.v, y.v) END, 0)"
_SHARED = "len(list_filter(y.c, lambda q: list_contains(x.c, q)))"
_ROWS = f"SELECT coalesce(project, '') AS key, id, created_at AS o, {_VEC}, {_LOWC} FROM memories WHERE state = 'active'"


def _active(t):
    m = t("memories").filter("state = 'active'")
    return m.select("id", F.coalesce("project", F.lit("")).alias("project"), "concepts", F.col("embedding").alias("v"), "created_at")


@query(f"WITH RECURSIVE {fold_sql(_ROWS, f'{_COS} >= 0.85', 3)} SELECT key AS project, id, leader FROM led")
def leader_clusters(t):
    return clusters.by_vector(_active(t), ["project"])


@query(f"WITH RECURSIVE {fold_sql(_ROWS, f'{_SHARED} >= 2 OR ({_SHARED} = 1 AND {_COS} >= 0.6)', 3)} SELECT key AS project, id, leader FROM led")
def concept_clusters(t):
    return clusters.by_concepts(_active(t), ["project"])


@query()
def temporal_clusters(t):
    return clusters.by_time(_active(t), ["project"])


@query(
    f"""WITH RECURSIVE {fold_sql(_ROWS.replace("coalesce(project, '') AS key", "1 AS key, coalesce(project, '') AS project"), f'{_SHARED} >= 2 OR ({_SHARED} = 1 AND {_COS} >= 0.6)', 3)}
    SELECT leader, count(DISTINCT project) AS n_projects, count(*) AS n FROM led JOIN rows_ USING (id) GROUP BY leader HAVING count(DISTINCT project) >= 2"""
)
def cross_project_clusters(t):
    """Concept clusters over all projects that span at least two of them."""
    m = _active(t).withColumn("scope", F.lit("all"))
    found = clusters.by_concepts(m, ["scope"]).join(m.select("id", "project"), "id")
    wide = found.groupBy("leader").agg(F.count_distinct("project").alias("n_projects"), F.count(F.lit(1)).alias("n"))
    return wide.filter("n_projects >= 2")


_T = "list_distinct(list_filter(string_split_regex(lower({x}), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> ''))"


@query(
    f"""WITH held AS (SELECT DISTINCT id, c FROM (SELECT id, lower(unnest(concepts)) AS c FROM memories)), pairs AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM held x JOIN held y ON x.c = y.c AND x.id < y.id GROUP BY ALL HAVING count(*) >= 3),
    s AS (SELECT id, {_T.format(x="coalesce(summary, '')")} AS w, list_transform(embedding, lambda x: x::DOUBLE) AS v,
      embedding IS NOT NULL AND len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok, len(list_filter(string_split_regex(coalesce(summary, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')) AS n FROM memories),
    j AS (SELECT a, b, CASE WHEN len(list_distinct(x.w || y.w)) = 0 THEN 1.0 ELSE len(list_intersect(x.w, y.w)) / len(list_distinct(x.w || y.w))::DOUBLE END >= 0.3 AS words, coalesce(CASE WHEN x.ok AND y.ok THEN list_cosine_similarity(x.v, y.v) ELSE 0 END, 0) >= 0.75 AS near, x.n <= 4 OR y.n <= 4 AS short
      FROM pairs JOIN s x ON x.id = a JOIN s y ON y.id = b)
    SELECT a, b FROM j WHERE CASE WHEN short THEN words AND near ELSE words OR near END"""
)
def near_dup_title_or_vec(t):
    """Pairs of memories that share three concepts and are near-duplicates by title and vector."""
    m = t("memories").select("id", "concepts", F.col("summary").alias("title"), F.col("embedding").alias("v"))
    return clusters.near_duplicates(m, 3, 0.3, 0.75, 128)


@query("SELECT h AS hash, count(*) AS n, min(id) AS first_id FROM (SELECT DISTINCT id, left(sha256(coalesce(type, '') || chr(0) || coalesce(content, '')), 32) AS h FROM raw_memories) GROUP BY h HAVING count(*) > 1".replace("chr(0)", "chr(1)"))
def exact_hash_dedup(t):
    """Groups of observations with the same type and content."""
    h = F.left(F.sha2(F.concat(F.coalesce("type", F.lit("")), F.lit("\x01"), F.coalesce("content", F.lit(""))), 256), F.lit(32))
    r = t("raw_memories").select("id", h.alias("hash")).distinct()
    return r.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).filter("n > 1")


@query(
    """WITH held AS (SELECT DISTINCT id, c FROM (SELECT id, lower(unnest(concepts)) AS c FROM memories)), n AS (SELECT id, count(*) AS k FROM held GROUP BY id HAVING count(*) >= 3),
    pairs AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM held x JOIN held y ON x.c = y.c AND x.id < y.id GROUP BY ALL)
    SELECT a, b, shared FROM pairs JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE shared >= 0.5 * greatest(x.k, y.k)"""
)
def tier2_concept_dedup(t):
    """Pairs of memories whose concepts overlap by at least half of the longer list."""
    m = t("memories").filter(F.size(X.folded_set(F.col("concepts"))) >= 3)
    return graph.shared_concept_pairs(m, 1, 0.5)


@query(
    """WITH obs AS (SELECT id, type, content, project, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST) AS n FROM raw_memories) WHERE n = 1),
    h AS (SELECT id, left(sha256(coalesce(content, '')), 32) AS h, timestamp FROM obs), one AS (SELECT id, coalesce(timestamp - lag(timestamp) OVER (PARTITION BY h ORDER BY timestamp, id) <= INTERVAL 24 HOUR, false) AS hash_dup FROM h),
    m AS (SELECT r.raw_id, r.id, list_distinct(list_filter(list_transform(r.concepts, lambda q: lower(q)), lambda q: q IS NOT NULL)) AS c, r.type, coalesce(r.project, '') AS project, r.created_at,
      CASE WHEN r.embedding IS NOT NULL AND len(r.embedding) = 128 AND len(list_filter(r.embedding, lambda q: q IS NULL OR isnan(q) OR isinf(q))) = 0 AND len(list_filter(r.embedding, lambda q: q <> 0)) > 0 THEN list_transform(r.embedding, lambda q: q::DOUBLE) END AS v FROM memories r),
    n AS (SELECT a.*, (SELECT min(b.id) FROM m b WHERE len(a.c) >= 3 AND len(b.c) >= 3 AND (b.created_at, b.id) < (a.created_at, a.id) AND len(list_intersect(a.c, b.c)) >= 0.8 * greatest(len(a.c), len(b.c))) AS by_concepts FROM m a),
    k AS (SELECT n.*, (SELECT min(b.id) FROM m b WHERE (b.created_at, b.id) < (n.created_at, n.id) AND b.type = n.type AND b.project = n.project AND round(list_cosine_similarity(n.v, b.v), 9) >= 0.95) AS by_vector FROM n)
    SELECT k.id, CASE WHEN coalesce(hash_dup, false) THEN 'hash' WHEN by_concepts IS NOT NULL THEN 'concepts' WHEN by_vector IS NOT NULL THEN 'vector' ELSE 'new' END AS outcome FROM k LEFT JOIN one ON one.id = k.raw_id"""
)
def three_tier_dedup(t):
    """What each memory would be on arrival: a repeated observation, a repeat by concepts or by vector of an older memory, or new."""
    return clusters.three_tiers(store.latest_delivery(t("raw_memories")), t("memories"))
