"""Metrics of the retrieval approaches; what a helpful answer returned is what is expected."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnflow.functions import exprs as X
from cairnflow.operators import evaluation as V, graph, retrieval, search
from cairnflow.plans.registry import AS_OF, Registry
from cairnflow.plans.retrieval_queries import _ALL, _BM25, _VEC
from cairnflow.sources.tables import materialize, release, scratch

_R = Registry()
query, QUERIES, SQL = _R.query, _R.QUERIES, _R.SQL

_EXPECTED = "expected AS (SELECT DISTINCT query_id, unnest(retrieved_memory_ids) AS id FROM retrieval_feedback WHERE feedback = 'helpful')"
_METRICS = """e_hits AS (SELECT query_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM (SELECT * FROM {ranked} WHERE rank <= 5) JOIN expected USING (query_id, id) GROUP BY query_id),
  e_n AS (SELECT query_id, count(*) AS n_expected FROM expected GROUP BY query_id),
  e_ideal AS (SELECT k, sum(1 / log2(k2 + 1)) AS v FROM generate_series(1, 5) a(k), generate_series(1, 5) b(k2) WHERE k2 <= k GROUP BY k),
  metrics AS (SELECT query_id, round(coalesce(hits, 0) / 5.0::DOUBLE, 6) AS precision, round(coalesce(hits, 0) / n_expected::DOUBLE, 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr,
    round(coalesce(dcg, 0) / a.v, 6) AS ndcg, round(coalesce(dcg / b.v, 0), 6) AS ndcg_retrieved
    FROM e_n LEFT JOIN e_hits USING (query_id) JOIN e_ideal a ON a.k = least(n_expected, 5) LEFT JOIN e_ideal b ON b.k = hits)"""


def _queries(t):
    return t("retrieval_feedback").select("query_id", "query_text")


def _expected(t):
    return t("retrieval_feedback").filter("feedback = 'helpful'").select("query_id", F.explode("retrieved_memory_ids").alias("id"))


def _scored(t):
    """The queries of which an answer is expected; no other one has a row of metrics, so no other one need be answered.

    They are written, else the optimizer moves what is computed of them below the join."""
    return materialize(_queries(t).join(_expected(t).select("query_id").distinct(), "query_id", "left_semi"), "scored-queries")


@query(f"WITH {_BM25}, r AS (SELECT query_id, doc_id AS id, rank FROM fts), {_EXPECTED}, {_METRICS.format(ranked='r')} SELECT * FROM metrics")
def eval_text(t):
    return V.query_scores(retrieval.candidates(t("memories"), _queries(t))[0], _expected(t))


@query(f"WITH {_VEC}, r AS (SELECT query_id, id, rank FROM vec), {_EXPECTED}, {_METRICS.format(ranked='r')} SELECT * FROM metrics")
def eval_vector(t):
    return V.query_scores(retrieval.candidates(t("memories"), _queries(t))[1], _expected(t))


@query(f"{_ALL}, r AS (SELECT query_id, id, rank FROM ranked WHERE rank <= 7), {_EXPECTED}, {_METRICS.format(ranked='r')} SELECT * FROM metrics")
def eval_full(t):
    known = retrieval.index(t("memories"))  # else the vectors are computed for their count, for the ranges of their parts and for the parts
    out = retrieval.retrieve(known, t("associations"), t("retrieval_feedback"), _scored(t), AS_OF)
    return V.query_scores(out, _expected(t))


@query(
    f"""WITH {_BM25}, {_VEC}, {_EXPECTED}, u AS (SELECT query_id, doc_id AS id, rank FROM fts UNION ALL SELECT query_id, id, rank FROM vec),
    f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f), {_METRICS.format(ranked='r')} SELECT * FROM metrics"""
)
def eval_rrf(t):
    text, vector = retrieval.candidates(t("memories"), _queries(t))
    return V.query_scores(search.reciprocal_rank_fusion([text, vector], ["query_id"]), _expected(t))


_LABELS = "labels AS (SELECT id, CASE WHEN source = 'mcp' THEN 'signal' ELSE 'noise' END AS label FROM memories WHERE source IN ('mcp', 'clipboard', 'git'))"


def _labels(t):
    return t("memories").filter(F.col("source").isin("mcp", "clipboard", "git")).select("id", F.when(F.col("source") == "mcp", "signal").otherwise("noise").alias("label"))


@query(
    f"WITH {_LABELS} SELECT round(avg((state <> 'active')::INT) FILTER (label = 'noise'), 6) AS noise_suppression, round(avg((state IN ('active', 'fading'))::INT) FILTER (label = 'signal'), 6) AS signal_retention FROM labels JOIN memories USING (id)"
)
def noise_signal(t):
    m = V.system_metrics(t("memories"), _labels(t))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


_GRADE = "CASE WHEN value >= {g} THEN 'PASS' WHEN value >= {f} THEN 'WARN' ELSE 'FAIL' END"


@query(
    f"""WITH {_BM25}, r AS (SELECT query_id, doc_id AS id, rank FROM fts), {_EXPECTED}, {_METRICS.format(ranked='r')}, {_LABELS},
    s AS (SELECT avg((state <> 'active')::INT) FILTER (label = 'noise') AS a, avg((state IN ('active', 'fading'))::INT) FILTER (label = 'signal') AS b FROM labels JOIN memories USING (id)),
    v AS (SELECT 'precision' AS metric, avg(precision) AS value, 0.7 AS g, 0.5 AS f FROM metrics UNION ALL SELECT 'mrr', avg(mrr), 0.6, 0.4 FROM metrics UNION ALL SELECT 'noise_suppression', a, 0.6, 0.4 FROM s UNION ALL SELECT 'signal_retention', b, 0.8, 0.6 FROM s)
    SELECT metric, round(value, 6) AS value, CASE WHEN value >= g THEN 'PASS' WHEN value >= f THEN 'WARN' ELSE 'FAIL' END AS grade FROM v"""
)
def grade_summary(t):
    q = V.query_scores(retrieval.candidates(t("memories"), _queries(t))[0], _expected(t))
    means = q.agg(F.avg("precision").alias("precision"), F.avg("mrr").alias("mrr"))
    return V.grade(means.crossJoin(V.system_metrics(t("memories"), _labels(t))))


#: What a sweep varies, one parameter at a time against the defaults.
SWEEP = {"hops": (0, 1), "alpha": (0.4, 0.8), "both_bonus": (0.0,), "decay": (0.5,), "threshold": (0.05,)}


@query()
def parameter_sweep(t):
    """One parameter at a time: each value's metrics less those of the defaults, and their composite.

    What every run reads is built once: the candidates of the queries (which only the limits of the lists change, and
    behind which the index goes), the links and the ratings.  A run merges, spreads and ranks; it leaves five numbers and nothing on disk."""
    system = V.system_metrics(t("memories"), _labels(t))
    asked = materialize(_scored(t).withColumn("n", F.monotonically_increasing_id()), "numbered-queries")  # shorter keys
    want = materialize(_expected(t).distinct().join(asked.select("query_id", "n"), "query_id").select(F.col("n").alias("query_id"), "id"), "expected")
    asked = asked.select(F.col("n").alias("query_id"), "query_text")
    spark, found = asked.sparkSession, {}
    links, rated = graph.links(t("associations")), materialize(retrieval.feedback_scores(t("retrieval_feedback")), "rated")
    names = ["ndcg", "precision", "mrr", *system.columns]

    def candidates(s):
        limits = s.text_limit, s.vector_limit
        if limits not in found:
            with scratch(spark) as kept:
                kept += [materialize(x, "candidates") for x in retrieval.candidates(retrieval.index(t("memories")), asked, s)]
            found[limits] = kept
        return found[limits]

    def means(s):
        text, vector = candidates(s)
        release(spark)
        with scratch(spark):
            r = retrieval.ranked(retrieval.merge_entry_points(text, vector, ["query_id"], s), t("memories"), links, rated, AS_OF, s)
            return tuple(V.query_scores(r, want).agg(*[F.avg(c) for c in names[:3]]).first())

    system = tuple(system.first())
    runs = [(name, float(value), *means(retrieval.Settings(**{name: value})), *system) for name, values in SWEEP.items() for value in values]
    new = spark.createDataFrame(runs, ", ".join(["parameter string, value double", *(f"{c} double" for c in names)]))
    old = dict(zip(names, (*means(retrieval.Settings()), *system)))
    delta = V.composite(new.select("parameter", "value", *[(F.col(c) - F.lit(old[c])).alias(c) for c in names]))
    return delta.select("parameter", "value", *[F.round(c, 6).alias(c) for c in names], F.round("composite", 6).alias("composite"))


@query(
    """WITH l AS (SELECT DISTINCT id AS raw_id, CASE WHEN lower(trim(source)) = 'mcp' THEN 'signal' ELSE 'noise' END AS label FROM raw_memories WHERE lower(trim(source)) IN ('mcp', 'clipboard')),
    n AS (SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM associations UNION ALL SELECT target_id FROM associations WHERE target_id <> source_id) GROUP BY id), j AS (SELECT l.*, m.id, m.state, n.n FROM l LEFT JOIN memories m USING (raw_id) LEFT JOIN n ON n.id = m.id)
    SELECT round(avg(coalesce(state IN ('active', 'fading'), false)::INT) FILTER (label = 'signal'), 6) AS signal_survival, round(avg(coalesce(state IN ('fading', 'archived', 'merged'), true)::INT) FILTER (label = 'noise'), 6) AS noise_suppression,
      round(avg(coalesce(n, 0)) FILTER (label = 'signal' AND id IS NOT NULL), 6) AS edges_per_signal FROM j"""
)
def pipeline_metrics(t):
    """What became of labelled observations (the agent's as signal, the clipboard's as noise)."""
    s = F.lower(F.trim("source"))
    labels = t("raw_memories").filter(s.isin("mcp", "clipboard")).select(F.col("id").alias("raw_id"), F.when(s == "mcp", "signal").otherwise("noise").alias("label")).distinct()
    m = V.pipeline_metrics(labels, t("memories"), t("associations"))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query(
    """WITH r AS (SELECT query_id, id, rank FROM (SELECT query_id, unnest(retrieved_memory_ids) AS id, generate_subscripts(retrieved_memory_ids, 1) AS rank FROM retrieval_feedback) WHERE rank <= 5 AND id IN (SELECT id FROM memories)),
    e AS (SELECT query_id, unnest(list_filter(string_split_regex(lower(query_text), '[^a-z0-9]+'), lambda w: length(w) >= 5)) AS concept FROM retrieval_feedback), n AS (SELECT query_id, count(*) AS n FROM e GROUP BY 1),
    h AS (SELECT DISTINCT r.query_id, r.rank FROM r JOIN (SELECT id, lower(unnest(concepts)) AS concept FROM memories) c USING (id) JOIN e ON e.query_id = r.query_id AND e.concept = c.concept),
    p AS (SELECT r.query_id, count(*) AS k, count(h.rank) AS hits, min(h.rank) AS first, sum(CASE WHEN h.rank IS NOT NULL THEN 1 / log2(r.rank + 1) ELSE 0 END) AS dcg FROM r LEFT JOIN h USING (query_id, rank) GROUP BY 1)
    SELECT query_id, round(hits / k::DOUBLE, 6) AS precision, round(hits / coalesce(n, 1)::DOUBLE, 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr,
      round(CASE WHEN hits > 0 THEN dcg / list_sum(list_transform(generate_series(1, hits), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg FROM p LEFT JOIN n USING (query_id)"""
)
def concept_scores(t):
    """Returned memories held against the concepts that their query names."""
    f = t("retrieval_feedback")
    ranked = f.select("query_id", F.posexplode("retrieved_memory_ids").alias("p", "id")).select("query_id", "id", (F.col("p") + 1).alias("rank")).join(t("memories").select("id"), "id", "left_semi")
    want = f.select("query_id", F.explode(F.filter(X.tokens(F.col("query_text")), lambda w: F.length(w) >= 5)).alias("concept"))
    out = V.concept_scores(ranked, t("memories"), want)
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr", "ndcg")])
