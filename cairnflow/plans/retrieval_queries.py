"""Search and retrieval over memories, for every query of the feedback log."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnflow.functions import exprs as X, word_lists as W
from cairnflow.functions.temporal import time_range
from cairnflow.operators import graph, retrieval, search
from cairnflow.plans.registry import AS_OF, Registry

_R = Registry()
query, QUERIES, SQL = _R.query, _R.QUERIES, _R.SQL

_STOP = ", ".join(f"'{w}'" for w in W.QUERY_STOP_WORDS)
_FIELDS = r"list_filter(string_split_regex({x}, '[ \t\n\r\f\x0B]+'), lambda w: w <> '')"
_QTERMS = f"""list_filter(list_transform({_FIELDS.format(x="coalesce(query_text, '')")},
  lambda w: lower(regexp_replace(w, '[^A-Za-z0-9]', '', 'g'))), lambda w: length(w) >= 2 AND w NOT IN ({_STOP}))"""
_TEXT = "concat_ws(' ', summary, content, array_to_string(concepts, ' '))"
_TOKENS = "list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')"

_BM25 = f"""
docs AS (SELECT id AS doc_id, salience, project, {_TOKENS.format(x=_TEXT)} AS w FROM memories),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM docs) GROUP BY ALL),
len AS (SELECT doc_id, len(w) AS length FROM docs WHERE len(w) > 0),
corpus AS (SELECT count(*) AS n_docs, avg(length) AS avg_length FROM len),
qt AS (SELECT query_id, unnest(list_distinct({_QTERMS})) AS prefix FROM retrieval_feedback),
hits AS (SELECT prefix, doc_id, sum(tf) AS tf FROM (SELECT DISTINCT prefix FROM qt) p JOIN post ON starts_with(term, prefix)
         GROUP BY ALL),
df AS (SELECT prefix, count(*) AS n FROM hits GROUP BY ALL),
bm AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - n + 0.5) / (n + 0.5)) * tf * 2.2 /
              (tf + 1.2 * (0.25 + 0.75 * length / avg_length))), 9) AS score
       FROM hits JOIN df USING (prefix) JOIN len USING (doc_id) JOIN qt USING (prefix), corpus GROUP BY ALL),
fts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm)
        WHERE rank <= 10)"""

_EMBED = """{name} AS (
  WITH tok AS (SELECT {id} AS id, unnest({tokens}) AS tok FROM {table}),
  dims AS (SELECT id, ('0x' || substr(md5(tok), 1, 8))::UBIGINT % 128 AS d, count(*)::DOUBLE AS c FROM tok GROUP BY ALL)
  SELECT id, d, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS x FROM dims)"""
_VEC = (
    _EMBED.format(name="mv", id="id", tokens=_TOKENS.format(x=_TEXT), table="(SELECT * FROM memories WHERE state IN ('active', 'fading'))")
    + ",\n"
    + _EMBED.format(name="qv", id="query_id", tokens=_TOKENS.format(x="coalesce(query_text, '')"), table="retrieval_feedback")
    + """,
sims AS (SELECT q.id AS query_id, m.id AS id, round(sum(q.x * m.x), 9) AS score FROM qv q JOIN mv m USING (d) GROUP BY ALL),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sims)
        WHERE rank <= 10)"""
)
_ENTRY = """
txt AS (SELECT query_id, doc_id AS id, 0.7 / rank + 0.3 * CASE WHEN salience <= 0 THEN 0.5 ELSE coalesce(salience, 0.5) END AS t
        FROM fts JOIN (SELECT id AS doc_id, salience FROM memories) USING (doc_id)),
entry AS (SELECT query_id, id, coalesce(0.6 * v + 0.4 * t + 0.15, v, t) AS activation
          FROM txt FULL JOIN (SELECT query_id, id, score AS v FROM vec) USING (query_id, id))"""
_TW = "CASE relation_type WHEN 'caused_by' THEN 1.2 WHEN 'part_of' THEN 1.15 WHEN 'reinforces' THEN 1.1 WHEN 'temporal' THEN 1.1 WHEN 'contradicts' THEN 0.8 ELSE 1.0 END"


def _spread_sql(hops: int, threshold: float) -> str:
    parts = [
        f"""links AS (SELECT source_id AS node, target_id AS other, strength, coalesce(activation_count, 0) AS c, ({_TW})::DOUBLE AS w FROM associations
        UNION ALL SELECT target_id, source_id, strength, coalesce(activation_count, 0), ({_TW})::DOUBLE FROM associations)""",
        "s0 AS (SELECT query_id, id, activation::DOUBLE AS activation, 0::BIGINT AS activation_count, NULL::INT AS hop, true AS fresh FROM entry)",
    ]
    for h in range(hops):
        parts.append(
            f"""o{h} AS (SELECT query_id, other AS id, arg_max(c, (p, c)) AS c, max(p) AS p FROM (
          SELECT query_id, other, c, round(activation * strength * {0.7 ** (h + 1)!r} * w, 12) AS p FROM s{h} JOIN links ON id = node WHERE fresh)
          WHERE p > {threshold} GROUP BY ALL),
        s{h + 1} AS (SELECT query_id, id, CASE WHEN p > coalesce(activation, -1) THEN p ELSE activation END AS activation,
          CASE WHEN p > coalesce(activation, -1) THEN c ELSE activation_count END AS activation_count,
          CASE WHEN p > coalesce(activation, -1) THEN {h} ELSE hop END AS hop, coalesce(p > coalesce(activation, -1), false) AS fresh
          FROM s{h} FULL JOIN o{h} USING (query_id, id))"""
        )
    return ",\n".join(parts)


_FEEDBACK = """fb AS (SELECT id, avg(x) AS feedback_mean, count(*) AS n_rated FROM (
  SELECT unnest(retrieved_memory_ids) AS id, CASE feedback WHEN 'helpful' THEN 1.0 WHEN 'partial' THEN 0.0 ELSE -1.0 END AS x
  FROM retrieval_feedback WHERE feedback IN ('helpful', 'partial', 'irrelevant')) GROUP BY ALL)"""
_RANKED = """scored AS (
  SELECT query_id, s.id, m.project, m.state, m.recall_suppressed, round(s.activation, 9) AS activation, round(
    s.activation * (1 + 0.2 * exp(-greatest(date_sub('second', coalesce(last_accessed, created_at), {AS_OF}) / 86400.0, 0.0) / 30)
      + least(0.2, 0.02 * ln(1 + coalesce(s.activation_count, 0))))
    * CASE type WHEN 'decision' THEN 1.3 WHEN 'error' THEN 1.25 WHEN 'insight' THEN 1.2 WHEN 'learning' THEN 1.15 ELSE 1.0 END
    * CASE source WHEN 'mcp' THEN 1.5 WHEN 'terminal' THEN 0.8 WHEN 'clipboard' THEN 0.6 WHEN 'filesystem' THEN 0.5 ELSE 1.0 END
    + 0.15 * coalesce(feedback_mean, 0), 9) AS score
  FROM s3 s JOIN memories m ON m.id = s.id LEFT JOIN fb ON fb.id = s.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored
           WHERE NOT coalesce(recall_suppressed, false))"""
_ALL = f"WITH {_BM25}, {_VEC}, {_ENTRY}, {_spread_sql(3, 0.1)}, {_FEEDBACK}, {_RANKED}"


def _queries(t):
    return t("retrieval_feedback").select("query_id", "query_text")


@query(f"SELECT query_id, array_to_string(list_transform({_QTERMS}, lambda w: w || '*'), ' OR ') AS match FROM retrieval_feedback")
def fts_terms(t):
    return _queries(t).select("query_id", X.match_expression(F.col("query_text")).alias("match"))


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM fts")
def fts_bm25_topk(t):
    m = t("memories")
    return search.bm25(m, "id", retrieval.memory_text(m), _queries(t), "query_id", F.col("query_text"))


@query(
    f"""WITH {_BM25} SELECT query_id, project, doc_id, score, rank FROM (SELECT query_id, coalesce(project, '') AS project, doc_id, score,
    row_number() OVER (PARTITION BY query_id, coalesce(project, '') ORDER BY score DESC, doc_id) AS rank FROM bm JOIN docs USING (doc_id)) WHERE rank <= 3"""
)
def fts_project_topk(t):
    m = t("memories")
    of = m.select(F.col("id").alias("doc_id"), F.coalesce("project", F.lit("")).alias("g"))
    found = search.bm25(m, "id", retrieval.memory_text(m), _queries(t), "query_id", F.col("query_text"), 3, of)
    return found.select("query_id", F.col("g").alias("project"), "doc_id", "score", "rank")


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
    SELECT query_id, id, score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.v, e.v), 9) AS score,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, e.v), 9) DESC, e.vec_id) AS rank
      FROM e q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 10"""
)
def vector_topk(t):
    """The ten nearest of all vectors for every vector whose id is divisible by 100."""
    e = t("embeddings")
    return search.vector_top_k(e, "vec_id", "embedding", e.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10, exclude_self=True)


@query(
    """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
    SELECT query_id, id, score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.v, e.v), 9) AS score,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, e.v), 9) DESC, e.vec_id) AS rank
      FROM e q JOIN e ON e.vec_id <> q.vec_id AND e.label = q.label WHERE q.vec_id % 100 = 0) WHERE rank <= 5"""
)
def vector_topk_by_label(t):
    """The five nearest vectors of the same label."""
    e = t("embeddings")
    asked = e.filter("vec_id % 100 = 0")
    return search.vector_top_k(e, "vec_id", "embedding", asked, "vec_id", "embedding", 5, exclude_self=True, group="label")


@query(f"WITH {_VEC} SELECT query_id, id, score, rank FROM vec")
def query_vector_topk(t):
    """The ten nearest living memories of each query text, by the deterministic embedding."""
    return retrieval.candidates(t("memories"), _queries(t))[1]


@query(f"WITH {_BM25}, {_VEC}, {_ENTRY} SELECT query_id, id, round(activation, 6) AS activation FROM entry")
def merge_entry_points(t):
    text, vector = retrieval.candidates(t("memories"), _queries(t))
    return retrieval.merge_entry_points(text, vector, ["query_id"]).withColumn("activation", F.round("activation", 6))


@query(
    f"""WITH {_BM25}, {_VEC}, u AS (SELECT query_id, doc_id AS id, rank FROM fts UNION ALL SELECT query_id, id, rank FROM vec),
    f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 5"""
)
def rrf_fusion(t):
    text, vector = retrieval.candidates(t("memories"), _queries(t))
    return search.reciprocal_rank_fusion([text, vector], ["query_id"], 60, 5)


def _entries(t):
    """Every rated query activates the memories that it returned, by rank."""
    return t("retrieval_feedback").select("query_id", F.posexplode("retrieved_memory_ids").alias("pos", "id")).groupBy("query_id", "id").agg(
        (1.0 / (1 + F.min("pos"))).alias("activation")
    )


_ENTRY_FB = """entry AS (SELECT query_id, id, 1.0 / (1 + min(pos)) AS activation FROM (
  SELECT query_id, unnest(retrieved_memory_ids) AS id, generate_subscripts(retrieved_memory_ids, 1) - 1 AS pos FROM retrieval_feedback) GROUP BY ALL)"""


def _spread(t, hops, threshold):
    out = graph.spread_activation(_entries(t), t("associations"), ["query_id"], hops, 0.7, threshold)
    return out.withColumns({"activation": F.round("activation", 10), "hop": F.coalesce("hop", F.lit(-1))})


@query(f"WITH {_ENTRY_FB}, {_spread_sql(1, 0.1)} SELECT query_id, id, round(activation, 10) AS activation, activation_count, coalesce(hop, -1) AS hop FROM s1")
def spread_1hop(t):
    return _spread(t, 1, 0.1)


@query(f"WITH {_ENTRY_FB}, {_spread_sql(2, 0.01)} SELECT query_id, id, round(activation, 10) AS activation, activation_count, coalesce(hop, -1) AS hop FROM s2")
def spread_2hop(t):
    return _spread(t, 2, 0.01)


@query(f"WITH {_ENTRY_FB}, {_spread_sql(3, 0.01)} SELECT query_id, id, round(activation, 10) AS activation, activation_count, coalesce(hop, -1) AS hop FROM s3")
def spread_3hop(t):
    return _spread(t, 3, 0.01)


@query(f"WITH {_FEEDBACK} SELECT id, round(feedback_mean, 6) AS feedback_mean, n_rated FROM fb")
def feedback_scores(t):
    return retrieval.feedback_scores(t("retrieval_feedback")).withColumn("feedback_mean", F.round("feedback_mean", 6))


@query(f"{_ALL} SELECT query_id, id, round(score, 6) AS score, round(activation, 6) AS activation, rank FROM ranked WHERE rank <= 7")
def retrieval_full(t):
    """The whole pipeline for every query of the log."""
    out = retrieval.retrieve(t("memories"), t("associations"), t("retrieval_feedback"), _queries(t), AS_OF)
    return out.withColumns({"score": F.round("score", 6), "activation": F.round("activation", 6)})


@query(
    f"""{_ALL} SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT query_id, id, score, row_number() OVER
    (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ranked WHERE state = 'active' AND project = 'tidepool') WHERE rank <= 7"""
)
def retrieval_filtered(t):
    """The pipeline with a project and a state, both applied before the cut."""
    out = retrieval.retrieve(
        t("memories"), t("associations"), t("retrieval_feedback"), _queries(t), AS_OF, project="tidepool", state="active"
    )
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query()
def mmr_diversity(t):
    """Diversity re-ranking of the fused lists, with the memories' own vectors."""
    return retrieval.retrieve(t("memories"), t("associations"), t("retrieval_feedback"), _queries(t), AS_OF, diverse=True)


_RANGED = """rg AS (SELECT query_id, created_at - INTERVAL 3 DAY AS since, created_at AS until FROM retrieval_feedback),
  inr AS (SELECT query_id, id, 0.3 + 0.2 * coalesce(salience, 0) AS activation, row_number() OVER (PARTITION BY query_id ORDER BY timestamp DESC, id) AS rank FROM rg JOIN memories ON timestamp BETWEEN since AND until QUALIFY rank <= 7)"""


def _ranges(t):
    """The three days before each query."""
    return t("retrieval_feedback").select("query_id", F.expr("created_at - INTERVAL 3 DAYS").alias("since"), F.col("created_at").alias("until"))


@query(f"WITH {_RANGED} SELECT query_id, id, round(activation, 9) AS activation, rank FROM inr")
def time_range_entries(t):
    return retrieval.in_range(t("memories"), _ranges(t)).withColumn("activation", F.round("activation", 9))


@query(
    f"""WITH {_RANGED}, e AS (SELECT query_id, id, 1.0 / (1 + min(pos)) AS activation FROM (SELECT query_id, unnest(retrieved_memory_ids) AS id, generate_subscripts(retrieved_memory_ids, 1) - 1 AS pos FROM retrieval_feedback) GROUP BY ALL)
    SELECT query_id, id, round(activation, 9) AS activation FROM e UNION ALL SELECT query_id, id, round(activation, 9) FROM inr ANTI JOIN e USING (query_id, id)"""
)
def time_injection(t):
    """Entry points joined by the newest memories of the query's time range."""
    return retrieval.inject(_entries(t), retrieval.in_range(t("memories"), _ranges(t))).withColumn("activation", F.round("activation", 9))


@query(
    f"""{_ALL}, totals AS (SELECT count(*) AS n_results, count(DISTINCT query_id) AS n_answered FROM ranked WHERE rank <= 7)
    SELECT (SELECT count(*) FROM retrieval_feedback) AS n_queries, n_answered, n_results, round(n_results::DOUBLE / n_answered, 6) AS per_query FROM totals"""
)
def retrieval_stats(t):
    out = retrieval.retrieve(t("memories"), t("associations"), t("retrieval_feedback"), _queries(t), AS_OF)
    n = t("retrieval_feedback").agg(F.count(F.lit(1)).alias("n_queries"))
    totals = out.agg(F.count_distinct("query_id").alias("n_answered"), F.count(F.lit(1)).alias("n_results"))
    return n.crossJoin(totals).withColumn("per_query", F.round(F.col("n_results") / F.col("n_answered"), 6))


_QC = f"""list_filter(list_transform({_FIELDS.format(x="lower(query_text)")}, lambda w: regexp_replace(w, '^[.,!?;:"'']+|[.,!?;:"'']+$', '', 'g')),
  lambda w: length(w) > 2 AND w NOT IN ({_STOP}, 'being'))"""


@query(f"SELECT query_id, array_to_string({_QC}, '|') AS concepts FROM retrieval_feedback")
def query_concepts(t):
    return _queries(t).select("query_id", F.array_join(X.query_concepts(F.col("query_text")), "|").alias("concepts"))


@query(
    f"""WITH q AS (SELECT query_id, unnest(list_distinct(list_transform({_QC}, lambda w: lower(split_part(split_part(w, '_', 1), '-', 1))))) AS c
    FROM retrieval_feedback), m AS (SELECT id, salience, unnest(list_distinct(list_transform(concepts, lambda x: lower(x)))) AS c FROM memories),
    words AS (SELECT DISTINCT id, salience, unnest(string_split_regex(c, '[ _-]+')) AS c FROM m),
    h AS (SELECT query_id, id, max(salience) AS salience, count(*) AS hits FROM q JOIN words USING (c) GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY salience DESC, id) AS rank FROM h) WHERE rank <= 10"""
)
def concept_search(t):
    """Memories that share a concept word with the query, by salience."""
    q = _queries(t).withColumn(
        "qc", F.transform(X.query_concepts(F.col("query_text")), lambda w: F.split_part(F.split_part(w, F.lit("_"), F.lit(1)), F.lit("-"), F.lit(1)))
    )
    words = F.flatten(F.transform(X.folded_set(F.col("concepts")), lambda x: F.split(x, "[ _-]+")))
    m = t("memories").select("id", "salience", words.alias("concepts"))
    return search.concept_search(m, q, "query_id", "qc", 10)


@query(
    """SELECT id, project, salience, rank FROM (SELECT id, project, salience, row_number() OVER (PARTITION BY project ORDER BY salience DESC, id) AS rank
    FROM memories WHERE (lower(to_json(concepts)::VARCHAR) LIKE '%broker%' OR lower(to_json(concepts)::VARCHAR) LIKE '%scanner%') AND state IN ('active', 'fading') AND project <> '') WHERE rank <= 20"""
)
def concept_like_search_project(t):
    m = t("memories").filter("project <> ''")
    hits = search.text_contains_search(m, F.col("concepts"), ["broker", "scanner"], F.col("state").isin("active", "fading"))
    return search.top_k(hits.select("id", "project", "salience"), ["project"], [F.desc("salience"), F.col("id")], 20)


@query(
    r"""WITH ents AS (SELECT id, salience, unnest(list_distinct(regexp_extract_all(content, '[a-z]+_[a-z]+(?:_[a-z0-9]+)?'))) AS name FROM memories)
    SELECT name, count(*) AS n_memories, max(salience) AS top_salience FROM ents WHERE contains(name, 'broker') GROUP BY name"""
)
def entity_search(t):
    """Memories by the entities named in their content."""
    ents = t("memories").select(
        "id", "salience", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("([a-z]+_[a-z]+(?:_[a-z0-9]+)?)")))).alias("name")
    )
    return ents.filter(F.col("name").contains("broker")).groupBy("name").agg(
        F.count(F.lit(1)).alias("n_memories"), F.max("salience").alias("top_salience")
    )


_KW = ", ".join(f"'{w}'" for w in W.KEYWORD_STOP_WORDS)


@query(
    rf"""WITH w AS (SELECT id, generate_subscripts(ks, 1) AS p, unnest(ks) AS k FROM (SELECT id, list_filter({_FIELDS.format(x="lower(content)")}, lambda w: length(w) >= 3 AND w NOT IN ({_KW})) AS ks FROM memories)),
    f AS (SELECT id, k, min(p) AS p FROM w GROUP BY ALL), n AS (SELECT id, k, row_number() OVER (PARTITION BY id ORDER BY p) AS r FROM f), o AS (SELECT id, string_agg(k, ' ' ORDER BY r) AS keywords FROM n WHERE r <= 10 GROUP BY id)
    SELECT m.id, CASE WHEN content IS NULL THEN NULL ELSE coalesce(keywords, '') END AS keywords FROM memories m LEFT JOIN o USING (id)"""
)
def keyword_extract(t):
    """The first ten keywords of each memory, in order."""
    return t("memories").select("id", F.array_join(X.keywords(F.col("content")), " ").alias("keywords"))


@query(
    rf"""WITH w AS (SELECT id, unnest(list_distinct(list_filter({_FIELDS.format(x="lower(content)")}, lambda w: length(w) >= 3 AND w NOT IN ({_KW})))) AS k FROM memories)
    SELECT k AS keyword, count(*) AS n_memories FROM w GROUP BY k"""
)
def keyword_counts(t):
    words = F.array_distinct(
        F.filter(X.fields(F.lower("content")), lambda x: (F.length(x) >= 3) & ~F.array_contains(X.lit_array(W.KEYWORD_STOP_WORDS), x))
    )
    return t("memories").select(F.explode(words).alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("n_memories"))


_PHRASES = ["last 12 hours", "what changed yesterday", "past 2 weeks", "today", "this week", "this month", "last month", "recently", "how does it work"]
_CASES = " ".join(f"WHEN {i} THEN ' {p}'" for i, p in enumerate(_PHRASES))


@query(
    f"""WITH q AS (SELECT query_id, query_text || CASE length(query_text) % {len(_PHRASES)} {_CASES} END AS x FROM retrieval_feedback),
    p AS (SELECT query_id, x, CAST(regexp_extract(x, '(?i)\\b(?:last|past)\\s+(\\d+)\\s+(minute|hour|day|week|month)s?\\b', 1) AS VARCHAR) AS n,
      lower(regexp_extract(x, '(?i)\\b(?:last|past)\\s+(\\d+)\\s+(minute|hour|day|week|month)s?\\b', 2)) AS u,
      lower(regexp_extract(x, '(?i)\\b(?:last|past)\\s+(hour|day|week|month)\\b', 1)) AS one FROM q),
    r AS (SELECT query_id, CASE
      WHEN n <> '' THEN {{AS_OF}} - to_seconds(try_cast(n AS INT) * CASE u WHEN 'minute' THEN 60 WHEN 'hour' THEN 3600 WHEN 'day' THEN 86400 WHEN 'week' THEN 604800 ELSE 2592000 END)
      WHEN one <> '' THEN {{AS_OF}} - to_seconds(CASE one WHEN 'hour' THEN 3600 WHEN 'day' THEN 86400 WHEN 'week' THEN 604800 ELSE 2592000 END)
      WHEN regexp_matches(x, '(?i)\\btoday\\b') THEN date_trunc('day', {{AS_OF}}) WHEN regexp_matches(x, '(?i)\\byesterday\\b') THEN date_trunc('day', {{AS_OF}}) - INTERVAL 1 DAY
      WHEN regexp_matches(x, '(?i)\\bthis\\s+week\\b') THEN date_trunc('week', {{AS_OF}}) WHEN regexp_matches(x, '(?i)\\bthis\\s+month\\b') THEN date_trunc('month', {{AS_OF}})
      WHEN regexp_matches(x, '(?i)\\brecent(?:ly)?\\b') THEN {{AS_OF}} - INTERVAL 24 HOUR END AS range_from FROM p)
    SELECT query_id, CAST(range_from AS TIMESTAMP) AS range_from, range_from IS NOT NULL AS detected FROM r"""
)
def temporal_intent(t):
    """Time ranges of the logged queries, each with an expression of time appended."""
    phrase = F.get(X.lit_array([" " + p for p in _PHRASES]), F.length("query_text") % len(_PHRASES))
    q = _queries(t).withColumn("x", F.concat("query_text", phrase))
    return time_range(q, "x", F.lit(AS_OF).cast("timestamp_ntz")).select("query_id", "range_from", "detected")


@query(
    f"""WITH {_FEEDBACK}, pat AS (SELECT project, list(id) AS ids, avg(salience) AS strength FROM memories WHERE type = 'insight' AND project <> '' GROUP BY project HAVING count(*) >= 2),
    boost AS (SELECT unnest(ids) AS id, 0.1 * strength AS b FROM pat)
    SELECT id, round(coalesce(feedback_mean, 0) + coalesce(sum(b), 0), 6) AS score FROM memories LEFT JOIN fb USING (id) LEFT JOIN boost USING (id) GROUP BY id, feedback_mean"""
)
def evidence_boost(t):
    """A memory gains a tenth of the strength of every pattern that lists it as evidence."""
    m = t("memories")
    patterns = m.filter("type = 'insight' AND project <> ''").groupBy("project").agg(
        F.collect_list("id").alias("ids"), F.avg("salience").alias("strength"), F.count(F.lit(1)).alias("n")
    ).filter("n >= 2")
    boost = patterns.select(F.explode("ids").alias("id"), (0.1 * F.col("strength")).alias("b")).groupBy("id").agg(F.sum("b").alias("b"))
    fb = retrieval.feedback_scores(t("retrieval_feedback"))
    score = F.coalesce("feedback_mean", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))
    return m.select("id").join(fb, "id", "left").join(boost, "id", "left").select("id", F.round(score, 6).alias("score"))


@query(
    """WITH last AS (SELECT lower(c) AS c, max(timestamp) AS seen FROM (SELECT unnest(concepts) AS c, timestamp FROM memories WHERE source IN ('mcp', 'terminal')) GROUP BY ALL),
    m AS (SELECT id, timestamp AS t0, unnest(list_distinct(list_transform(concepts, lambda x: lower(x)))) AS c, len(list_distinct(list_transform(concepts, lambda x: lower(x)))) AS n FROM memories WHERE len(concepts) > 0)
    SELECT id, round(least(0.2, sum(CASE WHEN date_diff('second', seen, t0) BETWEEN 0 AND 1799 THEN 1 - date_diff('second', seen, t0) / 1800.0 ELSE 0 END) / max(n)), 6) AS context_boost
    FROM m LEFT JOIN last USING (c) GROUP BY id"""
)
def context_boost(t):
    """How recently the concepts of a memory were active when it was made, fading over 30 minutes."""
    m = t("memories")
    last = m.filter(F.col("source").isin("mcp", "terminal")).select(F.explode("concepts").alias("c"), "timestamp").groupBy(F.lower("c").alias("c")).agg(F.max("timestamp").alias("seen"))
    held = m.filter(F.size("concepts") > 0).select("id", F.col("timestamp").alias("at"), X.folded_set(F.col("concepts")).alias("cs"))
    each = held.select("id", "at", F.size("cs").alias("n"), F.explode("cs").alias("c")).join(last, "c", "left")
    gap = F.expr("unix_seconds(cast(at as timestamp)) - unix_seconds(cast(seen as timestamp))")
    part = F.when((gap >= 0) & (gap < 1800), 1 - gap / 1800.0).otherwise(0.0)
    return each.groupBy("id").agg(F.round(F.least(F.lit(0.2), F.sum(part) / F.max("n")), 6).alias("context_boost"))


@query(
    """WITH r AS (SELECT DISTINCT project, source, id, timestamp, content FROM raw_memories WHERE lower(trim(source)) <> 'mcp' AND project <> ''),
    w AS (SELECT DISTINCT project, id, unnest(list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda w: length(w) >= 4)) AS c FROM r),
    k0 AS (SELECT project, c, count(*) AS n FROM w GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, c) AS rank FROM k0),
    top AS (SELECT project, c FROM k WHERE rank <= 40),
    m AS (SELECT DISTINCT id, project, salience, unnest(list_filter(string_split_regex(lower(array_to_string(concepts, ' ')), '[^a-z0-9]+'), lambda w: length(w) >= 4)) AS c FROM memories WHERE state IN ('active', 'fading') AND NOT recall_suppressed),
    h AS (SELECT m.id, m.project, m.salience, count(*) AS matches FROM m JOIN top ON top.project = m.project AND top.c = m.c GROUP BY ALL HAVING count(*) >= 2)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY salience DESC, id) AS rank FROM h) WHERE rank <= 5"""
)
def proactive_context(t):
    """Memories that fit what a project is busy with: at least two of its leading words among their concepts."""
    raw = t("raw_memories").filter("lower(trim(source)) <> 'mcp' AND project <> ''").select("project", "id", "content").distinct()
    words = lambda c: F.array_distinct(F.filter(X.tokens(c), lambda w: F.length(w) >= 4))
    counts = raw.select("project", "id", F.explode(words(F.col("content"))).alias("c")).distinct().groupBy("project", "c").agg(F.count(F.lit(1)).alias("n"))
    lead = search.top_k(counts, ["project"], [F.desc("n"), F.col("c")], 40).select("project", "c")
    m = t("memories").filter("state IN ('active', 'fading') AND NOT recall_suppressed")
    held = m.select("id", "project", "salience", F.explode(words(F.array_join("concepts", " "))).alias("c"))
    hits = held.join(lead, ["project", "c"]).groupBy("id", "project", "salience").agg(F.count(F.lit(1)).alias("matches")).filter("matches >= 2")
    return search.top_k(hits, ["project"], [F.desc("salience"), F.col("id")], 5)


@query(
    """SELECT f.query_id, count(*) AS n_suggested, count(*) FILTER (m.access_count > 0) AS n_accepted
    FROM (SELECT query_id, unnest(retrieved_memory_ids) AS id FROM retrieval_feedback) f LEFT JOIN memories m USING (id) GROUP BY f.query_id"""
)
def acceptance_tracking(t):
    f = t("retrieval_feedback").select("query_id", F.explode("retrieved_memory_ids").alias("id"))
    m = t("memories").select("id", "access_count")
    return f.join(m, "id", "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_suggested"), F.count_if(F.col("access_count") > 0).alias("n_accepted")
    )


@query(
    """SELECT id, timestamp, source, type, project FROM memories WHERE timestamp >= {AS_OF} - INTERVAL 720 HOUR AND timestamp <= {AS_OF}
    AND state IN ('active', 'fading') AND NOT recall_suppressed"""
)
def recall_timeline(t):
    m = t("memories").filter(
        F.col("timestamp").between(F.expr(f"TIMESTAMP_NTZ'{AS_OF}' - INTERVAL 720 HOURS"), F.expr(f"TIMESTAMP_NTZ'{AS_OF}'"))
    )
    return retrieval.post_filter(m.filter(F.col("state").isin("active", "fading"))).select("id", "timestamp", "source", "type", "project")


@query(
    """SELECT id, salience FROM memories WHERE timestamp >= TIMESTAMP '2026-04-15' AND timestamp <= TIMESTAMP '2026-05-15' AND source = 'mcp' AND state = 'active'
    AND salience >= 0.3 AND NOT coalesce(recall_suppressed, false) AND NOT coalesce(list_contains(list_transform(concepts, lambda x: lower(x)), 'scanner'), false)"""
)
def post_filters(t):
    return retrieval.post_filter(
        t("memories"), since="2026-04-15", until="2026-05-15", source="mcp", state="active", min_salience=0.3, without_concepts=("Scanner",)
    ).select("id", "salience")
