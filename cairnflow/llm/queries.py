"""Queries of the training-data problems and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnflow.llm import cooccurrence, credentials, leakage, near_duplicates, quality, runs, splitting, tokenizing, vectors
from cairnflow.sources.tables import table


def p1_runs(spark, sf_dir):
    return runs.stream_runs(table(spark, sf_dir, "raw_memories"))


def p1_found(spark, sf_dir):
    return p1_runs(spark, sf_dir).select("first_id", "last_id")


def p2_redacted(spark, sf_dir):
    """Both fields of every observation, redacted, with the places of the secrets."""
    return credentials.redact_credentials(table(spark, sf_dir, "raw_memories"), "id", ("content", "metadata"))


def p2_found(spark, sf_dir):
    return credentials.found_secrets(table(spark, sf_dir, "raw_memories"), "id", ("content", "metadata"))


def p3_nearest(spark, sf_dir):
    return vectors.nearest(table(spark, sf_dir, "memories"), "id", "embedding", dim=128, k=5, least=0.8)


def p3_k_nearest(spark, sf_dir):
    """The five most similar memories of every memory, however similar."""
    return vectors.nearest(table(spark, sf_dir, "memories"), "id", "embedding", dim=128, k=5)


def p3_found(spark, sf_dir):
    return (
        p3_nearest(spark, sf_dir)
        .select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b"))
        .distinct()
    )


def _observations_and_memories(spark, sf_dir):
    raw, memories = table(spark, sf_dir, "raw_memories"), table(spark, sf_dir, "memories")
    return raw.select("id", "content").unionByName(memories.select("id", "content"))


def _p5(spark, sf_dir):
    return near_duplicates.near_duplicates(
        _observations_and_memories(spark, sf_dir), "id", "content", threshold=0.6, shingle=3, min_words=30
    )


def p5_found(spark, sf_dir):
    return _p5(spark, sf_dir).pairs()


def p5_documents(spark, sf_dir):
    return _p5(spark, sf_dir).documents()


def p6_pieces(spark, sf_dir):
    return splitting.split_items(table(spark, sf_dir, "raw_memories"), "id", "content")


def p6_found(spark, sf_dir):
    return p6_pieces(spark, sf_dir).filter(F.col("piece") == 0).select(F.col("item_id").alias("id"))


def p7_associations(spark, sf_dir):
    return cooccurrence.associations(table(spark, sf_dir, "memories"), "concepts")


def p7_found(spark, sf_dir):
    return p7_associations(spark, sf_dir).select(
        F.col("item_a").alias("concept_a"), F.col("item_b").alias("concept_b")
    )


def p8_ids(spark, sf_dir):
    return tokenizing.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def _leaks(spark, sf_dir, **kind):
    index = leakage.positional_index(table(spark, sf_dir, "documents"), "doc_id", "text")
    return leakage.leaked_items(index, table(spark, sf_dir, "eval_items"), "item_id", "text", **kind)


def p9_leaks(spark, sf_dir):
    return _leaks(spark, sf_dir)


def p9_found(spark, sf_dir):
    return p9_leaks(spark, sf_dir).filter("exact").select("doc_id", "item_id")


def p9_near(spark, sf_dir):
    """Proximity matches: 11 of 13 words, each within one word of its place."""
    return _leaks(spark, sf_dir, min_terms=11, slop=1).select("doc_id", "item_id", "n_hits")


def p10_quality(spark, sf_dir):
    return quality.text_quality(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_found(spark, sf_dir):
    return p10_quality(spark, sf_dir).filter("kind <> 'prose'").select("doc_id", "kind")


QUERIES = {
    "p1_found": p1_found,
    "p1_runs": p1_runs,
    "p2_found": p2_found,
    "p2_redacted": p2_redacted,
    "p3_found": p3_found,
    "p3_nearest": p3_nearest,
    "p3_k_nearest": p3_k_nearest,
    "p5_found": p5_found,
    "p5_documents": p5_documents,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p7_found": p7_found,
    "p7_associations": p7_associations,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_leaks": p9_leaks,
    "p9_near": p9_near,
    "p10_found": p10_found,
    "p10_quality": p10_quality,
}

_P1 = """
WITH obs AS (
  SELECT DISTINCT id, timestamp AS ts, coalesce(project, '') AS stream_project,
         lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) AS stream_source,
         regexp_replace(lower(type), '[^\\p{L}\\p{N}]+', '', 'g') AS value
  FROM raw_memories WHERE id IS NOT NULL AND timestamp IS NOT NULL),
marked AS (
  SELECT *, CASE WHEN value = lag(value) OVER w AND ts - lag(ts) OVER w <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS cut
  FROM obs WINDOW w AS (PARTITION BY stream_project, stream_source ORDER BY ts, id)),
numbered AS (
  SELECT *, sum(cut) OVER (PARTITION BY stream_project, stream_source ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS run
  FROM marked),
done AS (
  SELECT stream_project, stream_source, any_value(value) AS value, first(id ORDER BY ts, id) AS first_id,
         last(id ORDER BY ts, id) AS last_id, min(ts) AS start_ts, max(ts) AS end_ts,
         CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS duration_us, count(*) AS n_events
  FROM numbered GROUP BY stream_project, stream_source, run HAVING count(*) >= 3 AND any_value(value) IS NOT NULL)
"""
_P7 = """
WITH m AS (
  SELECT row_number() OVER () AS rid, list_distinct(list_filter(list_transform(concepts,
         lambda x: lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))), lambda x: x <> '')) AS b FROM memories),
e AS (SELECT rid, unnest(b) AS c FROM m WHERE len(b) > 0),
n AS (SELECT count(DISTINCT rid) AS n FROM e),
f AS (SELECT c, count(*) AS k FROM e GROUP BY c),
p AS (SELECT x.c AS item_a, y.c AS item_b, count(*) AS n_ab FROM e x JOIN e y ON x.rid = y.rid AND x.c < y.c GROUP BY ALL),
done AS (
  SELECT item_a, item_b, n_ab, fa.k AS n_a, fb.k AS n_b, n.n AS n,
         n_ab::DOUBLE * n.n / (fa.k::DOUBLE * fb.k) AS lift, log2(n_ab::DOUBLE * n.n / (fa.k::DOUBLE * fb.k)) AS pmi
  FROM p JOIN f fa ON fa.c = item_a JOIN f fb ON fb.c = item_b, n
  WHERE n_ab >= 5 AND n_ab * 500 >= n.n AND n_ab * n.n >= 4 * fa.k * fb.k)
"""

_P9 = """
WITH d AS (SELECT doc_id, string_split_regex(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS w
           FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, string_split_regex(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS w
      FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(w[k : k + 12], ' ') AS gram
       FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS k FROM d)),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 12], ' ') AS gram
       FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 12)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (gram)
"""

_P9_NEAR = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS q FROM d),
iw AS (SELECT item_id, len(w) AS n, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM i WHERE len(w) >= 13),
hit AS (SELECT DISTINCT doc_id, item_id, n, q - i + s AS diagonal, i FROM dw JOIN iw USING (t), (VALUES (-1), (0), (1)) v(s)),
kept AS (SELECT * FROM hit QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, diagonal) >= 11),
start AS (SELECT DISTINCT doc_id, item_id, n, diagonal, i - b AS j FROM kept, (VALUES (0), (1), (2)) v(b) WHERE i - b BETWEEN 1 AND n - 12),
full_ AS (SELECT doc_id, item_id, diagonal, j FROM start JOIN kept USING (doc_id, item_id, n, diagonal)
          WHERE i BETWEEN j AND j + 12 GROUP BY ALL HAVING count(*) >= 11)
SELECT doc_id, item_id, count(*) AS n_hits FROM full_ GROUP BY ALL
"""

_P3 = """
WITH v AS (SELECT id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM memories WHERE len(embedding) = 128
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.id AS id, b.id AS neighbour, round(list_cosine_similarity(a.v, b.v), 12) AS s FROM v a JOIN v b ON a.id <> b.id),
t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, neighbour) AS k FROM p WHERE s >= 0.8)
SELECT DISTINCT least(id, neighbour) AS id_a, greatest(id, neighbour) AS id_b FROM t WHERE k <= 5
"""
_P5 = """
WITH r AS (SELECT DISTINCT id, content FROM raw_memories WHERE content IS NOT NULL UNION ALL SELECT id, content FROM memories WHERE content IS NOT NULL),
w AS (SELECT id, string_split(trim(regexp_replace(lower(content), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS w FROM r),
s AS (SELECT DISTINCT id, hash(w[k], w[k + 1], w[k + 2]) AS g FROM (SELECT id, w, unnest(generate_series(1, len(w) - 2)) AS k FROM w WHERE len(w) >= 30)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT x.id AS id_a, y.id AS id_b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.id < y.id GROUP BY ALL)
SELECT id_a, id_b FROM c JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b WHERE c / (a.n + b.n - c)::DOUBLE >= 0.6
"""

_P9_LEAKS = _P9[: _P9.index("dw AS")] + """dw AS (SELECT doc_id, array_to_string(w[k : k + 12], ' ') AS gram FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS k FROM d)),
iw AS (SELECT item_id, array_to_string(w[k : k + 12], ' ') AS gram FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 12)) AS k FROM i))
SELECT doc_id, item_id, true AS exact, count(*) AS n_hits FROM dw JOIN iw USING (gram) GROUP BY ALL
"""
_P3_NEAREST = _P3[: _P3.rindex("SELECT DISTINCT")] + "SELECT id, neighbour, s AS similarity, k AS rank FROM t WHERE k <= 5"

SQL = {
    "p1_found": _P1 + "SELECT first_id, last_id FROM done",
    "p1_runs": _P1 + "SELECT * FROM done",
    "p3_found": _P3,
    "p3_nearest": _P3_NEAREST,
    "p5_found": _P5,
    "p6_found": "SELECT DISTINCT id FROM raw_memories WHERE length(content) > 4000",
    "p7_found": _P7 + "SELECT item_a AS concept_a, item_b AS concept_b FROM done",
    "p7_associations": _P7 + "SELECT * FROM done",
    "p9_found": _P9,
    "p9_near": _P9_NEAR,
    "p9_leaks": _P9_LEAKS,
}
