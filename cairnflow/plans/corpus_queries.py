"""The text-corpus pipeline over documents and captured responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnflow.functions import exprs as X, word_lists as W
from cairnflow.operators import corpus as C
from cairnflow.plans.registry import Registry

_R = Registry()
query, QUERIES, SQL = _R.query, _R.QUERIES, _R.SQL

_S = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


_TIDY = _strip("regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")
_PAPER = "x"
for _p, _r, _o in (
    (r"\\(?:textbf|textit|emph|underline)\{([^}]*)\}", r"\1", "g"), (r"\\(?:cite|ref|label|eqref)\{[^}]*\}", "", "g"),
    (r"\\(?:begin|end)\{[^}]*\}", "", "g"), (r"\$([^$]+)\$", r"\1", "g"), (r"[\[(](?:Figure|Fig\.|Table|Tab\.)\s*\d+[)\]]", "", "gi"),
):
    _PAPER = f"regexp_replace({_PAPER}, '{_p}', '{_r}', '{_o}')"
_CODE = r"regexp_replace(x, '[ \t\f\x0B]+(\n|$)', '\1', 'g')"
_MAIL = r"regexp_replace(regexp_replace(x, '<code>(.*?)</code>', '`\1`', 'gs'), '<[^>]+>', '', 'g')"
for _a, _b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
    _MAIL = f"replace({_MAIL}, '{_a}', '{_b}')"
_COMMIT = r"CASE WHEN len(string_split(x, chr(10))) > 100 THEN array_to_string(string_split(x, chr(10))[1:100], chr(10)) || chr(10) || '[diff truncated]' ELSE x END"
_CLEAN = f"""clean AS (SELECT * FROM (SELECT doc_id, source, CASE WHEN starts_with(source, 'papers') THEN {_strip(_PAPER)} WHEN starts_with(source, 'code') THEN {_CODE}
  WHEN starts_with(source, 'mail') THEN {_MAIL} WHEN starts_with(source, 'commits') THEN {_COMMIT} ELSE x END AS text FROM (SELECT doc_id, source, {_TIDY} AS x FROM documents)) WHERE length(text) >= 100)"""


@query(f"WITH {_CLEAN} SELECT doc_id, text FROM clean")
def clean_documents(t):
    """Every document by its source's cleaner, without Unicode normalisation (SQL has no such function)."""
    return C.clean_documents(t("documents").select("doc_id", "source", "text"), unicode=False).select("doc_id", "text")


@query()
def clean_documents_nfkc(t):
    return C.clean_documents(t("documents").select("doc_id", "source", "text")).select("doc_id", "text")


@query(f"SELECT doc_id, {_CODE.replace('(x,', '(text,')} AS text FROM documents WHERE text IS NOT NULL")
def clean_code(t):
    return t("documents").filter("text IS NOT NULL").select("doc_id", C.clean_code(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {_MAIL.replace('(x,', '(text,')} AS text FROM documents WHERE text IS NOT NULL")
def clean_qa(t):
    return t("documents").filter("text IS NOT NULL").select("doc_id", C.clean_answer(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {_COMMIT.replace('(x,', '(text,').replace('ELSE x', 'ELSE text')} AS text FROM documents WHERE text IS NOT NULL")
def clean_commit(t):
    return t("documents").filter("text IS NOT NULL").select("doc_id", C.clean_commit(F.col("text")).alias("text"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]*>?|>', ' ', 'g'), '[ \t\n\f\r\x0B]+', ' ', 'g')) AS plain FROM documents WHERE text IS NOT NULL")
def strip_markup(t):
    return t("documents").filter("text IS NOT NULL").select("doc_id", X.strip_tags(F.col("text")).alias("plain"))


@query("SELECT doc_id, round((length(left(trim(text), 2001)) - length(regexp_replace(left(trim(text), 2001), '<[^>]*>?', '', 'g'))) / greatest(length(left(trim(text), 2001)), 1)::DOUBLE, 9) AS share FROM documents WHERE text IS NOT NULL")
def markup_ratio(t):
    return t("documents").filter("text IS NOT NULL").select("doc_id", F.round(X.markup_share(F.col("text")), 9).alias("share"))


_ASCII = "length(regexp_replace(left(text, 1000), '[^\\x00-\\x7F]', '', 'g')) / greatest(length(left(text, 1000)), 1)::DOUBLE"
_GEN = " OR ".join(f"contains(lower(left(text, 500)), '{m}')" for m in W.GENERATED_MARKERS)


@query(f"SELECT doc_id FROM documents WHERE length(text) BETWEEN 50 AND 100000 AND {_ASCII} >= 0.5 AND NOT ({_GEN})")
def code_filter(t):
    return C.code_filter(t("documents").select("doc_id", "text")).select("doc_id")


@query(f"SELECT doc_id, round({_ASCII}, 9) AS share FROM documents WHERE text IS NOT NULL")
def ascii_ratio(t):
    return t("documents").filter("text IS NOT NULL").select("doc_id", F.round(C.ascii_share(F.col("text")), 9).alias("share"))


@query("SELECT doc_id, n_chars, length(text) AS actual FROM documents WHERE length(text) BETWEEN 100 AND 50000 AND n_chars <> length(text)")
def stale_lengths(t):
    return t("documents").filter(F.length("text").between(100, 50_000) & (F.col("n_chars") != F.length("text"))).select("doc_id", "n_chars", F.length("text").alias("actual"))


_NTOK = "len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> ''))"
_TOK = f"tok AS (SELECT doc_id, source, lang, {_NTOK} AS n FROM documents)"


def _tok(t):
    return t("documents").select("doc_id", "source", "lang", X.word_count(F.col("text")).cast("long").alias("n"))


@query(f"WITH {_TOK}, b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM tok) SELECT doc_id, source, before FROM b WHERE before < 3000")
def token_budget_cut(t):
    return C.token_budget(_tok(t), "source", ["doc_id"], "n", 3000).select("doc_id", "source", "before")


@query(f"WITH {_TOK}, o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM tok) SELECT doc_id, off AS \"offset\", (off // 5000)::BIGINT AS first_shard, (greatest(off + n - 1, off) // 5000)::BIGINT AS last_shard FROM o")
def shard_pack(t):
    return C.shards(_tok(t), ["doc_id"], "n", 5000).select("doc_id", "offset", "first_shard", "last_shard")


@query("WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') AS ids FROM documents), s AS (SELECT doc_id, ids, unnest(generate_series(0, len(ids) - 2, 64)) AS start FROM w WHERE len(ids) >= 2) SELECT doc_id, start::INT AS start, md5(array_to_string(ids[start + 1 : start + 65], ' ')) AS content FROM s")
def token_windows(t):
    d = t("documents").select("doc_id", X.tokens(F.col("text")).alias("ids"))
    return C.token_windows(d, "doc_id", "ids", 64).select("doc_id", "start", F.md5(F.array_join("window", " ")).alias("content"))


_WEIGHTS = {"en": 60.0, "de": 12.0, "fr": 15.0, "es": 10.0, "und": 3.0}
_WV = ", ".join(f"('{k}', {v})" for k, v in _WEIGHTS.items())


@query(
    f"""WITH {_TOK}, n AS (SELECT lower(lang) AS lang, sum(n) AS tokens FROM tok WHERE lang IS NOT NULL GROUP BY ALL), w AS (SELECT * FROM (VALUES {_WV}) v(lang, x)),
    j AS (SELECT coalesce(w.lang, n.lang) AS lang, coalesce(tokens, 0)::BIGINT AS tokens, coalesce(x, 0) / 100.0 AS wanted FROM w FULL JOIN n ON n.lang = w.lang),
    s AS (SELECT lang, tokens, round(100 * tokens / sum(tokens) OVER ()::DOUBLE, 4) AS actual, round(100 * wanted::DOUBLE, 4) AS wanted FROM j)
    SELECT *, round(actual - wanted, 4) AS delta, abs(round(actual - wanted, 4)) > 5 AS flagged FROM s"""
)
def mix_audit(t):
    d = _tok(t).filter("lang IS NOT NULL").withColumn("lang", F.lower("lang"))
    return C.mix_audit(d, "lang", "n", _WEIGHTS)


_TERMS = ["memory", "session", "queue", "index", "salience", "activation", "graph", "zettelkasten"]


@query(
    "WITH d AS (SELECT lower(text) AS x FROM documents WHERE text IS NOT NULL), t AS (SELECT unnest(["
    + ", ".join(f"'{x}'" for x in _TERMS)
    + "]) AS term) SELECT term, count(*) FILTER (contains(x, term)) AS hits, CASE WHEN count(*) FILTER (contains(x, term)) > 0.1 * count(*) THEN 'OK' WHEN count(*) FILTER (contains(x, term)) > 0 THEN 'LOW' ELSE 'MISS' END AS mark FROM t, d GROUP BY term"
)
def term_coverage(t):
    """In how many documents each domain term occurs; one pass with a counter per term."""
    low = F.lower("text")
    one = t("documents").filter("text IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(low.contains(x)).alias(x) for x in _TERMS])
    each = one.select("n", F.explode(F.array(*[F.struct(F.lit(x).alias("term"), F.col(x).alias("hits")) for x in _TERMS])).alias("x")).select("n", "x.*")
    return each.select("term", "hits", F.when(F.col("hits") > 0.1 * F.col("n"), "OK").when(F.col("hits") > 0, "LOW").otherwise("MISS").alias("mark"))


@query("WITH w AS (SELECT doc_id, len(list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> ''))) AS n_distinct FROM documents) SELECT CASE WHEN n_distinct < 10 THEN 'poor' WHEN n_distinct < 50 THEN 'fair' ELSE 'good' END AS quality, count(*) AS n, min(n_distinct) AS low FROM w GROUP BY ALL")
def sequence_quality(t):
    n = F.size(F.array_distinct(X.tokens(F.col("text"))))
    d = t("documents").select(n.alias("n_distinct"))
    return d.groupBy(F.when(F.col("n_distinct") < 10, "poor").when(F.col("n_distinct") < 50, "fair").otherwise("good").alias("quality")).agg(
        F.count(F.lit(1)).alias("n"), F.min("n_distinct").alias("low")
    )


def _captured(t):
    """Captured responses made of memories: every eighth is cut off, some lack fields (by their own content)."""
    m = t("memories")
    n = F.length("content")
    body = F.struct(
        F.left("content", F.lit(50) + n % 20).alias("gist"), F.when(n % 7 != 0, F.coalesce("summary", F.lit(""))).alias("summary"), "content",
        F.left("content", F.lit(40) - n % 30).alias("narrative"), F.coalesce("concepts", F.array().cast("array<string>")).alias("concepts"),
        F.create_map(F.lit("topics"), F.lit("x")).alias("structured_concepts"),
        F.when(n % 5 == 0, "grave").otherwise("routine").alias("significance"), F.lit("neutral").alias("emotional_tone"), F.lit("success").alias("outcome"),
        (F.col("salience") * 2).alias("salience"),
    )
    text = F.to_json(body)
    return m.select("id", F.when(n % 11 == 0, F.left(text, F.lit(40))).otherwise(text).alias("response"))


@query()
def gate_validate(t):
    g = C.gate(_captured(t), "response")
    return g.select("id", F.array_join("failures", "|").alias("failures"), F.array_join("warnings", "|").alias("warnings"))


@query(
    """WITH m AS (SELECT *, length(content) AS n, salience * 2 AS s, left(content, (50 + length(content) % 20)::INT) AS gist, CASE WHEN length(content) % 7 <> 0 THEN coalesce(summary, '') END AS sm FROM memories),
    f AS (SELECT id, CASE WHEN n % 11 = 0 THEN ['json_parse_failure'] WHEN sm IS NULL THEN ['missing_field'] ELSE list_filter([
      CASE WHEN length(gist) > 60 THEN 'gist_too_long' END, CASE WHEN length(sm) > 100 THEN 'summary_too_long' END, CASE WHEN s > 1 THEN 'salience_out_of_range' END,
      CASE WHEN n % 5 = 0 THEN 'invalid_significance' END, CASE WHEN trim(content) = '' THEN 'empty_content' END], lambda x: x IS NOT NULL) END AS f FROM m)
    SELECT x AS reason, count(*) AS n FROM (SELECT unnest(f) AS x FROM f) GROUP BY x"""
)
def gate_failures(t):
    """Hard failures by reason."""
    g = C.gate(_captured(t), "response").withColumn("warnings", F.array().cast("array<string>"))
    return C.gate_statistics(g).filter("reason <> 'passed'")


@query()
def gate_stats(t):
    return C.gate_statistics(C.gate(_captured(t), "response"))


@query("SELECT doc_id, CASE WHEN ('0x' || left(md5(doc_id::VARCHAR), 8))::UBIGINT < (0.1 * 4294967296)::BIGINT THEN 'eval' ELSE 'train' END AS part FROM documents")
def train_eval_split(t):
    return C.split_eval(t("documents").select("doc_id"), "doc_id").select("doc_id", "part")


@query("SELECT doc_id FROM documents WHERE ('0x' || left(md5(doc_id::VARCHAR), 8))::UBIGINT < (0.25 * 4294967296)::BIGINT")
def sample_by_hash(t):
    """A sampling operator: a quarter of the documents, decided by each one's own hash."""
    return C.sample_share(t("documents").select("doc_id"), "doc_id", 0.25)


@query(
    f"""WITH {_TOK} SELECT source, count(*) AS n, min(n) AS low, max(n) AS high, round(avg(n), 6) AS mean, list_sort(list(n))[CAST(floor(count(*) * 0.5) AS INT) + 1] AS median, list_sort(list(n))[CAST(floor(count(*) * 0.95) AS INT) + 1] AS p95
    FROM tok GROUP BY source"""
)
def length_stats(t):
    return C.length_stats(_tok(t), ["source"], "n")


@query(
    """WITH ok AS (SELECT id FROM memories WHERE state <> 'archived' AND length(left(concat_ws(' ', summary, content), 2000)) >= 20),
    p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(source_id, target_id), greatest(source_id, target_id) ORDER BY strength DESC, source_id) AS n FROM associations WHERE strength >= 0.7) WHERE n = 1)
    SELECT source_id AS anchor, target_id AS positive, relation_type AS relation, strength FROM p WHERE source_id IN (SELECT id FROM ok) AND target_id IN (SELECT id FROM ok)"""
)
def triplet_positives(t):
    return C.triplets(t("memories"), t("associations")).select("anchor", "positive", "relation", "strength")


@query(
    """WITH ok AS (SELECT id, coalesce(project, '') AS project FROM memories WHERE state <> 'archived' AND length(left(concat_ws(' ', summary, content), 2000)) >= 20),
    placed AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY md5(id), id) - 1 AS place, count(*) OVER (PARTITION BY project) AS size FROM ok),
    pos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(source_id, target_id), greatest(source_id, target_id) ORDER BY strength DESC, source_id) AS n FROM associations WHERE strength >= 0.7)
      WHERE n = 1 AND source_id IN (SELECT id FROM ok) AND target_id IN (SELECT id FROM ok)),
    lk AS (SELECT source_id AS a, target_id AS b FROM associations UNION SELECT target_id, source_id FROM associations),
    c AS (SELECT x.id AS a, y.id AS b, (y.place - x.place + x.size) % x.size AS far FROM placed x JOIN placed y ON y.project = x.project AND y.id <> x.id WHERE x.id IN (SELECT source_id FROM pos)),
    neg AS (SELECT a AS anchor, arg_min(b, far) AS negative FROM c ANTI JOIN lk USING (a, b) GROUP BY a)
    SELECT source_id AS anchor, target_id AS positive, negative, relation_type AS relation FROM pos LEFT JOIN neg ON neg.anchor = source_id"""
)
def triplets(t):
    return C.triplets(t("memories"), t("associations")).select("anchor", "positive", "negative", "relation")


@query(
    """WITH p AS (SELECT relation_type AS relation, strength, row_number() OVER (PARTITION BY least(source_id, target_id), greatest(source_id, target_id) ORDER BY strength DESC, source_id) AS n FROM associations WHERE strength >= 0.7)
    SELECT relation, count(*) AS n, round(min(strength), 4) AS low, round(max(strength), 4) AS high FROM p WHERE n = 1 GROUP BY relation"""
)
def triplet_stats(t):
    e = t("associations").filter("strength >= 0.7").withColumns({"a": F.least("source_id", "target_id"), "b": F.greatest("source_id", "target_id")})
    best = e.groupBy("a", "b").agg(F.min_by("relation_type", F.struct((-F.col("strength")).alias("s"), "source_id")).alias("relation"), F.max("strength").alias("strength"))
    return best.groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("strength"), 4).alias("low"), F.round(F.max("strength"), 4).alias("high"))
