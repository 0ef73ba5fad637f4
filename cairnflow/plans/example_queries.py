"""Corpus filters, the source mix and training examples made of documents and memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnflow.functions import exprs as X, word_lists as W
from cairnflow.operators import corpus as C, examples as G
from cairnflow.plans.corpus_queries import _MAIL, _TIDY
from cairnflow.plans.registry import Registry

_R = Registry()
query, QUERIES, SQL = _R.query, _R.QUERIES, _R.SQL


@query(f"SELECT doc_id, x AS text FROM (SELECT doc_id, {_TIDY} AS x FROM documents WHERE starts_with(source, 'web')) WHERE x IS NOT NULL")
def clean_web(t):
    """Web pages and JSON files are tidied only."""
    d = t("documents").filter(F.col("source").startswith("web") & F.col("text").isNotNull())
    return d.select("doc_id", C.tidy(F.col("text")).alias("text"))


@query("SELECT doc_id FROM documents WHERE doc_id % 6 >= 3 AND length(text) BETWEEN 100 AND 50000")
def web_filter(t):
    """Pages by score (here from the id) and length."""
    return G.web_filter(t("documents").withColumn("score", (F.col("doc_id") % 6).cast("double"))).select("doc_id")


def _either(patterns) -> str:
    return "|".join(patterns).replace("'", "''")


@query(
    f"""WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN 'psychology' ELSE 'computer science' END AS f, left(replace(text, 'queue', 'salience'), 5000) AS h FROM documents)
    SELECT doc_id, subject FROM (SELECT doc_id, text, CASE WHEN f = 'psychology' AND regexp_matches(h, '{_either(W.NEURO_KEYWORDS)}', 'i') THEN 'neuro' WHEN f = 'computer science' AND regexp_matches(h, '{_either(W.CS_KEYWORDS)}', 'i') THEN 'cs' END AS subject FROM d)
    WHERE subject IS NOT NULL AND length(replace(text, 'queue', 'salience')) >= 200"""
)
def paper_classify(t):
    """Papers by field of study (here by the id) and keyword."""
    d = t("documents").withColumns({"fields": F.array(F.when(F.col("doc_id") % 2 == 0, " Psychology").otherwise("Computer Science")), "text": F.regexp_replace("text", "queue", "salience")})
    return G.classify_papers(d).select("doc_id", "subject")


_CLEANED = _MAIL.replace("(x,", "(x2,")


@query(
    f"""WITH p AS (SELECT doc_id AS id, (doc_id % 3 + 1)::INT AS post_type, (doc_id % 7)::INT AS score, CASE WHEN doc_id % 4 = 0 THEN '<go><json>' ELSE '<cooking>' END AS tags, title, text AS body FROM documents),
    k AS (SELECT id, CASE WHEN coalesce(title, '') <> '' THEN title || chr(10) || chr(10) || coalesce(body, '') ELSE coalesce(body, '') END AS x2 FROM p WHERE post_type IN (1, 2) AND score >= 3 AND (post_type <> 1 OR tags LIKE '%<go>%'))
    SELECT id, text FROM (SELECT id, {_CLEANED} AS text FROM k) WHERE length(text) >= 100"""
)
def post_documents(t):
    """Questions and answers (type, score and tags here from the id)."""
    i = F.col("doc_id")
    d = t("documents").select(
        i.alias("id"), (i % 3 + 1).cast("int").alias("post_type"), (i % 7).cast("int").alias("score"), F.when(i % 4 == 0, "<go><json>").otherwise("<cooking>").alias("tags"), "title", F.col("text").alias("body")
    )
    return G.posts(d)


_HEAD = "array_to_string(string_split({x}, chr(10))[1:{n}], chr(10))"


@query(
    f"""WITH c AS (SELECT doc_id AS id, coalesce(lang, 'none') AS lang, trim(coalesce(title, '')) AS s, coalesce(text, '') AS new, CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') ELSE '' END AS old FROM documents),
    f AS (SELECT id, lang, 'Commit: ' || s || CASE WHEN old <> '' AND new <> '' THEN chr(10) || chr(10) || 'Before:' || chr(10) || {_HEAD.format(x='old', n=30)} || chr(10) || chr(10) || 'After:' || chr(10) || {_HEAD.format(x='new', n=30)}
      WHEN new <> '' THEN chr(10) || chr(10) || 'New file:' || chr(10) || {_HEAD.format(x='new', n=50)} ELSE '' END AS text FROM c WHERE s <> '')
    SELECT id, lang, text FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY id) AS k FROM f) WHERE k <= 200"""
)
def commit_documents(t):
    """Commits as documents, two hundred of each language."""
    d = t("documents").select(
        F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("none")).alias("lang"), F.col("title").alias("subject"), F.col("title").alias("message"),
        F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("old"), F.col("text").alias("new"),
    )
    return G.commit_documents(d, 200)


@query("SELECT doc_id FROM documents WHERE length(text) BETWEEN 20 AND 50000")
def config_filter(t):
    return G.config_filter(t("documents")).select("doc_id")


@query("SELECT doc_id, len(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) + 1 AS n, 'end' AS last FROM documents WHERE text IS NOT NULL")
def tokens_with_end(t):
    """Tokens of each text and the end token (here in words)."""
    d = t("documents").filter("text IS NOT NULL").select("doc_id", F.array_append(X.tokens(F.col("text")), F.lit("end")).alias("ids"))
    return d.select("doc_id", F.size("ids").cast("long").alias("n"), F.element_at("ids", -1).alias("last"))


_MIX = {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}
_MV = ", ".join(f"('{k}', {v / sum(_MIX.values())})" for k, v in _MIX.items())


@query(
    f"""WITH d AS (SELECT lang AS source, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n, s.share::DOUBLE AS share FROM documents JOIN (VALUES {_MV}) s(lang, share) USING (lang)),
    e AS (SELECT *, unnest(generate_series(0, floor((round(share * 3000) - 1 - k) / n)::BIGINT)) AS epoch FROM d WHERE round(share * 3000) - 1 - k >= 0)
    SELECT source, doc_id, epoch, round((k + epoch * n + 0.5) / share, 6) AS at FROM e"""
)
def weighted_mix(t):
    """Three thousand draws from the languages by weight, small ones starting again."""
    return G.weighted_mix(t("documents").select("lang", "doc_id"), "lang", "doc_id", _MIX, 3000)


def _turns(t):
    """Memories as captured calls: an instruction, the observation and a second user turn for every third one."""
    m = t("memories")
    turn = lambda k, role, text: F.struct(F.lit(k).alias("turn"), F.lit(role).alias("role"), text.alias("text"))
    n = F.length("content")
    turns = F.array(
        turn(1, "system", F.lit("Encode the memory.")), turn(2, "user", F.col("content")),
        turn(3, "user", F.when(n % 3 == 0, F.concat(F.coalesce("summary", F.lit("")), F.lit("\nCOACHING NOTES: be brief")))), turn(4, "assistant", F.when(n % 4 != 0, F.col("summary"))),
    )
    return m.select("id", F.explode(turns).alias("x")).select("id", "x.*").filter("text IS NOT NULL")


_EX = """x AS (SELECT id, 'Encode the memory.' AS system, CASE WHEN length(content) % 3 = 0 THEN coalesce(summary, '') ELSE content END AS usr, coalesce(summary, '') AS response, type FROM memories WHERE trim(coalesce(summary, '')) <> ''),
  ex AS (SELECT id, system, rtrim(usr) AS usr, response, type FROM (SELECT id, system, CASE WHEN usr = '' THEN 'COACHING NOTES: be brief' ELSE usr END AS usr, response, type FROM x) WHERE usr <> '')"""


def _examples(t):
    responses = t("memories").select("id", F.col("summary").alias("response"))
    return G.messages(_turns(t), responses, ("RECENT SESSION CONTEXT:", "COACHING NOTES:"))


@query(f"WITH {_EX} SELECT id, system, usr AS user, response FROM ex".replace("usr AS user", 'usr AS "user"').replace("rtrim(usr)", "CASE WHEN length(usr) > 0 THEN usr END"))
def chat_extract(t):
    """The messages that training needs, out of whole conversations."""
    return _examples(t)


@query(f"WITH {_EX} SELECT id, '<|system|>' || chr(10) || system || chr(10) || '<|user|>' || chr(10) || usr || chr(10) || '<|assistant|>' || chr(10) AS prefix, response || '<|endoftext|>' AS completion FROM ex".replace("rtrim(usr)", "usr"))
def prompt_build(t):
    prefix, completion = G.prompt(F.col("system"), F.col("user"), F.col("response"))
    return _examples(t).select("id", prefix.alias("prefix"), completion.alias("completion"))


@query(
    f"WITH {_EX} SELECT id, '<|im_start|>system' || chr(10) || system || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || usr || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prefix, response || '<|im_end|>' || chr(10) AS completion FROM ex".replace("rtrim(usr)", "usr")
)
def chat_template(t):
    prefix, completion = G.prompt(F.col("system"), F.col("user"), F.col("response"), G.CHAT)
    return _examples(t).select("id", prefix.alias("prefix"), completion.alias("completion"))


_TOKS = "list_filter(string_split_regex({x}, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')"


@query(
    f"""WITH {_EX}, k AS (SELECT id, len({_TOKS.format(x="usr")}) AS u, len({_TOKS.format(x="response || '<|endoftext|>'")}) AS r FROM ex)
    SELECT id, (5 + least(u, 60 - r - 6) + 1)::INT AS completion_start, (5 + least(u, 60 - r - 6) + 1 + r)::INT AS n FROM k WHERE 60 - r - 6 >= 1""".replace("rtrim(usr)", "usr")
)
def prompt_budget(t):
    """Examples within 60 tokens (here words), the user's message cut, and where the response starts."""
    return G.budgeted(_examples(t), 60).select("id", "completion_start", "n")


def _calls(t):
    m, n = t("memories"), F.length("content")
    body = F.to_json(F.struct(F.left("content", F.lit(20)).alias("gist"), F.coalesce("summary", F.lit("")).alias("summary"), "content", F.when(n % 2 == 0, F.col("salience")).alias("salience"), F.array(F.lit("x")).alias("concepts")))
    kind = F.when(n % 5 == 0, "synthesis").when(n % 5 < 3, "unknown").otherwise("encoding")
    return m.select("id", kind.alias("task_type"), (n % 7 != 0).alias("parse_success"), F.when(n % 11 == 0, "timeout").alias("error"), body.alias("response"))


@query("SELECT id FROM memories WHERE length(content) % 7 <> 0 AND length(content) % 11 <> 0 AND (length(content) % 5 >= 3 OR (length(content) % 5 IN (1, 2) AND length(content) % 2 = 0 AND salience IS NOT NULL))")
def task_inclusion(t):
    return G.included(_calls(t), ["encoding"]).select("id")


@query(
    """WITH g AS (SELECT doc_id AS id, 0.9 + (doc_id % 11) / 100.0 AS accuracy, (doc_id % 5 + 1)::DOUBLE AS ratio, text AS input, title AS output FROM documents),
    k AS (SELECT * FROM g WHERE accuracy >= 0.95 AND ratio >= 3 AND coalesce(input, '') <> '' AND coalesce(output, '') <> '')
    SELECT id, 'compression' AS task, input AS "user", output AS response FROM k UNION ALL SELECT id, 'decompression', output, input FROM k"""
)
def compression_pairs(t):
    i = F.col("doc_id")
    d = t("documents").select(i.alias("id"), F.expr("0.9BD + (doc_id % 11) / 100BD").alias("accuracy"), (i % 5 + 1).cast("double").alias("ratio"), F.col("text").alias("input"), F.col("title").alias("output"))
    return G.compression_pairs(d)


@query("SELECT id, content AS \"user\", summary AS response FROM memories WHERE trim(coalesce(content, '')) <> '' AND length(content) % 4 <> 0 AND trim(coalesce(summary, '')) <> ''")
def synthesis_pairs(t):
    return G.synthesis_pairs(_turns(t))


@query(
    """WITH m AS (SELECT * FROM memories WHERE source = 'mcp' AND state = 'active' AND length(summary) > 20), l AS (SELECT id, count(*) AS n, max(strength) AS s FROM (SELECT source_id AS id, strength FROM associations WHERE strength >= 0.6 UNION ALL SELECT target_id, strength FROM associations WHERE strength >= 0.6) GROUP BY id)
    SELECT id, summary, CASE WHEN coalesce(content, '') = '' THEN summary ELSE content END AS content, array_to_string(coalesce(concepts, [])[1:5], '|') AS concepts, CASE WHEN coalesce(project, '') = '' THEN 'unknown' ELSE project END AS project, coalesce(n, 0) AS n_related, s AS strongest FROM m LEFT JOIN l USING (id)"""
)
def scenario_sampling(t):
    return G.scenarios(t("memories"), t("associations"), None).withColumn("concepts", F.array_join("concepts", "|"))


@query(
    """WITH g AS (SELECT id, length(content) AS n, left(content, 60) AS gist, coalesce(summary, '') AS sm, coalesce(concepts, []) AS c, salience * 1.5 AS s FROM memories),
    f AS (SELECT id, n % 13 <> 0 AS ok, length(sm) > 10 AND length(sm) <= 120 AS a, length(gist) > 5 AND length(gist) <= 70 AS b, len(c) BETWEEN 2 AND 8 AS d, s > 0 AND s <= 1 AS e FROM g)
    SELECT id, ok AS json_valid, CASE WHEN ok THEN 5 ELSE 0 END AS fields_present, round(CASE WHEN ok THEN 4.0 + a::INT * 1.5 + b::INT + d::INT * 1.5 + e::INT ELSE 0 END, 6) AS score FROM f"""
)
def generation_score(t):
    """Generated encodings (here made of memories, some cut off) scored from 0 to 9."""
    m, n = t("memories"), F.length("content")
    body = F.to_json(F.struct(F.left("content", F.lit(60)).alias("gist"), F.coalesce("summary", F.lit("")).alias("summary"), "content", F.coalesce("concepts", F.array().cast("array<string>")).alias("concepts"), (F.col("salience") * 1.5).alias("salience")))
    rows = m.select("id", F.when(n % 13 == 0, F.left(body, F.lit(30))).otherwise(body).alias("response"), body.alias("truth"))
    return G.generation_scores(rows, "response", "truth").select("id", "json_valid", "fields_present", F.round("score", 6).alias("score"))
