"""Scalar functions and single-row writes over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnflow.functions import exprs as X, word_lists as W
from cairnflow.operators import store
from cairnflow.plans.registry import Registry
from cairnflow.sources import ingest

_R = Registry()
query, QUERIES, SQL = _R.query, _R.QUERIES, _R.SQL

_WORDS = "list_filter(string_split_regex({x}, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')"
_KIND = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in W.TYPE_SALIENCE.items()) + " ELSE 0.7 END"


@query(
    f"""SELECT id, CASE WHEN length(content) > 60 THEN left(content, 60) || '...' ELSE content END AS short, CASE WHEN length(content) > 90 THEN left(content, 90) || chr(10) || '[truncated]' ELSE content END AS head,
    len({_WORDS.format(x="coalesce(content, '')")}) AS n_words, ({_KIND})::DOUBLE AS kind_salience FROM memories"""
)
def text_functions(t):
    """Truncation, heads with a marker, word counts and the first salience of a type."""
    c = F.col("content")
    return t("memories").select(
        "id", X.truncate(c, 60).alias("short"), X.read_head(c, 90).alias("head"), X.word_count(c).cast("long").alias("n_words"),
        X.weight_of(F.col("type"), W.TYPE_SALIENCE, 0.7).cast("double").alias("kind_salience"),
    )


@query(
    """WITH p AS (SELECT id, generate_subscripts(concepts, 1) AS k, unnest(concepts) AS c FROM memories WHERE concepts IS NOT NULL AND len(concepts) > 0 AND len(list_filter(concepts, lambda q: q IS NULL)) = 0),
    f AS (SELECT id, lower(c) AS low, min(k) AS k, arg_min(c, k) AS c FROM p GROUP BY ALL) SELECT id, string_agg(c, '|' ORDER BY k) AS concepts FROM f GROUP BY id"""
)
def concepts_keep_first(t):
    """Concepts without repeats in another letter case, the first spelling kept."""
    m = t("memories").filter((F.size("concepts") > 0) & F.forall("concepts", lambda x: x.isNotNull()))
    return m.select("id", F.array_join(X.dedup_keep_first(F.col("concepts")), "|").alias("concepts"))


@query(
    """SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' ELSE (s // 86400) || 'd' END AS age FROM (SELECT event_id, date_sub('second', ts, TIMESTAMP '2024-01-31 00:00:00') AS s FROM events)"""
)
def short_durations(t):
    """Ages of events in the greatest unit that fits."""
    s = F.expr("timestampdiff(SECOND, ts, TIMESTAMP_NTZ'2024-01-31 00:00:00')")
    return t("events").select("event_id", X.short_duration(s).alias("age"))


@query("SELECT id, CASE WHEN starts_with(kind, 'file_') THEN substr(kind, 6) ELSE '' END AS verb FROM (SELECT DISTINCT id, CASE WHEN lower(trim(source)) = 'filesystem' THEN 'file_' || coalesce(type, 'x') ELSE coalesce(type, '') END AS kind FROM raw_memories)")
def event_verbs(t):
    kind = F.when(F.lower(F.trim("source")) == "filesystem", F.concat(F.lit("file_"), F.coalesce("type", F.lit("x")))).otherwise(F.coalesce("type", F.lit("")))
    return t("raw_memories").select("id", kind.alias("kind")).distinct().select("id", X.event_verb(F.col("kind")).alias("verb"))


@query("SELECT id, CASE WHEN length(content) % 4 = 3 THEN NULL ELSE id END AS found FROM memories")
def json_from_prose(t):
    """Objects taken out of answers: bare, fenced and between words; none where there is no brace."""
    n = F.length("content") % 4
    j = F.to_json(F.struct("id", F.col("state")))
    text = F.when(n == 0, j).when(n == 1, F.concat(F.lit("Sure:\n```json\n"), j, F.lit("\n```\nDone."))).when(n == 2, F.concat(F.lit("It is "), j, F.lit(", I think."))).otherwise("nothing here")
    return t("memories").select("id", F.get_json_object(X.json_in_prose(text), "$.id").alias("found"))


@query("SELECT id, CASE WHEN type = 'error' THEN 'fading' ELSE state END AS state, round(CASE WHEN type = 'error' THEN salience / 2 ELSE salience END, 9) AS salience, content FROM memories")
def update_memory(t):
    """State and salience changed for some, other columns kept."""
    m = t("memories")
    changes = m.filter("type = 'error'").select("id", F.lit("fading").alias("state"), (F.col("salience") / 2).alias("salience"), F.lit(None).cast("string").alias("content"))
    return store.update(m, changes, "id", ["state", "salience", "content"]).select("id", "state", F.round("salience", 9).alias("salience"), "content")


@query(
    """SELECT source_id, target_id, strength FROM associations UNION ALL SELECT a, b, s FROM (SELECT target_id AS a, source_id AS b, max(strength) AS s FROM associations GROUP BY ALL) WHERE NOT EXISTS (SELECT 1 FROM associations e WHERE e.source_id = a AND e.target_id = b)"""
)
def create_edges(t):
    """The reverse of every edge added where that pair is new."""
    e = t("associations").select("source_id", "target_id", "strength")
    back = e.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "strength")
    return store.insert_ignore(e, back, ["source_id", "target_id"])


_LABEL = "x <> '' AND NOT contains(x, ':') AND NOT starts_with(x, 'source') AND NOT starts_with(x, 'type') AND x <> 'general' AND NOT (x = 'memory' AND len(concepts) > 3)"


@query(f"SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(concepts, lambda x: lower(trim(x))), lambda x: x IS NOT NULL AND {_LABEL}))), '|') AS concepts FROM memories WHERE concepts IS NOT NULL")
def concepts_clean(t):
    """Concepts without labels and over-general terms, sorted."""
    m = t("memories").filter("concepts IS NOT NULL")
    return m.select("id", F.array_join(F.array_sort(X.clean_concepts(F.col("concepts"))), "|").alias("concepts"))


@query()
def paragraph_chunks(t):
    """Documents packed from their paragraphs into chunks, as ingest does."""
    d = t("documents").filter("text IS NOT NULL")
    return d.select("doc_id", F.posexplode(ingest.group_paragraphs(F.split("text", "\n\n", -1))).alias("chunk", "text"))
