"""The named operations of the store as functions over tables; writes return the new rows or snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from cairnflow.functions import exprs as X, word_lists as W
from cairnflow.operators import analytics, graph, lifecycle, retrieval, search, store

Tables = dict[str, DataFrame]


def remember(t: Tables, rows: DataFrame) -> DataFrame:
    """Observations with the first salience of their type and a content hash, added where the id is new."""
    raw = t["raw_memories"]
    new = rows.withColumns(
        {"initial_salience": X.weight_of(F.col("type"), W.TYPE_SALIENCE, 0.7), "content_hash": X.content_hash(F.col("source"), F.col("content"))}
    )
    for c in raw.columns:
        if c not in new.columns:
            new = new.withColumn(c, F.lit(None).cast(raw.schema[c].dataType))
    return store.insert_ignore(raw, new.select(raw.columns), ["id"])


def recall(t: Tables, queries: DataFrame, as_of: str, **filters) -> DataFrame:
    """Ranked memories of the queries (``query_id, query_text``)."""
    return retrieval.retrieve(t["memories"], t["associations"], t["retrieval_feedback"], queries, as_of, **filters)


batch_recall = recall


def recall_by_concepts(t: Tables, queries: DataFrame, k: int = 7) -> DataFrame:
    """Memories that hold a concept of the queries (``query_id, concepts``), by salience: the short way without ranking."""
    return search.concept_search(retrieval.post_filter(t["memories"]), queries, "query_id", "concepts", k)


def with_associations(ranked: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` strongest links of each returned memory: ``query_id, id, other, strength, relation_type, place``."""
    links = graph.undirected(edges.select("source_id", "target_id", "strength", "relation_type"))
    best = search.top_k(links, ["node"], [F.desc("strength"), F.col("other"), F.col("relation_type")], k).withColumnRenamed("rank", "place")
    return ranked.select("query_id", "id").join(best, F.col("id") == F.col("node")).drop("node")


def feedback_record(ranked: DataFrame, queries: DataFrame, as_of: str) -> DataFrame:
    """The record that a recall leaves for later rating: the returned ids by rank, no rating yet."""
    ids = ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("retrieved_memory_ids"))
    return queries.select("query_id", "query_text").join(ids, "query_id").withColumns({"feedback": F.lit(None).cast("string"), "created_at": F.lit(as_of).cast("timestamp_ntz")})


def get_context(t: Tables, project: str, k: int = 5) -> DataFrame:
    m = t["memories"].filter((F.col("project") == project) & F.col("state").isin("active", "fading"))
    return retrieval.post_filter(m).orderBy(F.desc("timestamp"), "id").limit(k)


def forget(t: Tables, ids: list[str]) -> DataFrame:
    m = t["memories"]
    return m.withColumn("state", F.when(F.col("id").isin(ids), "archived").otherwise(F.col("state")))


def status(t: Tables) -> DataFrame:
    pending = t["raw_memories"].filter(~F.coalesce("processed", F.lit(False))).agg(F.count_distinct("id").alias("pending"))
    return analytics.state_counts(t["memories"]).crossJoin(pending)


def recall_project(t: Tables, project: str, min_salience: float = 0.7) -> DataFrame:
    return retrieval.post_filter(t["memories"], project=project, min_salience=min_salience).orderBy(F.desc("salience"), "id")


def project_overview(t: Tables, project: str, min_salience: float = 0.7, min_strength: float = 0.3) -> DataFrame:
    """What a project's recall shows, ``part, id, score``: its memories by salience, its patterns by strength, the count of each state."""
    m = t["memories"].filter(F.col("project") == project)
    memories = recall_project(t, project, min_salience).select(F.lit("memory").alias("part"), "id", F.col("salience").alias("score"))
    patterns = m.filter((F.size("gist_of") > 0) & (F.col("state") == "active") & (F.col("salience") >= min_strength))
    states = m.groupBy("state").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return memories.unionByName(patterns.select(F.lit("pattern").alias("part"), "id", F.col("salience").alias("score"))).unionByName(
        states.select(F.lit("summary").alias("part"), F.col("state").alias("id"), "score")
    )


def recall_timeline(t: Tables, as_of: str, hours: int, k: int = 50) -> DataFrame:
    since = F.expr(f"TIMESTAMP_NTZ'{as_of}' - INTERVAL {int(hours)} HOURS")
    return retrieval.post_filter(t["memories"].filter(F.col("timestamp") >= since)).orderBy(F.desc("timestamp"), "id").limit(k)


def session_summary(t: Tables) -> DataFrame:
    m = t["memories"].filter("session_id IS NOT NULL")
    return m.groupBy("session_id").agg(F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"), F.count(F.lit(1)).alias("n"))


list_sessions = session_summary


def recall_session(t: Tables, session_id: str) -> DataFrame:
    return t["memories"].filter(F.col("session_id") == session_id).orderBy("timestamp", "id")


def get_patterns(t: Tables, min_strength: float = 0.3) -> DataFrame:
    m = t["memories"].filter((F.size("gist_of") > 0) & (F.col("salience") >= min_strength))
    return m.select("id", F.col("gist_of").alias("evidence_ids"), F.col("salience").alias("strength"), "state").orderBy(F.desc("strength"), "id")


def get_insights(t: Tables, k: int = 10) -> DataFrame:
    return t["memories"].filter("type = 'insight'").orderBy(F.desc("salience"), "id").limit(k)


def feedback(t: Tables, rows: DataFrame) -> DataFrame:
    """Ratings (columns of the feedback table): the latest per query stays."""
    return store.upsert_latest(t["retrieval_feedback"], rows, ["query_id"], "created_at")


def audit_encodings(t: Tables, k: int = 20, source: str | None = None) -> DataFrame:
    """The newest observations beside the memories made of them; the source is filtered within three times ``k`` rows."""
    newest = store.latest_delivery(t["raw_memories"]).orderBy(F.desc("created_at"), "id").limit(3 * k)
    if source:
        newest = newest.filter(F.col("source") == source)
    m = t["memories"].select(F.col("raw_id").alias("id"), F.col("id").alias("memory_id"), "summary", "concepts")
    return newest.select("id", "source", "content", "created_at").join(m, "id", "left").orderBy(F.desc("created_at"), "id").limit(k)


def ingest_project(spark, path: str, known: DataFrame | None = None) -> DataFrame:
    from cairnflow.sources import ingest

    return ingest.observation_rows(ingest.extract(ingest.read_files(spark, path, known)))


def exclude_path(exclusions: DataFrame, patterns: DataFrame) -> DataFrame:
    return store.insert_ignore(exclusions, patterns, ["pattern"])


def list_exclusions(exclusions: DataFrame) -> DataFrame:
    return exclusions.orderBy("pattern")


def amend(t: Tables, amendments: DataFrame) -> tuple[DataFrame, DataFrame]:
    return store.amend(t["memories"], amendments)


def check_memory(t: Tables, memory_id: str) -> DataFrame:
    e = t["associations"]
    n = e.filter((F.col("source_id") == memory_id) | (F.col("target_id") == memory_id)).agg(F.count(F.lit(1)).alias("links"))
    return t["memories"].filter(F.col("id") == memory_id).crossJoin(n)


def dismiss_pattern(t: Tables, pattern_id: str) -> DataFrame:
    return forget(t, [pattern_id])


def create_handoff(t: Tables, row: DataFrame) -> DataFrame:
    return remember(t, row.withColumn("type", F.lit("handoff")))


def maintain(t: Tables, as_of: str) -> tuple[DataFrame, DataFrame]:
    return lifecycle.cycle(t["memories"], t["associations"], as_of)


def coach(t: Tables) -> DataFrame:
    """What the coaching file is written from: share of each feedback value."""
    return analytics.top_values(t["retrieval_feedback"].filter("feedback <> ''").withColumn("all", F.lit(1)), ["all"], "feedback", 3).drop("all")


def search_text(t: Tables, queries: DataFrame, k: int = 10) -> DataFrame:
    m = t["memories"]
    return search.bm25(m, "id", retrieval.memory_text(m), queries, "query_id", F.col("query_text"), k)


#: Name -> function.
TOOLS: dict[str, Callable] = {
    f.__name__ if n is None else n: f
    for n, f in [
        (None, remember), (None, recall), ("batch_recall", batch_recall), (None, get_context), (None, forget), (None, status),
        (None, recall_project), (None, recall_timeline), (None, session_summary), (None, get_patterns), (None, get_insights),
        (None, feedback), (None, audit_encodings), ("coach_local_llm", coach), (None, ingest_project), ("list_sessions", list_sessions),
        (None, recall_session), (None, exclude_path), (None, list_exclusions), (None, amend), (None, check_memory),
        (None, dismiss_pattern), (None, create_handoff),
    ]
}
