"""Hybrid ranked retrieval for a batch of queries, as one chain of DataFrame steps."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cairnflow.functions import exprs as X, word_lists as W
from cairnflow.functions.embedding import embed
from cairnflow.operators import graph, search
from cairnflow.sources.tables import materialize


@dataclass(frozen=True)
class Settings:
    text_limit: int = 10
    vector_limit: int = 10
    alpha: float = 0.6
    both_bonus: float = 0.15
    hops: int = 3
    decay: float = 0.7
    threshold: float = 0.1
    max_results: int = 7
    diversity_cut: float = 0.85
    relevance_share: float = 0.7


def memory_text(df: DataFrame) -> Column:
    return F.concat_ws(" ", "summary", "content", F.array_join("concepts", " "))


def text_score(rank: Column, salience: Column) -> Column:
    s = F.when(salience <= 0, 0.5).otherwise(F.coalesce(salience, F.lit(0.5)))
    return 0.7 / rank + 0.3 * s


def merge_entry_points(text_hits: DataFrame, vector_hits: DataFrame, keys: list[str], s: Settings = Settings()) -> DataFrame:
    """Full outer join of both lists: both found -> blended plus a bonus, else the one score."""
    t = text_hits.select(*keys, "id", F.col("text_score").alias("t"))
    v = vector_hits.select(*keys, "id", F.col("score").alias("v"))
    both = s.alpha * F.col("v") + (1 - s.alpha) * F.col("t") + s.both_bonus
    return t.join(v, [*keys, "id"], "full_outer").select(
        *keys, "id", F.coalesce(both, F.col("v"), F.col("t")).alias("activation")
    )


def feedback_scores(feedback: DataFrame) -> DataFrame:
    """Mean rating of each memory over the rated queries that returned it; a memory counts once per place."""
    rated = feedback.filter(F.col("feedback").isin(list(W.FEEDBACK_VALUES)))
    value = X.weight_of(F.col("feedback"), W.FEEDBACK_VALUES, 0.0)
    return (
        rated.select(F.explode("retrieved_memory_ids").alias("id"), value.alias("x"))
        .groupBy("id")
        .agg(F.avg("x").alias("feedback_mean"), F.count(F.lit(1)).alias("n_rated"))
    )


def rank_score(as_of: str) -> Column:
    """Final score from activation, recency, activity, significance, type, source and feedback."""
    seen = F.coalesce("last_accessed", "created_at")
    days = F.expr(f"timestampdiff(SECOND, coalesce(last_accessed, created_at), TIMESTAMP_NTZ'{as_of}')") / 86400.0
    recency = F.when(seen.isNotNull(), 0.2 * F.exp(-F.greatest(days, F.lit(0.0)) / 30)).otherwise(F.lit(0.0))
    activity = F.least(F.lit(0.2), 0.02 * F.log1p(F.coalesce("activation_count", F.lit(0))))
    base = F.col("activation") * (1 + recency + activity + F.coalesce("context_boost", F.lit(0.0)))
    return (
        base
        * X.weight_of(F.col("type"), W.TYPE_WEIGHTS, 1.0)
        * X.weight_of(F.col("source"), W.SOURCE_WEIGHTS, 1.0)
        + 0.15 * F.coalesce("feedback_mean", F.lit(0.0))
    )


def post_filter(
    df: DataFrame,
    project: str | None = None,
    since: str | None = None,
    until: str | None = None,
    source: str | None = None,
    state: str | None = None,
    kind: str | None = None,
    min_salience: float | None = None,
    with_suppressed: bool = False,
    without_concepts: tuple[str, ...] = (),
    strict_reference: bool = False,
) -> DataFrame:
    """The filter after ranking.  Suppressed memories and excluded concepts always count;
    with ``strict_reference`` only if another condition is set."""
    tests: list[Column] = []
    if project:
        tests.append(F.col("project") == project)
    if since:
        tests.append(F.col("timestamp") >= F.lit(since).cast("timestamp_ntz"))
    if until:
        tests.append(F.col("timestamp") <= F.lit(until).cast("timestamp_ntz"))
    if source:
        tests.append(F.col("source") == source)
    if state:
        tests.append(F.col("state") == state)
    if kind:
        tests.append(F.col("type") == kind)
    if min_salience is not None:
        tests.append(F.col("salience") >= min_salience)
    if tests or not strict_reference:
        if not with_suppressed:
            tests.append(~F.coalesce("recall_suppressed", F.lit(False)))
        if without_concepts:
            tests.append(~F.arrays_overlap(X.folded_set(F.col("concepts")), X.lit_array([c.lower() for c in without_concepts])))
    for t in tests:
        df = df.filter(t)
    return df


def diversify(ranked: DataFrame, keys: list[str], s: Settings = Settings()) -> DataFrame:
    """Maximal marginal relevance inside each query's short list (``id, score, v``).

    The first is the best; then again and again the item with the best mix of relevance and
    distance to what is chosen, items too close to a chosen one being skipped.  Lists are as
    short as the result limit, so a group is bounded.
    """
    key_type = [f"{k} {dict(ranked.dtypes)[k]}" for k in keys]

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        vs = [None if v is None or len(v) == 0 or not np.any(v) else np.asarray(v, float) for v in pdf["v"]]
        vs = [None if v is None else v / np.linalg.norm(v) for v in vs]
        top = pdf["score"].iloc[0] or 1.0
        chosen, left = [0], list(range(1, len(pdf)))
        while left:
            best = None
            for i in list(left):
                close = [
                    float(vs[i] @ vs[j]) if vs[i] is not None and vs[j] is not None and len(vs[i]) == len(vs[j]) else 0.0
                    for j in chosen
                ]
                if max(close) >= s.diversity_cut:
                    left.remove(i)
                    continue
                value = s.relevance_share * pdf["score"].iloc[i] / top
                if vs[i] is not None:
                    value += (1 - s.relevance_share) * (1 - max(close))
                if best is None or value > best[0]:
                    best = (value, i)
            if best is None:
                break
            chosen.append(best[1])
            left.remove(best[1])
        out = pdf.iloc[chosen][[*keys, "id", "score"]].copy()
        out["place"] = range(1, len(out) + 1)
        return out

    id_type = dict(ranked.dtypes)["id"]
    return ranked.select(*keys, "id", "score", "v").groupBy(*keys).applyInPandas(
        pick, ", ".join([*key_type, f"id {id_type}", "score double", "place int"])
    )


def candidates(memories: DataFrame | dict, queries: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Text hits and vector hits of each query (``query_id, query_text``); ``memories`` or their ``index``."""
    known = _known(memories)
    text = search.bm25_of(known["postings"], known["lengths"], queries, "query_id", F.col("query_text"), s.text_limit)
    memories = known["rows"]
    salience = memories.select(F.col("id").alias("doc_id"), "salience")
    text = text.join(salience, "doc_id").select(
        "query_id", F.col("doc_id").alias("id"), "score", "rank", text_score(F.col("rank"), F.col("salience")).alias("text_score")
    )
    asked = queries.select("query_id", embed(F.col("query_text")).alias("v"))
    return text, search.vector_top_k(known["vectors"], "id", "v", asked, "query_id", "v", s.vector_limit)


def in_range(memories: DataFrame, asked: DataFrame, k: int = 7) -> DataFrame:
    """The ``k`` newest memories of each query's time range (``query_id, since, until``): ``query_id, id, activation, rank``.

    Activation is 0.3 and a fifth of the salience.  Memories and ranges meet by hour: of an hour that lies wholly inside a
    range only its ``k`` newest memories can be among the result, so no more of it are joined; only the hours at the ends
    are read whole.  Memories without a timestamp match nothing."""
    hour = lambda c: F.date_trunc("HOUR", c).cast("timestamp_ntz")
    m = memories.filter(F.col("timestamp").isNotNull()).select("id", "timestamp", "salience", hour(F.col("timestamp")).alias("h"))
    m = search.top_k(m, ["h"], [F.desc("timestamp"), F.col("id")], None).withColumnRenamed("rank", "_n")
    q = asked.filter(F.col("since") <= F.col("until")).withColumns({"_a": hour(F.col("since")), "_b": hour(F.col("until"))})
    ends = q.select("query_id", "since", "until", F.explode(F.array_distinct(F.array("_a", "_b"))).alias("h"))
    inner = q.filter(F.expr("_b - _a >= INTERVAL 2 HOURS")).select(
        "query_id", "since", "until", F.explode(F.expr("sequence(_a + INTERVAL 1 HOUR, _b - INTERVAL 1 HOUR, INTERVAL 1 HOUR)")).alias("h")
    )
    hits = ends.join(m, "h").unionByName(inner.join(m.filter(F.col("_n") <= k), "h"))
    hits = hits.filter(F.col("timestamp").between(F.col("since"), F.col("until")))
    best = search.top_k(hits, ["query_id"], [F.desc("timestamp"), F.col("id")], k)
    return best.select("query_id", "id", (0.3 + 0.2 * F.coalesce("salience", F.lit(0.0))).alias("activation"), "rank")


def inject(entries: DataFrame, ranged: DataFrame) -> DataFrame:
    """Entry points with those of the time range that are not among them."""
    return entries.select("query_id", "id", "activation").unionByName(
        ranged.join(entries, ["query_id", "id"], "left_anti").select("query_id", "id", "activation")
    )


def index(memories: DataFrame) -> dict[str, DataFrame]:
    """What retrieval reads of the memories, built once: posting lists, lengths, vectors and the rows themselves.

    The tables are written to the shared folder; ``retrieve`` takes them in place of the memories, for any number of calls."""
    known = _known(memories)
    return known | {"vectors": materialize(known["vectors"], "memory-vectors")}


def _known(memories: DataFrame | dict) -> dict[str, DataFrame]:
    if isinstance(memories, dict):
        return memories
    lists, lengths = search.postings(memories, "id", memory_text(memories))
    alive = memories.filter(F.col("state").isin("active", "fading"))
    return {"postings": lists, "lengths": lengths, "vectors": alive.select("id", embed(memory_text(alive)).alias("v")), "rows": memories}


def retrieve(
    memories: DataFrame | dict,
    edges: DataFrame,
    feedback: DataFrame,
    queries: DataFrame,
    as_of: str,
    s: Settings = Settings(),
    ranges: DataFrame | None = None,
    diverse: bool = False,
    **filters,
) -> DataFrame:
    """Ranked memories of every query: ``query_id, id, score, activation, rank``; ``memories`` or their ``index``.

    Steps: text and vector candidates, merge, memories of the queries' time ``ranges`` (``query_id, since, until``),
    spreading activation, scoring, filter, cut and, if ``diverse``, the choice of different ones, which may shorten a list.
    Queries without any candidate give no rows.
    """
    text, vector = candidates(memories, queries, s)
    memories = memories["rows"] if isinstance(memories, dict) else memories
    entries = merge_entry_points(text, vector, ["query_id"], s)
    if ranges is not None:
        entries = inject(entries, in_range(memories, ranges, s.max_results))
    return ranked(entries, memories, edges, feedback_scores(feedback), as_of, s, diverse, **filters)


def ranked(
    entries: DataFrame, memories: DataFrame, edges: DataFrame, rated: DataFrame, as_of: str, s: Settings = Settings(), diverse: bool = False, **filters
) -> DataFrame:
    """``retrieve`` from the entry points (``query_id, id, activation``) on: spread over ``edges`` or their ``graph.links``, scored
    with the ``feedback_scores`` ``rated``, filtered and cut."""
    spread = materialize(
        graph.spread_activation(entries, edges, ["query_id"], s.hops, s.decay, s.threshold), "activated"
    )
    scored = spread.join(memories.drop("embedding"), "id").join(rated, "id", "left")
    scored = scored.withColumn("context_boost", F.lit(0.0)).withColumn("score", F.round(rank_score(as_of), 9))
    kept = post_filter(scored, **filters)
    best = search.top_k(
        kept.select("query_id", "id", "score", F.round("activation", 9).alias("activation")),
        ["query_id"],
        [F.desc("score"), F.col("id")],
        s.max_results,
    )
    if not diverse:
        return best
    chosen = diversify(best.join(memories.select("id", F.col("embedding").alias("v")), "id"), ["query_id"], s)
    return best.drop("rank").join(chosen.select("query_id", "id", F.col("place").alias("rank")), ["query_id", "id"])
