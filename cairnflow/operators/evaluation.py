"""Retrieval metrics and grades."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def query_scores(ranked: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, precision, recall, mrr, ndcg, ndcg_retrieved`` of every query with an expected id.

    ``ranked``: query_id, id, rank; ``expected``: query_id, id.  Precision always divides by
    ``k``; the ideal of ``ndcg`` places min(expected, k) hits first, that of ``ndcg_retrieved``
    only the hits that were retrieved."""
    hits = ranked.filter(F.col("rank") <= k).join(expected.distinct(), ["query_id", "id"], "left_semi")
    found = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg")
    )
    n = expected.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n_expected"))
    ideal = lambda m: F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    h = F.coalesce("hits", F.lit(0))
    dcg = F.coalesce("dcg", F.lit(0.0))
    return n.join(found, "query_id", "left").select(
        "query_id",
        F.round(h / k, 6).alias("precision"),
        F.round(h / F.col("n_expected"), 6).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(dcg / ideal(F.least(F.col("n_expected"), F.lit(k)).cast("int")), 6).alias("ndcg"),
        F.round(F.when(h > 0, dcg / ideal(h.cast("int"))).otherwise(0.0), 6).alias("ndcg_retrieved"),
    )


#: Least values for PASS and for WARN.
THRESHOLDS = {"precision": (0.70, 0.50), "mrr": (0.60, 0.40), "noise_suppression": (0.60, 0.40), "signal_retention": (0.80, 0.60)}


def grade(metrics: DataFrame) -> DataFrame:
    """``metric, value, grade`` of a one-row frame of means."""
    cols = [c for c in metrics.columns if c in THRESHOLDS]
    each = metrics.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value"), F.lit(THRESHOLDS[c][0]).alias("good"), F.lit(THRESHOLDS[c][1]).alias("fair")) for c in cols])).alias("x")).select("x.*")
    return each.select("metric", F.round("value", 6).alias("value"), F.when(F.col("value") >= F.col("good"), "PASS").when(F.col("value") >= F.col("fair"), "WARN").otherwise("FAIL").alias("grade"))


def system_metrics(memories: DataFrame, labels: DataFrame) -> DataFrame:
    """Noise that left the active state and signal that is still alive; ``labels``: id, label (noise or signal).
    Missing noise counts as suppressed, missing signal as lost."""
    j = labels.join(memories.select("id", "state"), "id", "left")
    gone = F.coalesce(~(F.col("state") == "active"), F.lit(True)).cast("double")
    alive = F.coalesce(F.col("state").isin("active", "fading"), F.lit(False)).cast("double")
    return j.agg(
        F.avg(F.when(F.col("label") == "noise", gone)).alias("noise_suppression"),
        F.avg(F.when(F.col("label") == "signal", alive)).alias("signal_retention"),
    )


def composite(m: DataFrame) -> DataFrame:
    """Adds the weighted score of a parameter sweep."""
    return m.withColumn(
        "composite",
        F.round(0.3 * F.col("ndcg") + 0.2 * F.col("precision") + 0.2 * F.col("mrr") + 0.15 * F.col("noise_suppression") + 0.15 * F.col("signal_retention"), 6),
    )


def pipeline_metrics(labels: DataFrame, memories: DataFrame, edges: DataFrame) -> DataFrame:
    """``signal_survival, noise_suppression, edges_per_signal`` of observations (``raw_id, label`` signal or noise).

    An observation that was never encoded is suppressed noise or lost signal.  An edge counts at either end."""
    m = memories.filter(F.col("raw_id").isNotNull()).select("raw_id", "id", "state")
    j = labels.join(m, "raw_id", "left")
    signal, noise = F.col("label") == "signal", F.col("label") == "noise"
    alive = F.coalesce(F.col("state").isin("active", "fading"), F.lit(False)).cast("double")
    gone = F.coalesce(F.col("state").isin("fading", "archived", "merged"), F.lit(True)).cast("double")
    ends = edges.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return j.join(ends, "id", "left").agg(
        F.avg(F.when(signal, alive)).alias("signal_survival"), F.avg(F.when(noise, gone)).alias("noise_suppression"),
        F.avg(F.when(signal & F.col("id").isNotNull(), F.coalesce("n", F.lit(0)))).alias("edges_per_signal"),
    )


def concept_scores(ranked: DataFrame, memories: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, precision, recall, mrr, ndcg``: a returned memory is a hit if it holds one of the query's concepts (``query_id,
    concept``, without letter case).

    Precision divides by what was returned, recall by the expected concepts (and so may exceed 1); the ideal gain is that of
    the hits put first.  Queries that returned nothing give no row."""
    top = ranked.filter(F.col("rank") <= k).select("query_id", "id", "rank")
    held = top.join(memories.select("id", F.explode_outer("concepts").alias("c")), "id").select("query_id", "rank", F.lower("c").alias("concept"))
    want = expected.select("query_id", F.lower("concept").alias("concept")).distinct()
    hit = held.join(want, ["query_id", "concept"], "left_semi").select("query_id", "rank").distinct().withColumn("hit", F.lit(1))
    n = expected.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_expected"))
    per = top.join(hit, ["query_id", "rank"], "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("hit") == 1, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("hits"), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return per.join(n, "query_id", "left").select(
        "query_id", (F.col("hits") / F.col("n")).alias("precision"), (F.col("hits") / F.coalesce("n_expected", F.lit(1))).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.when(F.col("hits") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"),
    )
