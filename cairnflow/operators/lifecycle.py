"""Maintenance of memories and patterns: decay, transitions, archiving, patterns, the whole cycle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cairnflow.operators import clusters, graph, patterns as P
from cairnflow.sources.tables import materialize


@dataclass(frozen=True)
class Settings:
    decay_rate: float = 0.95
    floor: float = 0.01
    fade_below: float = 0.3
    archive_below: float = 0.1
    prune_below: float = 0.05
    expire_days: int = 90
    unused_days: int = 30


def at(as_of: str, days: float = 0) -> Column:
    return F.expr(f"TIMESTAMP_NTZ'{as_of}' - INTERVAL '{int(days)}' DAY")


def hours_since(as_of: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, coalesce(last_accessed, created_at), TIMESTAMP_NTZ'{as_of}')") / 3600.0


def decay(memories: DataFrame, as_of: str, s: Settings = Settings()) -> DataFrame:
    """``salience`` after one cycle.  The exponent is the recency factor (0.8 within a day, 0.9
    within a week, else 1) times one less at most 0.3 for accesses; an optional column
    ``significance`` slows it (critical 0.8, important 0.9), ``emotional_tone`` and ``outcome``
    then raise the result.  Active and fading memories only."""
    has = set(memories.columns)
    h = hours_since(as_of)
    factor = F.when(h < 24, 0.8).when(h < 168, 0.9).otherwise(1.0)
    access = 1 - F.least(0.02 * F.coalesce("access_count", F.lit(0)), F.lit(0.3))
    rate = F.pow(F.lit(s.decay_rate), factor * access)
    if "significance" in has:
        rate = F.pow(rate, F.when(F.col("significance") == "critical", 0.8).when(F.col("significance") == "important", 0.9).otherwise(1.0))
    new = F.col("salience") * rate
    if {"emotional_tone", "outcome"} <= has:
        tone, end = F.col("emotional_tone"), F.col("outcome")
        new = new * F.when((tone == "satisfying") & (end == "success"), 1.05).when(tone == "frustrating", 1.03).otherwise(1.0)
    alive = F.col("state").isin("active", "fading")
    return memories.withColumn("salience", F.when(alive, F.greatest(F.lit(s.floor), new)).otherwise(F.col("salience")))


def transition(memories: DataFrame, s: Settings = Settings()) -> DataFrame:
    low, gone = F.col("salience") < s.fade_below, F.col("salience") < s.archive_below
    state = (
        F.when(F.col("state").isin("active", "fading") & gone, "archived")
        .when((F.col("state") == "active") & low, "fading")
        .otherwise(F.col("state"))
    )
    return memories.withColumn("state", state)


def expire(memories: DataFrame, as_of: str, s: Settings = Settings()) -> DataFrame:
    """Without archived memories older than the limit; a null age counts as young."""
    return memories.filter(~F.coalesce((F.col("state") == "archived") & (F.col("created_at") < at(as_of, s.expire_days)), F.lit(False)))


def never_recalled(memories: DataFrame, as_of: str, s: Settings = Settings()) -> DataFrame:
    return memories.filter(
        (F.col("state") == "active") & (F.col("source") != "mcp") & (F.coalesce("access_count", F.lit(0)) == 0)
        & (F.col("created_at") <= at(as_of, s.unused_days))
    )


def dead(memories: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return memories.filter((F.col("state") == "active") & (F.col("last_accessed").isNull() | (F.col("last_accessed") < at(as_of, days))))


def demote_noise(memories: DataFrame, as_of: str, below: float = 0.5, factor: float = 0.8) -> DataFrame:
    """Dead memories of little salience lose a fifth of it."""
    hit = (F.col("state") == "active") & (F.col("last_accessed").isNull() | (F.col("last_accessed") < at(as_of, 30))) & (F.col("salience") < below)
    return memories.withColumn("salience", F.when(hit, F.col("salience") * factor).otherwise(F.col("salience")))


def evidence_ratio(patterns: DataFrame, memories: DataFrame) -> DataFrame:
    """``id, n_evidence, ratio``: the share of a pattern's evidence that is active or fading; missing memories count as gone."""
    each = patterns.select("id", F.explode_outer("evidence_ids").alias("m"))
    alive = memories.select(F.col("id").alias("m"), F.col("state").isin("active", "fading").alias("alive"))
    return each.join(alive, "m", "left").groupBy("id").agg(
        F.count("m").alias("n_evidence"), F.coalesce(F.avg(F.when(F.col("m").isNotNull(), F.coalesce("alive", F.lit(False)).cast("double"))), F.lit(0.0)).alias("ratio")
    )


def decay_patterns(patterns: DataFrame, memories: DataFrame) -> DataFrame:
    """Strength and state of patterns by the share of their evidence that is left."""
    return weaken(patterns.join(evidence_ratio(patterns, memories), "id"))


def strengthen_pattern(strength: Column, new: Column, cluster: Column, total: Column) -> Column:
    """Strength after ``new`` pieces of evidence from a cluster."""
    gain = F.least(F.lit(0.15), 0.03 * F.log2(1 + new) * F.when(cluster >= 5, 1.3).otherwise(1.0))
    return F.least(F.when(total > 10, 1.0).otherwise(0.95), strength + gain)


def ground(abstractions: DataFrame, as_of: str) -> DataFrame:
    """Confidence by the grounding ``ratio``; young ones keep at least 0.5, used ones with some ground are skipped."""
    factor = F.when(F.col("ratio") >= 0.5, 1.0).when(F.col("ratio") >= 0.3, 0.9).when(F.col("ratio") >= 0.1, 0.7).otherwise(0.5)
    skip = (F.col("access_count") > 5) & (F.col("ratio") >= 0.1)
    young = F.col("created_at") > at(as_of, 7)
    lowered = F.when(young & (F.col("confidence") >= 0.5), F.greatest(F.lit(0.5), F.col("confidence") * factor)).otherwise(F.col("confidence") * factor)
    new = F.when(skip, F.col("confidence")).otherwise(lowered)
    state = F.when(~skip & (F.col("ratio") < 0.1) & (F.col("state") == "active") & (new < 0.1), "fading").otherwise(F.col("state"))
    return abstractions.withColumn("state", state).withColumn("confidence", new)


def zombies(abstractions: DataFrame) -> DataFrame:
    """Two passes in one: an active abstraction of almost no confidence goes straight to the archive."""
    c = F.col("confidence")
    state = (
        F.when(F.col("state").isin("active", "fading") & (c < 0.001), "archived")
        .when((F.col("state") == "active") & (c < 0.01), "fading")
        .otherwise(F.col("state"))
    )
    return abstractions.withColumn("state", state)


def cycle(memories: DataFrame, edges: DataFrame, as_of: str, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """The part of a maintenance cycle that touches memories and edges only (see ``full_cycle``); each step takes the
    result of the one before.

    Decay, transition, pruning of weak and orphaned edges, expiry, archiving of what was never
    recalled.  The snapshot is written at the end, so many cycles do not pile up one plan.
    """
    m = transition(decay(memories, as_of, s), s)
    m = expire(m, as_of, s)
    idle = (
        (F.col("state") == "active") & (F.col("source") != "mcp") & (F.coalesce("access_count", F.lit(0)) == 0)
        & (F.col("created_at") <= at(as_of, s.unused_days))
    )
    m = materialize(m.withColumn("state", F.when(idle, "archived").otherwise(F.col("state"))), "cycle")
    e = graph.induced(graph.prune(edges, s.prune_below), m.filter(F.col("state").isin("active", "fading")))
    return m, e


def full_cycle(
    memories: DataFrame, edges: DataFrame, patterns: DataFrame, evidence: DataFrame, abstractions: DataFrame, feedback: DataFrame, as_of: str, s: Settings = Settings()
) -> dict[str, DataFrame]:
    """The whole maintenance cycle, thirteen steps in their order; each takes the result of the one before.

    Decay; transition; pruning of edges; merging of clusters into gists; extraction of patterns; expiry; archiving of what
    was never recalled; duplicates among abstractions (``id, title, v, level, confidence, state, created_at``); abstractions
    of no confidence; decay of patterns (``id, title, v, concepts, project, strength, state``, evidence ``pattern_id,
    memory_id``); duplicates among patterns; pruning of old feedback; the record.  Returns the tables and ``record``,
    ``step, n`` of what each step changed.  Tables are written after the steps that later ones read twice.
    """
    counts: list[tuple[str, DataFrame]] = []

    def changed(step: str, df: DataFrame) -> None:
        counts.append((step, df))

    before = memories.select("id", F.col("state").alias("_state"), F.col("salience").alias("_salience"))
    m = decay(memories, as_of, s)
    changed("decayed", m.join(before, "id").filter("salience <> _salience"))
    m = materialize(transition(m, s), "cycle-transition")
    changed("transitioned", m.join(before, "id").filter("state <> _state"))
    alive = m.filter(F.col("state").isin("active", "fading"))
    e = materialize(graph.induced(graph.prune(edges, s.prune_below), alive), "cycle-edges")
    changed("edges_pruned", edges.join(e, ["source_id", "target_id"], "left_anti"))
    slim = m.filter("state = 'active'").select("id", F.coalesce("project", F.lit("")).alias("project"), F.col("embedding").alias("v"), "created_at")
    members = clusters.by_vector(slim, ["project"]).select(F.col("leader").alias("cluster"), "id")
    m, e, mapping = P.merge(m, e, members, as_of)
    m, e = materialize(m, "cycle-merged"), materialize(e, "cycle-edges")
    changed("merged", m.filter("state = 'merged'").join(before.filter("_state = 'merged'"), "id", "left_anti"))
    new, found = P.extract(m)
    new = materialize(new.join(patterns.select("id"), "id", "left_anti").withColumn("state", F.lit("active")), "cycle-patterns")
    p = patterns.select("id", "title", "v", "concepts", "project", "strength", "state").unionByName(new.select("id", "title", "v", "concepts", "project", "strength", "state"))
    ev = materialize(evidence.unionByName(found).distinct(), "cycle-evidence")
    changed("patterns_extracted", new)
    kept = expire(m, as_of, s)
    changed("expired", m.join(kept.select("id"), "id", "left_anti"))
    idle = never_recalled(kept, as_of, s).select("id", F.lit("archived").alias("_s"))
    changed("never_recalled", idle)
    m = materialize(kept.join(idle, "id", "left").withColumn("state", F.coalesce("_s", "state")).drop("_s"), "cycle-memories")
    # the oldest abstraction of a level stands for its duplicates
    live = abstractions.filter("state = 'active'")
    found = P.duplicates(live, ["level"], -F.unix_micros(F.col("created_at").cast("timestamp")), 0.6, 0.75).filter("id <> leader")
    a = abstractions.join(found.select("id", F.lit("archived").alias("_s")), "id", "left").withColumn("state", F.coalesce("_s", "state")).drop("_s")
    changed("abstractions_deduplicated", found)
    a = materialize(zombies(a), "cycle-abstractions")
    share = m.select(F.col("id").alias("memory_id"), F.col("state").isin("active", "fading").cast("double").alias("x"))
    ratio = ev.join(share, "memory_id", "left").groupBy(F.col("pattern_id").alias("id")).agg(F.avg(F.coalesce("x", F.lit(0.0))).alias("ratio"))
    p = materialize(weaken(p.join(ratio, "id", "left").fillna({"ratio": 0.0})).drop("ratio"), "cycle-patterns")
    found = P.duplicates(p.filter("state = 'active'").withColumn("scope", F.lit("all")), ["scope"], F.col("strength"), 0.5, 0.75)
    changed("patterns_deduplicated", found.filter("id <> leader"))
    p, ev = P.fold_duplicates(p, ev, found)
    f = feedback.filter(~F.coalesce(F.col("created_at") < at(as_of, 30), F.lit(False)))
    changed("feedback_pruned", feedback.filter(F.col("created_at") < at(as_of, 30)))
    record = None
    for step, df in counts:
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(step).alias("step"), "n")
        record = row if record is None else record.unionByName(row)
    return {"memories": m, "edges": e, "patterns": p, "evidence": ev, "abstractions": a, "feedback": f, "record": record}


def weaken(patterns: DataFrame) -> DataFrame:
    """Strength and state of patterns by the ``ratio`` of their evidence that is left."""
    factor = F.when(F.col("ratio") >= 0.5, 0.995).when(F.col("ratio") >= 0.2, 0.93).otherwise(0.85)
    strength = F.col("strength") * factor
    state = F.when((F.col("state") == "active") & (strength < 0.1), "fading").when((F.col("state") == "fading") & (strength < 0.05), "archived").otherwise(F.col("state"))
    return patterns.withColumn("state", state).withColumn("strength", strength)


def age(memories: DataFrame, cycles: int, factor: float = 0.92) -> DataFrame:
    """``salience`` after so many cycles of plain aging."""
    return memories.withColumn("salience", F.col("salience") * F.pow(F.lit(factor), F.lit(cycles)))
