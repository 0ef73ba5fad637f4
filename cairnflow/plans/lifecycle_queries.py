"""Maintenance queries over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnflow.operators import lifecycle as L
from cairnflow.plans.registry import AS_OF, Registry

_R = Registry()
query, QUERIES, SQL = _R.query, _R.QUERIES, _R.SQL

_H = "date_sub('second', coalesce(last_accessed, created_at), {AS_OF}) / 3600.0"


def _decayed(s: str) -> str:
    return f"""CASE WHEN state IN ('active', 'fading') THEN greatest(0.01, {s} * pow(0.95::DOUBLE, (CASE WHEN {_H} < 24 THEN 0.8 WHEN {_H} < 168 THEN 0.9 ELSE 1.0 END)
    * (1 - least(0.02 * coalesce(access_count, 0), 0.3)))) ELSE {s} END"""


_NEXT = "CASE WHEN state IN ('active', 'fading') AND salience < 0.1 THEN 'archived' WHEN state = 'active' AND salience < 0.3 THEN 'fading' ELSE state END"


@query(f"SELECT id, round({_decayed('salience')}, 9) AS salience FROM memories")
def decay_salience(t):
    return L.decay(t("memories"), AS_OF).select("id", F.round("salience", 9).alias("salience"))


@query(
    f"""SELECT id, round(CASE WHEN state IN ('active', 'fading') THEN greatest(0.01, salience * pow(pow(0.95::DOUBLE, (CASE WHEN {_H} < 24 THEN 0.8 WHEN {_H} < 168 THEN 0.9 ELSE 1.0 END) * (1 - least(0.02 * coalesce(access_count, 0), 0.3))),
    CASE WHEN feedback_score > 1 THEN 0.8 WHEN feedback_score = 1 THEN 0.9 ELSE 1.0 END) * CASE WHEN type = 'insight' AND state = 'active' THEN 1.05 WHEN type = 'error' THEN 1.03 ELSE 1.0 END) ELSE salience END, 9) AS salience FROM memories"""
)
def decay_with_attributes(t):
    """Decay slowed by significance and raised by tone and outcome (here derived from feedback, type and state)."""
    m = t("memories").withColumns(
        {
            "significance": F.when(F.col("feedback_score") > 1, "critical").when(F.col("feedback_score") == 1, "important"),
            "emotional_tone": F.when(F.col("type") == "insight", "satisfying").when(F.col("type") == "error", "frustrating"),
            "outcome": F.when(F.col("state") == "active", "success"),
        }
    )
    return L.decay(m, AS_OF).select("id", F.round("salience", 9).alias("salience"))


@query(f"SELECT id, {_NEXT} AS state FROM memories")
def state_transition(t):
    return L.transition(t("memories")).select("id", "state")


@query("SELECT id FROM memories WHERE NOT coalesce(state = 'archived' AND created_at < {AS_OF} - INTERVAL 30 DAY, false)")
def expire_archived(t):
    return L.expire(t("memories"), AS_OF, L.Settings(expire_days=30)).select("id")


@query("SELECT id FROM memories WHERE state = 'active' AND source <> 'mcp' AND coalesce(access_count, 0) = 0 AND created_at <= {AS_OF} - INTERVAL 30 DAY")
def never_recalled(t):
    return L.never_recalled(t("memories"), AS_OF).select("id")


@query("SELECT id, salience FROM memories WHERE state = 'active' AND (last_accessed IS NULL OR last_accessed < {AS_OF} - INTERVAL 30 DAY)")
def dead_memories(t):
    return L.dead(t("memories"), AS_OF).select("id", "salience")


@query("SELECT id, round(CASE WHEN state = 'active' AND (last_accessed IS NULL OR last_accessed < {AS_OF} - INTERVAL 30 DAY) AND salience < 0.5 THEN salience * 0.8 ELSE salience END, 9) AS salience FROM memories")
def noise_demote(t):
    return L.demote_noise(t("memories"), AS_OF).select("id", F.round("salience", 9).alias("salience"))


def _patterns(t):
    """Merged memories as patterns: what they stand for is their evidence."""
    m = t("memories").filter(F.size("gist_of") > 0)
    return m.select("id", F.col("gist_of").alias("evidence_ids"), F.col("salience").alias("strength"), "state", "access_count", "created_at")


_RATIO = """pat AS (SELECT id, gist_of, salience AS strength, state, access_count, created_at FROM memories WHERE len(gist_of) > 0),
  ratio AS (SELECT p.id, count(*) AS n_evidence, avg(CASE WHEN m.state IN ('active', 'fading') THEN 1.0 ELSE 0.0 END) AS ratio
    FROM (SELECT id, unnest(gist_of) AS m FROM pat) p LEFT JOIN memories m ON m.id = p.m GROUP BY p.id)"""


@query(f"WITH {_RATIO} SELECT id, n_evidence, round(ratio, 6) AS ratio FROM ratio")
def abstraction_grounding(t):
    return L.evidence_ratio(_patterns(t), t("memories")).select("id", "n_evidence", F.round("ratio", 6).alias("ratio"))


@query(
    f"""WITH {_RATIO}, d AS (SELECT id, state, strength * CASE WHEN ratio >= 0.5 THEN 0.995 WHEN ratio >= 0.2 THEN 0.93 ELSE 0.85 END AS s FROM pat JOIN ratio USING (id))
    SELECT id, round(s, 9) AS strength, CASE WHEN state = 'active' AND s < 0.1 THEN 'fading' WHEN state = 'fading' AND s < 0.05 THEN 'archived' ELSE state END AS state FROM d"""
)
def pattern_decay(t):
    return L.decay_patterns(_patterns(t), t("memories")).select("id", F.round("strength", 9).alias("strength"), "state")


@query(
    f"""WITH {_RATIO} SELECT id, round(least(CASE WHEN n_evidence > 10 THEN 1.0 ELSE 0.95 END, strength + least(0.15, 0.03 * log2(1 + n_evidence) * CASE WHEN n_evidence >= 5 THEN 1.3 ELSE 1.0 END)), 9) AS strength
    FROM pat JOIN ratio USING (id)"""
)
def pattern_strengthen(t):
    p = _patterns(t).join(L.evidence_ratio(_patterns(t), t("memories")), "id")
    n = F.col("n_evidence")
    return p.select("id", F.round(L.strengthen_pattern(F.col("strength"), n, n, n), 9).alias("strength"))


@query(
    f"""WITH {_RATIO}, g AS (SELECT id, state, strength AS c, ratio, access_count > 5 AND ratio >= 0.1 AS skip, created_at > {{AS_OF}} - INTERVAL 7 DAY AS young,
      CASE WHEN ratio >= 0.5 THEN 1.0 WHEN ratio >= 0.3 THEN 0.9 WHEN ratio >= 0.1 THEN 0.7 ELSE 0.5 END AS f FROM pat JOIN ratio USING (id)),
    n AS (SELECT *, CASE WHEN skip THEN c WHEN young AND c >= 0.5 THEN greatest(0.5, c * f) ELSE c * f END AS new FROM g)
    SELECT id, round(new, 9) AS confidence, CASE WHEN NOT skip AND ratio < 0.1 AND state = 'active' AND new < 0.1 THEN 'fading' ELSE state END AS state FROM n"""
)
def abstraction_confidence(t):
    a = _patterns(t).withColumnRenamed("strength", "confidence")
    a = a.join(L.evidence_ratio(_patterns(t), t("memories")), "id")
    return L.ground(a, AS_OF).select("id", F.round("confidence", 9).alias("confidence"), "state")


@query(
    """SELECT id, CASE WHEN state IN ('active', 'fading') AND c < 0.001 THEN 'archived' WHEN state = 'active' AND c < 0.01 THEN 'fading' ELSE state END AS state
    FROM (SELECT id, state, pow(salience, 4) AS c FROM memories)"""
)
def zombie_abstractions(t):
    return L.zombies(t("memories").withColumn("confidence", F.pow("salience", F.lit(4.0)))).select("id", "state")


def _cycle_sql(n: int) -> str:
    parts, prev = [], "memories"
    for i in range(n):
        parts.append(f"d{i} AS (SELECT * REPLACE ({_decayed('salience')} AS salience) FROM {prev})")
        parts.append(f"s{i} AS (SELECT * REPLACE ({_NEXT} AS state) FROM d{i})")
        parts.append(f"e{i} AS (SELECT * FROM s{i} WHERE NOT coalesce(state = 'archived' AND created_at < {{AS_OF}} - INTERVAL 90 DAY, false))")
        parts.append(
            f"""m{i} AS (SELECT * REPLACE (CASE WHEN state = 'active' AND source <> 'mcp' AND coalesce(access_count, 0) = 0 AND created_at <= {{AS_OF}} - INTERVAL 30 DAY
            THEN 'archived' ELSE state END AS state) FROM e{i})"""
        )
        prev = f"m{i}"
    return f"WITH {', '.join(parts)} SELECT id, state, round(salience, 9) AS salience FROM {prev}"


@query(_cycle_sql(3))
def cycle_3(t):
    """Three maintenance cycles one after the other."""
    m, e = t("memories"), t("associations")
    for _ in range(3):
        m, e = L.cycle(m, e, AS_OF)
    return m.select("id", "state", F.round("salience", 9).alias("salience"))


@query(_cycle_sql(1).replace("SELECT id, state, round(salience, 9) AS salience FROM m0", """, alive AS (SELECT id FROM m0 WHERE state IN ('active', 'fading'))
    SELECT source_id, target_id FROM associations WHERE strength >= 0.05 AND source_id IN (SELECT id FROM alive) AND target_id IN (SELECT id FROM alive)"""))
def cycle_edges(t):
    return L.cycle(t("memories"), t("associations"), AS_OF)[1].select("source_id", "target_id")
