"""Queries of the general training-data problems."""

from __future__ import annotations

from cairnflow.operators.sessions import stream_sessions
from cairnflow.sources.tables import table


def p4_sessions(spark, sf_dir):
    return stream_sessions(table(spark, sf_dir, "raw_memories"))


def p4_found(spark, sf_dir):
    return p4_sessions(spark, sf_dir).select("first_id", "last_id")


QUERIES = {"p4_found": p4_found, "p4_sessions": p4_sessions}

_P4 = """
WITH obs AS (
  SELECT DISTINCT id, timestamp AS ts, coalesce(project, '') AS stream_project,
         lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) AS stream_source
  FROM raw_memories WHERE id IS NOT NULL AND timestamp IS NOT NULL),
gaps AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS cut FROM obs
  WINDOW w AS (PARTITION BY stream_project, stream_source ORDER BY ts, id)),
numbered AS (
  SELECT *, sum(cut) OVER (PARTITION BY stream_project, stream_source ORDER BY ts, id
                           ROWS UNBOUNDED PRECEDING) AS session FROM gaps),
done AS (
  SELECT stream_project, stream_source, first(id ORDER BY ts, id) AS first_id, last(id ORDER BY ts, id) AS last_id,
         min(ts) AS start_ts, max(ts) AS end_ts, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS duration_us,
         count(*) AS n_events
  FROM numbered GROUP BY stream_project, stream_source, session)
"""

SQL = {
    "p4_found": _P4 + "SELECT first_id, last_id FROM done",
    "p4_sessions": _P4 + "SELECT * FROM done",
}
