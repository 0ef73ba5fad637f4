"""Time ranges meant by a query text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: the expressions of time that are understood (further ones in ``time_range``)
_N = r"(?i)\b(?:last|past)\s+(\d+)\s+(minute|hour|day|week|month)s?\b"
_ONE = r"(?i)\b(?:last|past)\s+(hour|day|week|month)\b"


def _seconds(unit: Column) -> Column:
    u = F.lower(unit)
    out = F.when(u == "minute", 60).when(u == "hour", 3600).when(u == "day", 86400)
    return out.when(u == "week", 7 * 86400).when(u == "month", 30 * 86400)


def time_range(queries: DataFrame, text: str, now: Column) -> DataFrame:
    """Adds ``range_from, range_to, detected``; the most specific expression wins.

    A month is 30 days, a week starts on Monday.  Without an expression of time both ends are
    null and ``detected`` is false.
    """
    q = F.coalesce(F.col(text), F.lit(""))
    n, unit = F.regexp_extract(q, _N, 1), F.regexp_extract(q, _N, 2)
    one = F.regexp_extract(q, _ONE, 1)
    back = lambda s: F.timestamp_add("SECOND", -s, now)
    day = F.date_trunc("DAY", now).cast("timestamp_ntz")
    rows = [
        ((n != "") & (n.try_cast("int") > 0), back(n.try_cast("int") * _seconds(unit)), now),
        (one != "", back(_seconds(one)), now),
        (q.rlike(r"(?i)\btoday\b"), day, now),
        (q.rlike(r"(?i)\byesterday\b"), F.timestamp_add("DAY", F.lit(-1), day), day),
        (q.rlike(r"(?i)\bthis\s+week\b"), F.date_trunc("WEEK", now).cast("timestamp_ntz"), now),
        (q.rlike(r"(?i)\bthis\s+month\b"), F.date_trunc("MONTH", now).cast("timestamp_ntz"), now),
        (q.rlike(r"(?i)\brecent(?:ly)?\b"), F.timestamp_add("HOUR", F.lit(-24), now), now),
    ]
    start = end = None
    for test, a, b in rows:
        start = F.when(test, a) if start is None else start.when(test, a)
        end = F.when(test, b) if end is None else end.when(test, b)
    return queries.withColumns({"range_from": start, "range_to": end}).withColumn(
        "detected", F.col("range_from").isNotNull()
    )
