"""Keys and clocks of event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column, without any zone shift for zoneless ones."""
    if dict(df.dtypes)[name] == "timestamp":
        return F.unix_micros(F.col(name))
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")


def from_micros(name: str) -> Column:
    """Zoneless timestamp of a microsecond column."""
    return F.expr(f"timestampadd(MICROSECOND, `{name}`, TIMESTAMP_NTZ'1970-01-01 00:00:00')")


def folded(name: str) -> Column:
    """Trimmed (any white space) and lower-cased text; null stays null."""
    return F.lower(F.regexp_replace(F.col(name), r"(?U)^\s+|\s+$", ""))


def stream_keys(df: DataFrame) -> DataFrame:
    """Adds ``stream_project`` (null and empty are one) and ``stream_source`` (folded)."""
    return df.withColumns(
        {
            "stream_project": F.coalesce(F.col("project"), F.lit("")),
            "stream_source": folded("source"),
        }
    )
