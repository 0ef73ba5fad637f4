"""python -m tests.oracle [NAME...]: runs queries against their SQL at sf0.01 and reports differences."""

import os
import sys
import time

import duckdb
import pandas as pd

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "raw_memories memories associations retrieval_feedback eval_items"
).split()


def canon(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]

    def one(v):
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and not isinstance(v, (int, float)):
            v = v.tolist() if hasattr(v, "tolist") else list(v)
            return str([one(x) for x in v]) if isinstance(v, list) else one(v)
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return f"{v:.6g}" if v else "0"
        if isinstance(v, int):
            return f"{float(v):.6g}" if abs(v) < 10**6 else str(v)
        if isinstance(v, pd.Timestamp):
            return v.isoformat()
        return str(v)

    return sorted("|".join(one(v) for v in row) for row in df.itertuples(index=False, name=None))


def compare(spark, name: str, f, sql: str | None, con=None) -> str:
    began = time.time()
    got = f(spark, SF).toPandas()
    took = time.time() - began
    if sql is None:
        return f"rows-only {len(got)} rows {took:.1f} s"
    want = con.execute(sql).fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return f"MISMATCH columns {sorted(got.columns)} / {sorted(want.columns)}"
    a, b = canon(got), canon(want)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        return f"MISMATCH rows {len(a)} / {len(b)}; spark {only_a[:2]}; sql {only_b[:2]}"
    return f"ok {len(a)} rows {took:.1f} s" + " EMPTY" * (not a)


def connect():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def main(names: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(), 0
    qs, sql = e.queries(), e.oracle_sql()
    for n in [q for q in qs if not names or q in names or any(x.endswith("*") and q.startswith(x[:-1]) for x in names)]:
        try:
            r = compare(spark, n, qs[n], sql.get(n), con)
        except Exception as x:  # noqa: BLE001
            r = "ERROR " + " ".join(str(x).split())[:400]
        bad += not r.startswith(("ok", "rows-only"))
        print(f"{n}: {r}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
