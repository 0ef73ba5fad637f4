import random

from pyspark.sql import functions as F

from cairnflow.operators import search


def test_concept_search_joins_heads_only(spark, monkeypatch):
    rnd, rows = random.Random(3), []
    for k in range(300):
        rows.append((f"m{k:03}", rnd.choice([None, 0.5, round(rnd.random(), 1)]), [rnd.choice("ABCabc") for _ in range(rnd.randrange(4))]))
    asked = [("q0", ["a"]), ("q1", ["b", "A", "a"]), ("q2", ["c", "zz", "b"]), ("q3", [])]
    written = []
    keep = search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, label: written.append((label, out := keep(df, label))) or out)
    m, q = spark.createDataFrame(rows, "id string, salience double, concepts array<string>"), spark.createDataFrame(asked, "q string, cs array<string>")
    got = search.concept_search(m, q, "q", "cs", 4).collect()
    want = []
    for name, cs in asked:
        hits = [(-s if s is not None else 2, i, s, n) for i, s, own in rows if (n := len({c.lower() for c in cs} & {c.lower() for c in own}))]
        want += [(name, i, s, n, r + 1) for r, (_, i, s, n) in enumerate(sorted(hits)[:4])]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(got) == 12
    heads = dict(written)["concept-heads"]
    assert heads.groupBy("c").count().agg(F.max("count")).first()[0] == 4  # k of each concept, not all that hold it
