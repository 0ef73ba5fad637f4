import random

from pyspark.sql import functions as F

from cairnflow.operators import search


def test_best_documents_of_each_group_inside_tasks(spark, monkeypatch):
    monkeypatch.setattr(search, "DOC_PART", 40)
    monkeypatch.setattr(search, "TASK_QUERIES", 7)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(30)]
    docs = [(k, " ".join(rng.choices(words, k=rng.randrange(4)))) for k in range(150)] + [(900, None), (901, "")]
    queries = [(k, " ".join(rng.sample(words, 3))) for k in range(25)] + [(90, ""), (91, None), (92, "zzz")]
    d, q = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(queries, "q long, text string")
    g = spark.createDataFrame([(i, f"g{i * i % 4}") for i, _ in docs], "doc_id long, g string")
    every = search.bm25(d, "id", F.col("text"), q, "q", F.col("text"), None).collect()
    want, ranks = set(), {}
    for r in sorted(every, key=lambda r: (-r.score, r.doc_id)):
        key = r.query_id, f"g{r.doc_id * r.doc_id % 4}"
        ranks[key] = ranks.get(key, 0) + 1
        if ranks[key] <= 3:
            want.add((*key, r.doc_id, round(r.score, 8), ranks[key]))
    written, keep = [], search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, label: written.append(label) or keep(df, label))
    got = search.bm25(d, "id", F.col("text"), q, "q", F.col("text"), 3, g).collect()
    assert {(r.query_id, r.g, r.doc_id, round(r.score, 8), r["rank"]) for r in got} == want and len(got) == len(want) > 100
    assert "scored-documents" in written


def test_many_vector_queries_inside_tasks(spark, monkeypatch):
    rng = random.Random(8)
    vs = [(f"v{k:03}", [float(rng.randrange(-2, 3)) for _ in range(3 + k % 2)] if k % 9 else [None, [], [0.0] * 3][k // 9 % 3]) for k in range(200)]
    vs += [(f"w{k}", vs[1][1]) for k in range(9)]
    df = spark.createDataFrame(vs, "id string, v array<double>")
    plain = {own: sorted(map(tuple, search.vector_top_k(df, "id", "v", df, "id", "v", 4, exclude_self=own, least=0.2).select("query_id", "id", "score", "rank").collect())) for own in (True, False)}
    monkeypatch.setattr(search, "QUERY_BLOCK", 20)
    monkeypatch.setattr(search, "VECTOR_PART", 50)
    monkeypatch.setattr(search, "_TILE", 16)
    written, keep = [], search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, label: written.append(label) or keep(df, label))
    for own, want in plain.items():
        got = sorted(map(tuple, search.vector_top_k(df, "id", "v", df, "id", "v", 4, exclude_self=own, least=0.2).select("query_id", "id", "score", "rank").collect()))
        assert got == want and len(got) > 500
    assert "asked-vectors" in written
