import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cairnflow.operators import evaluation, retrieval
from cairnflow.plans import evaluation_queries as E
from cairnflow.plans.registry import AS_OF

T0 = dt.datetime(2026, 5, 1)


def _tables(spark):
    rnd, words = random.Random(11), "alpha beta gamma delta pepper relay viewer tracer".split()
    some = lambda n: " ".join(rnd.choices(words, k=n))
    memories = [
        (f"m{k:02}", some(3), some(6), rnd.sample(words, 2), rnd.choice([None, [1.0, 2.0]]), rnd.random(), rnd.choice(["active", "fading", "archived"]), rnd.choice(["mcp", "git", "clipboard"]), "insight", None, T0, None, 0, False)
        for k in range(40)
    ]
    kinds = "id string, summary string, content string, concepts array<string>, embedding array<double>, salience double, state string, source string, type string, project string, created_at timestamp_ntz, last_accessed timestamp_ntz, access_count long, recall_suppressed boolean"
    edges = [(f"m{a:02}", f"m{b:02}", 0.5 + rnd.random() / 2, rnd.choice(["caused_by", "similar"]), rnd.randrange(4)) for a in range(40) for b in rnd.sample(range(40), 2) if a != b]
    asked = [(f"q{k:02}", some(2) if k % 7 else None, [f"m{x:02}" for x in rnd.sample(range(40), 3)] if k % 5 else [], ["helpful", "irrelevant", None][k % 3]) for k in range(30)]
    tables = {
        "memories": spark.createDataFrame(memories, kinds),
        "associations": spark.createDataFrame(edges, "source_id string, target_id string, strength double, relation_type string, activation_count long"),
        "retrieval_feedback": spark.createDataFrame(asked, "query_id string, query_text string, retrieved_memory_ids array<string>, feedback string"),
    }
    return tables.__getitem__, {q for q, _, ids, f in asked if f == "helpful" and ids}


def test_eval_full_answers_what_is_scored(spark, monkeypatch):
    t, scored = _tables(spark)
    every = retrieval.retrieve(t("memories"), t("associations"), t("retrieval_feedback"), E._queries(t), AS_OF)
    want = sorted(map(tuple, evaluation.query_scores(every, E._expected(t)).collect()))
    asked, keep = [], retrieval.candidates
    monkeypatch.setattr(retrieval, "candidates", lambda m, q, *rest: asked.append((m, q)) or keep(m, q, *rest))
    got = sorted(map(tuple, E.eval_full(t).collect()))
    assert got == want and {r[0] for r in got} == scored and any(r[1] > 0 for r in got)
    (known, queries), = asked
    assert {r.query_id for r in queries.collect()} == scored  # 8 of 30
    assert known["vectors"].inputFiles()  # written once


def test_sweep_finds_candidates_once(spark, monkeypatch):
    t, scored = _tables(spark)
    names = ["ndcg", "precision", "mrr"]

    def means(s):
        every = retrieval.retrieve(t("memories"), t("associations"), t("retrieval_feedback"), E._queries(t), AS_OF, s)
        return evaluation.query_scores(every, E._expected(t)).agg(*[F.avg(c) for c in names]).first()

    base = means(retrieval.Settings())
    monkeypatch.setattr(E, "SWEEP", {"hops": (0, 1), "alpha": (0.1,), "decay": (0.2,), "threshold": (0.6,), "text_limit": (2,)})
    want = {(name, float(v)): [round(x - y, 6) for x, y in zip(means(retrieval.Settings(**{name: v})), base)] for name, vs in E.SWEEP.items() for v in vs}
    asked, keep = [], retrieval.candidates
    monkeypatch.setattr(retrieval, "candidates", lambda m, q, *rest: asked.append(q.count()) or keep(m, q, *rest))
    got = E.parameter_sweep(t).collect()
    assert {(r.parameter, r.value): pytest.approx([r[c] for c in names], abs=2e-6) for r in got} == want
    assert len({tuple(x) for x in want.values()}) > 3
    assert all(r.noise_suppression == r.signal_retention == 0 and r.composite == pytest.approx(0.3 * r.ndcg + 0.2 * r.precision + 0.2 * r.mrr, abs=2e-6) for r in got)
    assert asked == [len(scored)] * 2  # the defaults' and the shorter list's
