import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnflow.operators import chunks, clusters, graph, lifecycle, patterns

T0 = dt.datetime(2024, 6, 1)
AS_OF = "2024-06-01 00:00:00"
MEMORY = (
    "id string, raw_id string, timestamp timestamp_ntz, type string, content string, summary string, concepts array<string>, embedding array<float>, salience double, "
    "access_count long, last_accessed timestamp_ntz, state string, gist_of array<string>, created_at timestamp_ntz, updated_at timestamp_ntz, source string, project string, "
    "session_id string, feedback_score long, recall_suppressed boolean"
)
EDGE = "source_id string, target_id string, strength double, relation_type string, created_at timestamp_ntz, last_activated timestamp_ntz, activation_count long"


def memory(id_, v=None, days=1, **over):
    at = T0 - dt.timedelta(days=days)
    row = dict(
        id=id_, raw_id=f"r-{id_}", timestamp=at, type="general", content=f"content of {id_}", summary=f"summary {id_}", concepts=["Alpha", "beta", None], embedding=v, salience=0.6,
        access_count=0, last_accessed=None, state="active", gist_of=None, created_at=at, updated_at=at, source="mcp", project="p", session_id=None, feedback_score=0, recall_suppressed=False,
    )
    return tuple((row | over).values())


def vector(k, n=128, noise=0.0, seed=0):
    v = np.zeros(n)
    v[k] = 1
    return [float(x) for x in v + noise * np.random.default_rng(seed).standard_normal(n)]


def edge(a, b, s=0.5, kind="similar"):
    return (a, b, s, kind, T0, None, 1)


def test_gists(spark):
    rows = [
        memory("a", vector(0), 3, project="x", salience=0.9), memory("b", vector(1), 2, project="y", summary=" ", content="c" * 120, concepts=["beta", "gamma"]),
        memory("c", [0.0] * 128, 4, project="", concepts=None), memory("d", None, 5, project="y"),
    ]
    m = spark.createDataFrame(rows, MEMORY).withColumn("extra", F.lit(1))
    members = spark.createDataFrame([("k", i) for i in "abcda"] + [("k", "gone"), ("none", "gone")], "cluster string, id string")
    (g,) = patterns.gists(members, m).collect()
    assert (g.n_sources, g.salience, g.project, g.raw_id) == (4, 0.9, "y", "r-b")
    assert g.summary == "c" * 100 + "..." and g.concepts == ["beta", "alpha", "gamma"]
    assert g.v[:3] == pytest.approx([0.25, 0.25, 0]) and len(g.v) == 128  # the sum of the usable over all members
    assert patterns.gists(members.limit(0), m).count() == 0


def test_merge(spark):
    m = spark.createDataFrame([memory("a", vector(0)), memory("b", vector(0)), memory("c", vector(1))], MEMORY)
    e = spark.createDataFrame([edge("a", "b"), edge("b", "c", 0.7), edge("c", "a", 0.3)], EDGE)
    members = spark.createDataFrame([("a", "a"), ("a", "b")], "cluster string, id string")
    after, edges, mapping = patterns.merge(m, e, members, AS_OF)
    by = {r.id: r for r in after.collect()}
    assert by["a"].state == by["b"].state == "merged" and by["c"].state == "active"
    assert by["gist-a"].state == "active" and by["gist-a"].source == "consolidation" and len(by["gist-a"].embedding) == 128
    assert {(r.source_id, r.target_id) for r in edges.collect()} == {("gist-a", "c"), ("c", "gist-a")} and mapping.count() == 2


def test_duplicates_against_a_loop(spark):
    rng = random.Random(4)
    words = "amber stone river cloud meadow harbor".split()
    rows = [(f"p{k:02d}", " ".join(rng.choices(words, k=rng.choice((3, 6)))), vector(rng.randrange(4), 8, 0.2, k), rng.random(), "active") for k in range(40)]
    rows += [("pnull", None, None, 0.01, "active"), ("pcopy", rows[0][1], rows[0][2], rows[0][3], "active")]
    p = spark.createDataFrame(rows, "id string, title string, v array<double>, strength double, state string")
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) if a and b else 0.0

    def near(x, y):
        a, b = set((x[1] or "").split()), set((y[1] or "").split())
        jac = len(a & b) / len(a | b) if a | b else 1.0
        short = len((x[1] or "").split()) <= 4 or len((y[1] or "").split()) <= 4
        return (jac >= 0.5 and cos(x[2], y[2]) >= 0.75) if short else (jac >= 0.5 or cos(x[2], y[2]) >= 0.75)

    order, want = sorted(rows, key=lambda r: (-r[3], r[0])), {}
    for i, r in enumerate(order):
        if r[0] not in want:
            want[r[0]] = r[0]
            want |= {o[0]: r[0] for o in order[i + 1 :] if o[0] not in want and near(r, o)}
    found = patterns.duplicates(p.withColumn("s", F.lit(1)), ["s"], F.col("strength"), 0.5, 0.75)
    assert {r.id: r.leader for r in found.collect()} == want and len(set(want.values())) < len(rows) - 5
    evidence = spark.createDataFrame([(r[0], f"m{k % 7}") for k, r in enumerate(rows)], "pattern_id string, memory_id string")
    after, moved = patterns.fold_duplicates(p, evidence, found)
    assert all((r.state == "active") == (want[r.id] == r.id) for r in after.collect())
    assert {(r.pattern_id, r.memory_id) for r in moved.collect()} == {(want[r[0]], f"m{k % 7}") for k, r in enumerate(rows)}


def test_first_similar_and_pairs(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 3)
    heads = [(f"h{k}", f"title number {k}", vector(k % 5, 8), T0 - dt.timedelta(days=k)) for k in range(10)]
    rows = [("x", "title number 9", vector(0, 8)), ("y", "nothing", vector(4, 8)), ("z", "nothing", None), ("w", None, vector(7, 8))]
    h = spark.createDataFrame(heads, "id string, title string, v array<double>, created_at timestamp_ntz")
    r = spark.createDataFrame(rows, "id string, title string, v array<double>")
    assert {x.id: x.match for x in patterns.first_similar(r, h).collect()} == {"x": "h9", "y": "h9"}
    assert patterns.first_similar(r.limit(0), h).count() == 0 and patterns.first_similar(r, h.limit(0)).count() == 0
    vs = [(f"v{k}", vector(k % 3, 8, 0.05, k // 6)) for k in range(18)] + [("bad", [0.0] * 8), ("none", None)]
    pairs, members = clusters.cosine_pairs(spark.createDataFrame(vs, "id string, v array<double>"), 0.95)
    rep = {m.id: m.representative for m in members.collect()}
    assert len(rep) == 18 and rep["v3"] == "v0"
    got = {(x.a, x.b) for x in pairs.collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vs if v and any(v)}
    want = {(a, b) for a in set(rep.values()) for b in set(rep.values()) if a < b and unit[a] @ unit[b] >= 0.95}
    assert got == want and want


def test_links(spark):
    meta = [
        ("a", '{"associations": [{"memory_id": "b", "relation": "caused_by"}, {"memory_id": "b", "relation": "caused_by"}, {"memory_id": "", "relation": "x"}, {"memory_id": "c"}]}'),
        ("b", "{}"), ("c", "{broken"), ("d", None),
    ]
    got = graph.explicit_edges(spark.createDataFrame(meta, "id string, metadata string"), "id", "metadata").collect()
    assert [(r.source_id, r.target_id, r.strength, r.relation_type, r.activation_count) for r in got] == [("a", "b", 0.9, "caused_by", 1)]
    e = spark.createDataFrame([edge("a", "b", 0.98), edge("b", "a", 0.2), edge("b", "c", 0.05)], EDGE)
    changed = graph.set_strength(e, spark.createDataFrame([("b", "a", 0.4), ("a", "b", 0.3)], "a string, b string, strength double"))
    assert sorted(r.strength for r in changed.collect()) == [0.05, 0.4, 0.4]
    m = spark.createDataFrame([memory("a", salience=0.99), memory("b", salience=0.055)], MEMORY)
    good, bad = spark.createDataFrame([("a",), ("a",)], "id string"), spark.createDataFrame([("b",), ("zz",)], "id string")
    after, edges = graph.adjust(m, e, good, bad)
    assert {r.id: r.salience for r in after.collect()} == {"a": 1.0, "b": 0.05}
    assert {(r.source_id, r.target_id): round(r.strength, 6) for r in edges.collect()} == {("a", "b"): 0.95, ("b", "a"): round(0.2 * 1.05**2 * 0.95, 6), ("b", "c"): 0.05}
    act = graph.activate(e, spark.createDataFrame([("a", "b"), ("a", "b")], "source_id string, target_id string"), AS_OF)
    assert {(r.source_id, r.target_id): r.activation_count for r in act.collect()} == {("a", "b"): 3, ("b", "a"): 1, ("b", "c"): 1}


def test_evidence_needs_a_shared_concept(spark):
    p = spark.createDataFrame([("p1", vector(0), ["alpha"], 0.99), ("p2", vector(0), ["other"], 0.5)], "id string, v array<double>, concepts array<string>, strength double")
    m = spark.createDataFrame([("m1", vector(0), ["ALPHA"]), ("m2", vector(0), None), ("m3", None, ["alpha"]), ("m4", vector(0), ["alpha"])], "id string, v array<double>, concepts array<string>")
    old = spark.createDataFrame([("p1", "m4")], "pattern_id string, memory_id string")
    new, after = patterns.link_evidence(m, p, old)
    assert [(r.pattern_id, r.memory_id) for r in new.collect()] == [("p1", "m1")]
    assert {r.id: round(r.strength, 9) for r in after.collect()} == {"p1": 1.0, "p2": 0.5}
    assert {r.id: r.passed for r in patterns.self_test(p, old, m).collect()} == {"p1": True}


def test_full_cycle(spark):
    rows = [memory(f"m{k}", vector(0, noise=0.001, seed=k), k) for k in range(4)] + [memory("idle", vector(9), 60, source="git"), memory("old", vector(7), 400, state="archived"), memory("low", vector(5), 1, salience=0.05)]
    m = spark.createDataFrame(rows, MEMORY)
    e = spark.createDataFrame([edge("m0", "m1"), edge("m0", "idle", 0.01), edge("m0", "gone")], EDGE)
    p = spark.createDataFrame([("p", "a title of five words", vector(3), ["x"], "p", 0.08, "active"), ("q", "a title of five words", vector(3), ["x"], "p", 0.9, "active")], "id string, title string, v array<double>, concepts array<string>, project string, strength double, state string")
    ev = spark.createDataFrame([("p", "m0"), ("q", "gone")], "pattern_id string, memory_id string")
    a = spark.createDataFrame([("x", "same old title of it", vector(1), 2, 0.5, "active", T0), ("y", "same old title of it", vector(1), 2, 0.0001, "active", T0 - dt.timedelta(days=1))], "id string, title string, v array<double>, level int, confidence double, state string, created_at timestamp_ntz")
    f = spark.createDataFrame([("q1", T0 - dt.timedelta(days=40)), ("q2", T0), ("q3", None)], "query_id string, created_at timestamp_ntz")
    out = lifecycle.full_cycle(m, e, p, ev, a, f, AS_OF)
    state = {r.id: r.state for r in out["memories"].collect()}
    assert {state[f"m{k}"] for k in range(4)} == {"merged"} and state["gist-m0"] == "active" and state["idle"] == "archived" and "old" not in state and state["low"] == "archived"
    assert {r.id: r.state for r in out["abstractions"].collect()} == {"x": "archived", "y": "archived"}
    assert {r.id: r.state for r in out["patterns"].filter("id IN ('p', 'q')").collect()} == {"p": "fading", "q": "active"}
    record = {r.step: r.n for r in out["record"].collect()}
    assert record["merged"] == 4 and record["expired"] == 1 and record["never_recalled"] == 1 and record["feedback_pruned"] == 1 and record["edges_pruned"] == 2 and len(record) == 10
    assert out["edges"].count() == 0 and out["feedback"].count() == 2  # the only edge lay inside the cluster


def test_chunks_against_plain_windows(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small data, many chunks
    try:
        _chunks_against_plain_windows(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _chunks_against_plain_windows(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(60), k, rng.choice([None, k])) for k in range(500)]
    df = spark.createDataFrame(rows, "key string, at int, id int, v int").repartition(3)
    parts = chunks.chunked(df, ["key"], ["at", "id"])
    assert parts.select("_p").distinct().count() > 1
    order = sorted(rows, key=lambda r: (r[0] or "", r[1], r[2]))
    want, last, before, n = {}, {}, {}, {}
    for key, _, i, v in order:
        n[key] = n.get(key, 0) + 1
        last[key] = v if v is not None else last.get(key)
        want[i] = (before.get(key, "none"), last[key], n[key])
        before[key] = v
    out = chunks.numbered(chunks.carried(chunks.lagged(parts, ["key"], ["at", "id"], "v", "l"), ["key"], ["at", "id"], "v", "c"), ["key"], ["at", "id"], "n")
    assert {r.id: ("none" if r.l is None else r.l.x, r.c, r.n) for r in out.collect()} == want
    values = sorted(r[1] for r in rows if r[0] == "hot")
    got = {r.key: r["at"] for r in chunks.nth(df, ["key"], "at", 0.95).collect()}
    assert got["hot"] == values[int(0.95 * len(values))] and len(got) == 3
    assert chunks.nth(df.limit(0), ["key"], "at", 0.5).count() == 0
