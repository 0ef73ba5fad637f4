import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairnflow.operators import clusters, corpus, evaluation, events, graph, lifecycle, retrieval, search, store

AS_OF = "2024-06-01 00:00:00"
T0 = dt.datetime(2024, 6, 1)


def test_spread_activation(spark):
    edges = spark.createDataFrame(
        [("m1", "m2", 0.8, "similar", 3), ("m1", "m3", 0.6, "caused_by", 1)], "source_id string, target_id string, strength double, relation_type string, activation_count long"
    )
    start = spark.createDataFrame([("q", "m1", 1.0)], "q string, id string, activation double")
    got = {r.id: (round(r.activation, 9), r.hop) for r in graph.spread_activation(start, edges, ["q"], 1).collect()}
    assert got == {"m1": (1.0, None), "m2": (0.56, 0), "m3": (0.504, 0)}
    chain = spark.createDataFrame(
        [(f"m{k}", f"m{k + 1}", 0.9, "similar", 0) for k in (1, 2, 3)], "source_id string, target_id string, strength double, relation_type string, activation_count long"
    )
    got = {r.id: r.activation for r in graph.spread_activation(start, chain, ["q"], 3, threshold=0.01).collect()}
    m2 = 0.9 * 0.7
    m3 = m2 * 0.9 * 0.7**2
    assert got == pytest.approx({"m1": 1.0, "m2": m2, "m3": m3, "m4": m3 * 0.9 * 0.7**3})
    assert graph.spread_activation(start.limit(0), chain, ["q"]).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(200) if k % 37] + [(f"n{rng.randrange(200):03d}", f"x{k}") for k in range(20)] + [("a", "a")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    groups = {}
    for x in {v for p in links for v in p} - {"a"}:
        groups.setdefault(find(x), set()).add(x)
    want = {x: min(g) for g in groups.values() for x in g}
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == want


def test_merge_and_feedback(spark):
    text = spark.createDataFrame([("q", "m1", 1, 0.9), ("q", "m2", 2, 0.6)], "query_id string, id string, rank int, salience double")
    text = text.withColumn("text_score", retrieval.text_score(F.col("rank"), F.col("salience")))
    vec = spark.createDataFrame([("q", "m3", 0.85), ("q", "m1", 0.5)], "query_id string, id string, score double")
    got = {r.id: r.activation for r in retrieval.merge_entry_points(text, vec, ["query_id"]).collect()}
    assert got == pytest.approx({"m1": 0.6 * 0.5 + 0.4 * 0.97 + 0.15, "m2": 0.53, "m3": 0.85})
    fb = spark.createDataFrame(
        [("q1", ["m1", "m2", "m3"], "helpful"), ("q2", ["m1", "m3"], "irrelevant"), ("q3", ["m2"], "partial"), ("q4", ["m1", "m2"], None), ("q5", None, "helpful")],
        "query_id string, retrieved_memory_ids array<string>, feedback string",
    )
    assert {r.id: r.feedback_mean for r in retrieval.feedback_scores(fb).collect()} == {"m1": 0.0, "m2": 0.5, "m3": 0.0}


def test_decay_and_transition(spark):
    rows = [("a", 0.8, 0, T0 - dt.timedelta(hours=200), T0, "active"), ("b", 0.8, 0, T0 - dt.timedelta(hours=2), T0, "active"), ("c", 0.2, 0, None, T0, "active"), ("d", 0.05, 0, None, T0, "fading"), ("e", 0.05, 0, None, T0, "merged")]
    m = spark.createDataFrame(rows, "id string, salience double, access_count long, last_accessed timestamp_ntz, created_at timestamp_ntz, state string")
    got = {r.id: r.salience for r in lifecycle.decay(m, AS_OF).collect()}
    assert got["a"] == pytest.approx(0.76) and got["b"] == pytest.approx(0.8 * 0.95**0.8) and got["e"] == 0.05
    assert {r.id: r.state for r in lifecycle.transition(m).collect()} == {"a": "active", "b": "active", "c": "fading", "d": "archived", "e": "merged"}


def test_post_filter_always_applies_suppression(spark):
    m = spark.createDataFrame([("a", True, ["X"]), ("b", False, ["y"]), ("c", None, None)], "id string, recall_suppressed boolean, concepts array<string>")
    assert {r.id for r in retrieval.post_filter(m).collect()} == {"b", "c"}
    assert {r.id for r in retrieval.post_filter(m, strict_reference=True).collect()} == {"a", "b", "c"}
    assert {r.id for r in retrieval.post_filter(m, with_suppressed=True, without_concepts=("x",)).collect()} == {"b", "c"}


def test_diversity(spark):
    rows = [("q", "a", 1.0, [1.0, 0.0]), ("q", "b", 0.9, [1.0, 0.01]), ("q", "c", 0.5, [0.0, 1.0]), ("q", "d", 0.4, None)]
    got = retrieval.diversify(spark.createDataFrame(rows, "query_id string, id string, score double, v array<double>"), ["query_id"]).orderBy("place").collect()
    assert [r.id for r in got] == ["a", "c", "d"]


def test_leader_clusters_against_a_loop(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((5, 8))
    rows = [(f"m{k:02d}", "p", (base[k % 5] + 0.25 * rng.standard_normal(8)).tolist(), T0 - dt.timedelta(minutes=k), ["c"]) for k in range(40)]
    df = spark.createDataFrame(rows, "id string, project string, v array<double>, created_at timestamp_ntz, concepts array<string>")
    used, want = set(), {}
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    for i, r in enumerate(rows):
        if i in used:
            continue
        group = [i] + [j for j in range(i + 1, 40) if j not in used and cos(r[2], rows[j][2]) >= 0.85]
        used |= set(group)
        if len(group) >= 3:
            want |= {rows[j][0]: r[0] for j in group}
    assert {r.id: r.leader for r in clusters.by_vector(df, ["project"]).collect()} == want and want
    assert clusters.by_time(df, ["project"]).count() == 40
    assert clusters.by_concepts(df.limit(0), ["project"]).count() == 0


def test_clusters_use_every_row_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 64)  # several rounds
    rng = np.random.default_rng(6)
    base = rng.standard_normal((40, 8))
    names = [f"c{k}" for k in range(30)]
    rows = [
        (f"m{k:03d}", "pq"[k % 7 == 0], (base[k % 40] + 0.3 * rng.standard_normal(8)).tolist() if k % 11 else None,
         T0 - dt.timedelta(minutes=int(rng.integers(0, 6000))), [str(x).upper() if k % 2 else str(x) for x in rng.choice(names, 3, False)])
        for k in range(400)
    ]
    df = spark.createDataFrame(rows, "id string, project string, v array<double>, created_at timestamp_ntz, concepts array<string>")

    def cos(a, b):
        return 0.0 if a is None or b is None else np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)

    def shared(a, b):
        return len({x.lower() for x in a[4]} & {x.lower() for x in b[4]})

    def loop(absorbs):
        used, want = set(), {}
        for p in "pq":
            own = sorted((r for r in rows if r[1] == p), key=lambda r: (T0 - r[3], r[0]))
            for i, r in enumerate(own):
                if r[0] in used:
                    continue
                group = [r]
                for x in own[i + 1 :]:
                    if x[0] not in used and absorbs(r, x, group[-1]):
                        used.add(x[0])
                        group.append(x)
                if len(group) >= 3:
                    want |= {x[0]: r[0] for x in group}
        return want

    def near(r, x, last):
        return shared(r, x) >= 1 and last[3] - x[3] <= dt.timedelta(hours=2) and r[3] - x[3] <= dt.timedelta(hours=6)

    rules = [
        (clusters.by_vector, lambda r, x, last: cos(r[2], x[2]) >= 0.85),
        (clusters.by_concepts, lambda r, x, last: shared(r, x) >= 2 or shared(r, x) == 1 and cos(r[2], x[2]) >= 0.6),
        (clusters.by_time, near),
    ]
    for f, rule in rules:
        want = loop(rule)
        assert {r.id: r.leader for r in f(df, ["project"]).collect()} == want and len(want) > 100


def test_event_windows(spark):
    rows = [("u", T0 + dt.timedelta(minutes=m), k) for k, m in enumerate((0, 4, 10, 11, 30, 30))] + [("v", None, 9)]
    df = spark.createDataFrame(rows, "u string, ts timestamp_ntz, id int")
    got = events.anchored_windows(df, ["u"], "ts", "id", 10).orderBy("episode").collect()
    assert [(r.episode, r.n_events, r.first_id) for r in got] == [(0, 3, "0"), (1, 1, "3"), (2, 2, "4")]
    kept = events.accepted_events(df.filter("ts IS NOT NULL"), ["u"], "ts", "id", 2, 10).collect()
    assert sorted(r.id for r in kept) == [0, 1, 2, 4, 5]
    rejected = [("fs", "venv/lib/x.py"), ("fs", "a/node_modules/b.js"), ("fs", "p/__pycache__/c.pyc"), ("fs", "p/site-packages/error.py"), ("fs", ".mypy_cache/decision.json")]
    df = spark.createDataFrame([("filesystem", None, p, "important decision about an error and a bug") for _, p in rejected] + [("mcp", "insight", None, None)], "source string, type string, path string, content string")
    assert [(r.score, r.passed) for r in events.heuristic_filter(df).collect()] == [(0.0, False)] * 6


def test_quality_gate(spark):
    ok = '{"gist":"%s","summary":"s","content":"c","narrative":"a narrative of some length","concepts":["go"],"structured_concepts":{},"significance":"routine","emotional_tone":"neutral","outcome":"success","salience":0.5}'
    rows = [("not json",), ('{"gist": "x"}',), (ok % ("g" * 61),), (ok % "fine",), (ok.replace("0.5", '"high"') % "x",), (None,), (ok % "Observation",)]
    got = [r.failures for r in corpus.gate(spark.createDataFrame(rows, "response string").coalesce(1), "response").collect()]
    assert got[0] == got[5] == ["json_parse_failure"] and got[1][0] == "missing_field:summary" and len(got[1]) == 9
    assert got[2] == ["gist_too_long:61"] and got[3] == [] and got[4] == ["salience_not_number"] and got[6] == ["placeholder_gist"]


def test_cleaners(spark):
    df = spark.createDataFrame([("papers_x", "A \\textbf{b} \\cite{k}$x$ (Figure 3)\r\n\r\n\r\n\r\nbody " * 12 + "\n References \n[1] gone"), ("code_x", "a = 1   \nb\t\n" + "c" * 100), ("mail_x", "x &amp;lt; <code>y</code> <b>z</b>" + "w" * 120), ("web_x", "ﬁne ½ " * 30), ("web_y", "short"), ("web_z", None)], "source string, text string")
    got = {r.source: r.text for r in corpus.clean_documents(df).collect()}
    assert set(got) == {"papers_x", "code_x", "mail_x", "web_x"}
    assert "gone" not in got["papers_x"] and "\\" not in got["papers_x"] and "Figure" not in got["papers_x"] and "\n\n\n" not in got["papers_x"]
    assert got["code_x"].startswith("a = 1\nb\nc") and got["mail_x"].startswith("x < `y` z") and got["web_x"].startswith("fine 1⁄2")


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, id string, rank int")
    expected = spark.createDataFrame([("q", "b"), ("q", "z"), ("r", "a")], "query_id string, id string")
    got = {r.query_id: r for r in evaluation.query_scores(ranked, expected).collect()}
    assert (got["q"].precision, got["q"].recall, got["q"].mrr) == (0.2, 0.5, 0.5)
    assert got["q"].ndcg == pytest.approx((1 / np.log2(3)) / (1 + 1 / np.log2(3)), abs=1e-5) and got["q"].ndcg_retrieved == pytest.approx(1 / np.log2(3), abs=1e-5)
    assert got["r"].ndcg == got["r"].ndcg_retrieved == 0


def test_vector_search(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 6))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(97, None), (98, []), (99, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id int, v array<double>").repartition(3)
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = n @ n.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(60) for j in np.argsort(-s[i])[:4]}
    for block in (4096, 7):
        search.QUERY_BLOCK, old = block, search.QUERY_BLOCK
        got = search.vector_top_k(df, "id", "v", df, "id", "v", 4, exclude_self=True).collect()
        search.QUERY_BLOCK = old
        assert {(r.query_id, r.id) for r in got} == want


def test_store(spark):
    snap = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2), ("c", 3), (None, 4)], "id string, v int")
    assert {tuple(r) for r in store.insert_ignore(snap, new, ["id"]).collect()} == {("a", 1), ("b", 1), ("c", 2), (None, 4)}
    assert {tuple(r) for r in store.upsert_latest(snap, new.filter("id IS NOT NULL"), ["id"], "v").collect()} == {("a", 1), ("b", 2), ("c", 3)}
    assert {tuple(r) for r in store.update(snap, spark.createDataFrame([("a", 9)], "id string, v int"), "id", ["v"]).collect()} == {("a", 9), ("b", 1)}


def test_offsets_over_many_partitions(spark):
    rows = [(k, k % 7) for k in range(500)]
    df = spark.createDataFrame(rows, "id int, n long").repartition(5)
    total, want = 0, {}
    for k, n in rows:
        want[k] = total
        total += n
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r.id: r.offset for r in corpus.offsets(df, ["id"], "n").collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == want


def test_triplets(spark):
    m = spark.createDataFrame(
        [(f"m{k}", "p" if k < 8 else "q", "active" if k != 7 else "archived", "some summary text", "content of this memory") for k in range(10)],
        "id string, project string, state string, summary string, content string",
    )
    edges = [("m0", "m1", 0.9, "similar"), ("m1", "m0", 0.8, "similar"), ("m0", "m2", 0.2, "similar"), ("m0", "m7", 0.9, "similar"), ("m8", "m9", 0.9, "caused_by")]
    e = spark.createDataFrame(edges, "source_id string, target_id string, strength double, relation_type string")
    got = {(r.anchor, r.positive): r.negative for r in corpus.triplets(m, e).collect()}
    assert set(got) == {("m0", "m1"), ("m8", "m9")}
    # never linked to the anchor, never archived, same project; none left gives null
    assert got[("m0", "m1")] in {"m3", "m4", "m5", "m6", None} and got[("m8", "m9")] is None


def test_triplets_find_any_unlinked_memory(spark):
    m = spark.createDataFrame(
        [(f"m{k:02d}", "p", "active", "some summary text", "content of this memory") for k in range(30)],
        "id string, project string, state string, summary string, content string",
    )
    # m00 is linked to all but m17, m01 to all, every other one to m00 and m01 only
    links = [("m00", f"m{k:02d}", 0.9) for k in range(1, 30) if k != 17] + [("m01", f"m{k:02d}", 0.9) for k in range(2, 30)]
    links += [(f"m{k:02d}", f"m{k + 1:02d}", 0.8) for k in range(2, 29)]
    e = spark.createDataFrame([(a, b, s, "similar") for a, b, s in links], "source_id string, target_id string, strength double, relation_type string")
    got = corpus.triplets(m, e).collect()
    both = {(a, b) for a, b, _ in links} | {(b, a) for a, b, _ in links}
    assert len(got) == len(links)
    assert {r.negative for r in got if r.anchor == "m00"} == {"m17"} and {r.negative for r in got if r.anchor == "m01"} == {None}
    for r in got:
        assert r.anchor == "m01" or r.negative and r.negative != r.anchor and (r.anchor, r.negative) not in both


def test_keywords_and_composite(spark):
    from cairnflow.functions import exprs as X

    df = spark.createDataFrame([("The quick brown Fox is to the quick fox ab",), (None,)], "t string").coalesce(1)
    assert [r[0] for r in df.select(X.keywords(F.col("t"))).collect()] == [["quick", "brown", "fox"], []]
    m = spark.createDataFrame([(1.0, 0.5, 0.5, 1.0, 0.0)], "ndcg double, precision double, mrr double, noise_suppression double, signal_retention double")
    assert evaluation.composite(m).first().composite == pytest.approx(0.3 + 0.1 + 0.1 + 0.15)
