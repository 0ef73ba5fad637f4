import datetime as dt

from pyspark.sql import functions as F

from cairnflow.operators import evaluation, events, examples, records, retrieval, search, store
from cairnflow.sources import tables

T0 = dt.datetime(2024, 6, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_episodes(spark):
    rows = [("u", at(m), k) for k, m in enumerate((0, 5, 10, 11, 40, 41))] + [("v", at(3), 9), (None, at(1), 10), (None, None, 11)]
    e = spark.createDataFrame(rows, "user string, ts timestamp_ntz, id long")
    w = events.anchored_windows(e, ["user"], "ts", "id", 10)
    got = sorted((r.user or "", r.episode, r.n_events, r.first_id) for r in w.collect())
    assert got == [("", 0, 1, "10"), ("u", 0, 3, "0"), ("u", 1, 1, "3"), ("u", 2, 2, "4"), ("v", 0, 1, "9")]
    us = int((at(45) - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
    s = records.with_state(w.filter("user IS NOT NULL"), ["user"], us, 10)
    assert {r.id: (r.state, r.sparse) for r in s.collect()} == {"u-0": ("closed", False), "u-1": ("closed", True), "u-2": ("open", False), "v-0": ("closed", True)}
    assert records.close_idle(s, us, 10, force=True).filter("state = 'open'").count() == 0
    placed = records.episode_of(e.filter("user = 'u'"), w, ["user"], "ts")
    assert {r.id: r.episode for r in placed.collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2, 5: 2}
    before = {r.id: r.before for r in records.preceding(placed, ["user", "episode"], "ts", "id", 1).collect()}
    assert before == {0: [], 1: [0], 2: [1], 3: [], 4: [], 5: [4]}
    assert events.anchored_windows(e.limit(0), ["user"], "ts", "id", 10).count() == 0
    kept = events.accepted_events(e, ["user"], "ts", "id", 2, 30)
    assert sorted(r.id for r in kept.collect()) == [0, 1, 4, 5, 9, 10]
    counted = {r.id: r.recent for r in events.recent_count(e.filter("ts IS NOT NULL"), ["user"], "ts", 360).collect()}
    assert counted == {0: 1, 1: 2, 2: 2, 3: 2, 4: 1, 5: 2, 9: 1, 10: 1}


def test_conversations_and_usage(spark):
    turns = [("c", 1, "system", "s", at(0)), ("c", 2, "user", "x" * 80, at(1)), ("c", 3, "assistant", None, at(2)), ("d", 1, "tool", "t", at(3)), ("e", 1, "assistant", "only", at(4))]
    t = spark.createDataFrame(turns, "conv_id string, turn int, role string, text string, at timestamp_ntz")
    got = {r.conv_id: (r.n_messages, r.title, r.preview) for r in records.conversations(t).collect()}
    assert got == {"c": (2, "x" * 60, None), "e": (1, "", "only")}
    assert {r.conv_id: r.seconds for r in records.session_history(t).collect()} == {"c": 120, "d": 0, "e": 0}
    calls = [(at(0), "a", "encode", "12345", '{"x": 1}', 1.0, None), (at(1), "a", "encode", None, "plain", 2.0, None), (at(2), "a", "encode", "q", "r", 3.0, "e" * 300), (at(3), "a", "encode", "q", " ", 3.0, None)]
    c = spark.createDataFrame(calls, "ts timestamp_ntz, caller string, operation string, request string, response string, latency_ms double, error string")
    u = records.usage_rows(c).orderBy("ts").collect()
    assert [(r.success, r.prompt_tokens, r.completion_tokens) for r in u] == [(True, 2, 2), (True, 0, 2), (False, 1, 0), (True, 1, 1)] and len(u[2].error) == 203
    lines = [r.line for r in records.training_capture(c).collect()]
    assert len(lines) == 2 and sum('"parse_success":true' in x for x in lines) == 1


def test_rules_and_polls(spark):
    e = spark.createDataFrame([(k, at(k), "error", float(k)) for k in range(6)] + [(9, at(1), "view", None)], "id long, ts timestamp_ntz, event_type string, value double")
    rules = [{"name": "r", "event_type": "error", "priority": 1, "condition": "value > 0", "cooldown": 120}, {"name": "s", "event_type": "view", "priority": 2, "condition": "value > 0", "cooldown": 0}]
    assert sorted((r.rule, r.event_id) for r in records.fired(e, rules, "ts", "id").collect()) == [("r", 1), ("r", 3), ("r", 5)]
    snaps = spark.createDataFrame([(1, at(0), "a"), (2, at(1), "a"), (3, at(2), None), (4, at(3), ""), (5, at(4), "a")], "id int, ts timestamp_ntz, content string")
    assert sorted(r.id for r in records.changes(snaps.withColumn("k", F.lit(1)), ["k"], "ts", "id", F.col("content")).collect()) == [1, 3, 5]
    paths = spark.createDataFrame([("mem",), ("/home/x/src/MEM/a",), ("/w/app/a",), ("/w/app2/a",), ("/w/app/sub/a",), ("src",), ("",), (None,)], "p string")
    p = records.resolve_project(F.col("p"), {"mem": "memory"}, {"/w/app": "app", "/w/app/sub": "sub"}, ["src"])
    assert [r[0] for r in paths.select(p).collect()] == ["memory", "memory", "app", "", "sub", "", "", ""]
    raw = spark.createDataFrame([("a", False), ("b", None), ("c", True)], "id string, processed boolean")
    batch = raw.filter("id <> 'c'")
    after = store.unclaim(store.mark(raw, batch), raw.filter("id = 'a'"))
    assert {r.id: r.processed for r in after.collect()} == {"a": False, "b": True, "c": True}


def test_encoding_without_a_model(spark):
    rows = [
        ("a", "filesystem", "file_modified", "x", '{"path": "src/a.py"}'), ("b", "mcp", None, None, None), ("c", "ingest", "page", "<p>" + "word " * 30 + "</p>", "{broken"),
        ("d", "ingest", "page", "<b></b>", "{}"), ("e", "terminal", "cmd", "z" * 9_000, None),
    ]
    got = {r.id: r for r in records.fallback_encoding(spark.createDataFrame(rows, "id string, source string, type string, content string, metadata string")).collect()}
    assert got["a"].summary == "File file_modified: src/a.py" and got["b"].summary == "" and got["c"].summary.startswith("word word")
    assert got["d"].summary == "File activity (ingest, page)" and len(got["e"].summary) == 80 and len(got["e"].content) == 8_003
    texts = spark.createDataFrame([(1, '{"title": "T", "narrative": "n"}'), (2, "no json"), (3, None), (4, 'x ```json\n{"summary": "s", "concepts": ["a"]}\n```')], "id int, r string")
    s = {r.id: r for r in records.parsed_synthesis(texts, "r").collect()}
    assert (s[1].title, s[2].summary, s[3].summary, s[4].summary, s[4].concepts) == ("T", "no json", "", "s", ["a"]) and s[2].title == "Untitled session"


def test_examples(spark):
    turns = [("a", 1, "system", "sys"), ("a", 2, "user", "old"), ("a", 3, "user", "new COACHING NOTES: x"), ("b", 1, "system", "s"), ("c", 1, "user", "u")]
    t = spark.createDataFrame(turns, "id string, turn int, role string, text string")
    r = spark.createDataFrame([("a", "out put"), ("b", "x"), ("c", "  "), ("d", "y")], "id string, response string")
    m = examples.messages(t, r, ("COACHING NOTES:",))
    assert [tuple(x) for x in m.collect()] == [("a", "sys", "new", "out put")]
    long = spark.createDataFrame([("l", "s", "u " * 50, "r r r"), ("x", "s", "u", "r " * 60), ("n", "s", "", "r")], "id string, system string, user string, response string")
    b = {x.id: x for x in examples.budgeted(long, 20).collect()}
    assert b["l"].n == 20 and b["l"].completion_start == 17 and b["l"].input[17:] == ["r", "r", "r<|endoftext|>"] and "x" not in b and b["n"].n == 5
    prefix, done = examples.prompt(F.lit(""), F.lit("u"), F.lit("r"), examples.CHAT)
    assert spark.range(1).select(prefix, done).first()[:] == ("<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\n", "r<|im_end|>\n")
    docs = spark.createDataFrame([("a", k) for k in range(3)] + [("b", 10), (None, 11), ("z", 12)], "s string, d int")
    mix = examples.weighted_mix(docs, "s", "d", {"a": 3.0, "b": 1.0, "empty": 4.0}, 16).collect()
    assert sorted((x.source, x.doc_id, x.epoch) for x in mix) == [("a", 0, 0), ("a", 0, 1), ("a", 1, 0), ("a", 1, 1), ("a", 2, 0), ("a", 2, 1), ("b", 10, 0), ("b", 10, 1)]
    g = examples.generation_scores(spark.createDataFrame([("{}",), ("x",), (None,), ('{"gist":"a good gist","summary":"a summary of it","content":"c","concepts":["a","b"],"salience":0.5}',)], "r string"), "r").collect()
    assert [x.score for x in g] == [2.0, 0.0, 0.0, 9.0]
    c = spark.createDataFrame([(1, "go", " ", "m", None, None), (2, "go", "s", "s", None, "n\n" * 60), (3, "py", "s", "m", "o", "n")], "id int, lang string, subject string, message string, old string, new string")
    texts = {x.id: x.text for x in examples.commit_documents(c, 1).collect()}
    assert texts[2].count("\nn") == 50 and texts[3] == "Commit: s\n\nm\n\nBefore:\no\n\nAfter:\nn" and 1 not in texts


def test_pipeline_metrics_and_ranges(spark):
    labels = spark.createDataFrame([("r1", "signal"), ("r2", "signal"), ("r3", "noise"), ("r4", "noise")], "raw_id string, label string")
    m = spark.createDataFrame([("m1", "r1", "active", at(0), 0.5), ("m3", "r3", "active", at(300), None), ("m9", None, "active", None, 0.1)], "id string, raw_id string, state string, timestamp timestamp_ntz, salience double")
    e = spark.createDataFrame([("m1", "m3"), ("m1", "m1")], "source_id string, target_id string")
    got = evaluation.pipeline_metrics(labels, m, e).first()
    assert (got.signal_survival, got.noise_suppression, got.edges_per_signal) == (0.5, 0.5, 2.0)
    asked = spark.createDataFrame([("q", at(-10), at(400)), ("back", at(9), at(0)), ("exact", at(300), at(300))], "query_id string, since timestamp_ntz, until timestamp_ntz")
    r = retrieval.in_range(m, asked, 1)
    assert sorted((x.query_id, x.id, round(x.activation, 3)) for x in r.collect()) == [("exact", "m3", 0.3), ("q", "m3", 0.3)]


def test_full_text_with_and_without_pruning(spark, monkeypatch):
    import random

    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(rng.choices(words, weights=[1 / (n + 1) for n in range(60)], k=rng.randrange(1, 30)))) for k in range(400)] + [(900, None), (901, "")]
    queries = [(k, " ".join(rng.sample(words, 4))) for k in range(40)] + [(90, ""), (91, None), (92, "zzz")]
    d, q = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(queries, "q long, text string")
    got = []
    for limit in (10**9, 0):
        monkeypatch.setattr(search, "PRUNE_ABOVE", limit)
        got.append(sorted(tuple(r) for r in search.bm25(d, "id", F.col("text"), q, "q", F.col("text"), 5).select("query_id", "doc_id", "score", "rank").collect()))
    assert [r[:2] + r[3:] for r in got[0]] == [r[:2] + r[3:] for r in got[1]] and len(got[0]) > 150
    assert all(abs(a[2] - b[2]) < 1e-8 for a, b in zip(*got))


def test_scratch_tables_are_dropped(spark):
    with tables.scratch(spark):
        df = tables.materialize(spark.range(3), "test")
        folder = df.inputFiles()[0].rpartition("/")[0].removeprefix("file:")
        assert df.count() == 3
    import os

    assert not os.path.exists(folder)
