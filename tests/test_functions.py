import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cairnflow.functions import exprs as X
from cairnflow.functions.embedding import bow_vector, embed
from cairnflow.functions.temporal import time_range

NOW = dt.datetime(2024, 5, 15, 13, 30)  # a Wednesday


def values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(expr).collect()]


@pytest.mark.parametrize(
    "text,match",
    [
        ("memory search", "memory* OR search*"), ("the memory is good", "memory* OR good*"), ("a x memory", "memory*"),
        ("hello! world? foo:bar", "hello* OR world* OR foobar*"), ("NOT NEAR memory", "not* OR near* OR memory*"),
        ("v3 gpt4", "v3* OR gpt4*"), ("the a an and or", ""), ("", ""), (None, ""),
    ],
)
def test_match_expression(spark, text, match):
    assert values(spark, [(text,)], "t string", X.match_expression(F.col("t"))) == [match]


def test_cosine(spark):
    rows = [([1.0, 0.0, 0.0], [1.0, 0.0, 0.0]), ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0, 1.0, 0.0], [1.0, 0.9, 0.1]), ([], []), ([1.0], [1.0, 2.0]), ([0.0], [0.0])]
    got = values(spark, rows, "a array<float>, b array<float>", X.cosine(F.col("a"), F.col("b")))
    assert got == pytest.approx([1, 0, -1, 0.9946, 0, 0, 0], abs=1e-2)


def test_time_range(spark):
    day = dt.datetime(2024, 5, 15)
    cases = {
        "recent work of the last 12 hours": (NOW - dt.timedelta(hours=12), NOW), "past 2 weeks": (NOW - dt.timedelta(days=14), NOW),
        "last month": (NOW - dt.timedelta(days=30), NOW), "today": (day, NOW), "what happened Yesterday": (day - dt.timedelta(days=1), day),
        "this week": (dt.datetime(2024, 5, 13), NOW), "this month": (dt.datetime(2024, 5, 1), NOW), "recently": (NOW - dt.timedelta(days=1), NOW),
        "how does the authentication system work": (None, None), "last 99999999999 hours": (None, None), None: (None, None),
    }
    df = spark.createDataFrame([(q,) for q in cases], "q string")
    for r in time_range(df, "q", F.lit(NOW).cast("timestamp_ntz")).collect():
        assert (r.range_from, r.range_to) == cases[r.q] and r.detected == (r.range_from is not None), r.q


def test_texts(spark):
    df = spark.createDataFrame([("a" * 12, None, ["A", "a", "b"], "src/my_api-v2/Store.go")], "t string, n string, c array<string>, p string")
    r = df.select(
        X.truncate(F.col("t"), 5).alias("cut"), X.word_count(F.col("n")).alias("w"), X.dedup_keep_first(F.col("c")).alias("c"),
        X.path_concepts(F.col("p")).alias("p"), X.short_duration(F.lit(7300)).alias("d"),
        X.json_in_prose(F.lit('see ```json\n{"a": 1}\n``` there')).alias("j"), X.strip_tags(F.lit("<p>a <b>b</b></p>")).alias("s"),
        X.clean_concepts(F.array(F.lit(" Go "), F.lit("source:x"), F.lit("type"), F.lit("general"), F.lit("go"), F.lit("memory"))).alias("cc"),
        X.command_concepts(F.lit("git -C x Commit -m y")).alias("k"), X.event_verb(F.lit("file_created")).alias("v"),
    ).first()
    assert tuple(r) == ("aaaaa...", 0, ["A", "b"], ["api", "store"], "2h", '{"a": 1}', "a b", ["go"], ["git", "x"], "created")
    assert values(spark, [(None,)], "c array<string>", F.size(X.folded_set(F.col("c")))) == [0]


def test_embedding(spark):
    v = bow_vector("alpha beta alpha")
    assert math.isclose(sum(x * x for x in v), 1) and not any(bow_vector(None))
    assert values(spark, [("alpha beta alpha",)], "t string", embed(F.col("t"))) == [v]


def test_filters(spark):
    rows = [("a/.env.local", "x"), ("a/b.PDF", "\x00\x01\x02"), ("x/node_modules/y.js", "plain")]
    df = spark.createDataFrame(rows, "p string, c string").coalesce(1)
    got = df.select(X.sensitive_file(F.col("p")), X.binary_file(F.col("p")), X.excluded_path(F.col("p"), ["node_modules/"]), X.binary_content(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(True, False, False, False), (False, True, False, True), (False, False, True, False)]
