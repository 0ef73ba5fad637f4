import random

from hypothesis import given, settings, strategies as st

from cairnflow.llm import splitting


def check(text, limit, overlap):
    pieces = splitting.split(text, limit, overlap)
    assert "".join(text[a:b] for _, a, b in pieces) == text
    for k, (lead, a, b) in enumerate(pieces):
        assert 0 < b - lead <= limit and 0 <= a - lead <= overlap
        assert (k == 0) == (a == 0) and (k == 0 or lead >= pieces[k - 1][1])
    return pieces


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .,\n\r\té😀-", max_size=400), st.integers(12, 60), st.integers(0, 11))
def test_round_trip(text, limit, overlap):
    check(text, limit, overlap)


def test_cuts_at_pauses():
    rng = random.Random(3)
    text = "\n\n".join(" ".join("w" * rng.randrange(2, 9) for _ in range(rng.randrange(5, 90))) + "." for _ in range(60))
    pieces = check(text, 1000, 100)
    assert all(text[:b].endswith("\n\n") for _, _, b in pieces[:-1])
    assert all(text[lead - 1].isspace() for lead, a, _ in pieces[1:])
    assert check("x" * 30_000, 4000, 200)[0] == (0, 0, 3800)
    assert len(check(("wörter " * 4000), 4000, 200)) <= 10


def test_frame(spark):
    rows = [("a", "x. " * 3000, 1), ("a", "x. " * 3000, 2), ("b", None, 1), ("c", "short", 1), (None, "é" * 4001, 1), ("d", "y" * 4000, 1)]
    got = splitting.split_items(spark.createDataFrame(rows, "id string, content string, piece int"), "id", "content").collect()
    assert {r.item_id for r in got} == {"a", None}
    a = sorted((r.piece, r.text[r.overlap :]) for r in got if r.item_id == "a")
    assert "".join(t for _, t in a) == "x. " * 3000 and [k for k, _ in a] == list(range(len(a)))
    empty = spark.createDataFrame([], "id string, content string")
    assert splitting.split_items(empty, "id", "content").count() == 0
