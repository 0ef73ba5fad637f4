import random

from cairnflow.llm import leakage


def grams(t, n):
    w = leakage.words(t)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def leaks(docs, items, **kind):
    return leakage.leaked_items(leakage.positional_index(docs, "doc_id", "text"), items, "item_id", "text", **kind)


def data(rng):
    word = lambda: rng.choice("a b c d e f g Straße x1 y".split())
    texts = [" ".join(word() for _ in range(rng.randrange(30))) for _ in range(60)]
    items = [(k, " ".join(word() for _ in range(rng.randrange(14)))) for k in range(12)] + [(98, None), (99, "")]
    docs = [(k, rng.choice(texts) + rng.choice(["", "; ", "_"]) + (rng.choice(items)[1] or "").upper(), 7) for k in range(150)]
    return docs + [(200, None, 7), (201, "", 7), (None, items[1][1], 7)], items


def test_exact_against_brute_force(spark, monkeypatch):
    docs, items = data(random.Random(4))
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    want = {(x, k) for x, t, _ in docs for k, u in items if grams(t, 5) & grams(u, 5)}
    assert want
    for block, cand, segment in ((2_000_000, 2_000_000, 400_000), (5, 50, 60)):
        monkeypatch.setattr(leakage, "BLOCK_WORDS", block)
        monkeypatch.setattr(leakage, "CANDIDATES", cand)
        monkeypatch.setattr(leakage, "SEGMENT_WORDS", segment)
        got = leaks(d, i, run=5).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) and all(r.exact for r in got)
    assert leaks(d.limit(0), i).count() == 0
    assert leaks(d, i.limit(0)).count() == 0


def test_proximity(spark):
    item = "one two three four five six seven eight"
    docs = [(1, item), (2, "one two x three four five six seven eight"), (3, "one two three nine five six seven eight"), (4, "eight seven six five")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    near = leaks(d, i, run=8, min_terms=7, slop=1)
    assert {r.doc_id for r in near.collect()} == {1, 2, 3}
    exact = leaks(d, i, run=8)
    assert {r.doc_id for r in exact.collect()} == {1}


def test_proximity_against_brute_force():
    rng, n = random.Random(8), 5
    word = lambda: rng.choice("a b c d e f g h i j".split())
    items = [(k, [word() for _ in range(7)]) for k in range(6)]
    docs = [[word() for _ in range(rng.randrange(9))] for _ in range(60)] + [items[0][1][2:], items[1][1][:-2], []]
    docs = [items[2][1][2:6]] + docs + [items[3][1][:4]]  # cut at both ends of the batch
    windows = leakage.Windows([(k, " ".join(w)) for k, w in items], n)
    index = leakage.Segment.read(**{k: v for k, v in leakage.Segment.of(docs).row().items()})

    def places(doc, want, least, slop):
        for at in range(-n - slop, len(doc) + slop + 1):
            near = [doc[max(0, at + k - slop) : max(0, at + k + slop + 1)] for k in range(n)]
            if sum(w in x for w, x in zip(want, near)) >= least:
                yield at

    for least, slop in ((5, 0), (4, 0), (3, 0), (5, 1), (4, 1), (3, 2)):
        want = sorted(
            (d, k) for d, doc in enumerate(docs) for k, w in items for j in range(len(w) - n + 1) for _ in places(doc, w[j : j + n], least, slop)
        )
        doc, item, hits = leakage.phrase_matches(index, windows, least, slop)
        assert sorted(zip(doc.tolist(), item.tolist())) == want and (hits >= least).all(), (least, slop)


def test_index_keeps_every_position(spark):
    docs = [(1, "a b a"), (2, ""), (3, None), (4, "B c"), (None, "c c")]
    rows = leakage.positional_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), "doc_id", "text").collect()
    assert [r.doc_ids for r in rows] == [[1, 2, 4, None]]
    s = leakage.Segment.read(rows[0].terms, rows[0].counts, rows[0].steps, rows[0].lengths)
    assert s.terms.to_pylist() == ["a", "b", "c"] and s.counts.tolist() == [2, 2, 3]
    assert s.positions.tolist() == [0, 2, 1, 5, 6, 8, 9] and s.lengths.tolist() == [4, 1, 3, 3]
    assert leakage.Segment.read(**leakage.Segment.of([[], []]).row()).lengths.tolist() == [1, 1]
