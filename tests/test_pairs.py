import random

import numpy as np

from cairnflow.operators import clusters, graph, pairs


def _memories(n=90):
    rnd = random.Random(5)
    words = "why when how note pepper tracer relay viewer".split()
    out = []
    for k in range(n):
        cs = [f"{'Cc'[rnd.random() < 0.5]}{min(int(rnd.expovariate(0.3)), 14)}" for _ in range(rnd.randrange(9))]
        v = [rnd.gauss(1, 1.5) for _ in range(4)] if k % 11 else [None, [], [0.0] * 4][k // 11 % 3]
        out.append((f"m{rnd.random():.9f}", cs if k % 13 else None, " ".join(rnd.choices(words, k=rnd.randrange(7))), v))
    return out


def _sets(rows):
    return {i: {c.lower() for c in cs or []} for i, cs, _, _ in rows}


def test_shared_pairs_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "PAIR_BLOCK", 20)
    monkeypatch.setattr(pairs, "_DENSE", 4)  # some elements by bits, some by places
    monkeypatch.setattr(pairs, "_FLUSH", 50)
    rows = _memories()
    m, held = spark.createDataFrame(rows, "id string, concepts array<string>, title string, v array<float>"), _sets(rows)
    every = {(a, b): len(held[a] & held[b]) for a in held for b in held if a < b}
    for least, share in ((2, 0.0), (1, 0.5)):
        want = {p: n for p, n in every.items() if n >= least and n >= share * max(len(held[p[0]]), len(held[p[1]]))}
        known = sorted(want)[::3]
        got = graph.shared_concept_pairs(m, least, share).collect()
        assert {(r.a, r.b): r.shared for r in got} == want and len(got) == len(want) > 50
        rest = graph.shared_concept_pairs(m, least, share, spark.createDataFrame(known + known, "a string, b string")).collect()
        assert {(r.a, r.b) for r in rest} == set(want) - set(known) and len(rest) == len(want) - len(known)
    assert graph.shared_concept_pairs(m.limit(0), 1).count() == 0


def test_near_duplicates_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "PAIR_BLOCK", 30)
    rows = _memories()
    m, held = spark.createDataFrame(rows, "id string, concepts array<string>, title string, v array<float>"), _sets(rows)
    vs = {i: np.array(v or [0] * 4, np.float32).astype(float) for i, _, _, v in rows}
    titles = {i: t.split() for i, _, t, _ in rows}
    want = set()
    for a in held:
        for b in held:
            if a < b and len(held[a] & held[b]) >= 2:
                size, x, y = np.linalg.norm(vs[a]) * np.linalg.norm(vs[b]), set(titles[a]), set(titles[b])
                near, words = size > 0 and vs[a] @ vs[b] / size >= 0.7, len(x & y) / len(x | y) >= 0.3 if x or y else True
                if near and words or (near or words) and min(len(titles[a]), len(titles[b])) > 4:
                    want.add((a, b))
    got = clusters.near_duplicates(m, 2, 0.3, 0.7, 4).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 10
