import random

import numpy as np

from cairnflow.llm import near_duplicates as N
from cairnflow.llm.leakage import words


def jaccard(a, b, k):
    a, b = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (words(a), words(b)))
    return len(a & b) / len(a | b)


def corpus(rng):
    vocab = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(60)]
        texts.append(base)
        for _ in range(rng.randrange(4)):
            edited = list(base)
            for _ in range(rng.randrange(1, 7)):
                edited[rng.randrange(60)] = rng.choice(vocab)
            texts.append(edited)
    rows = [(f"d{k:03d}", " ".join(t), k) for k, t in enumerate(texts)]
    rows += [(f"e{k:03d}", rows[k][1].upper().replace(" ", "_"), 0) for k in range(5)]  # copies
    return rows


def test_pairs_against_brute_force(spark, monkeypatch):
    rows = corpus(random.Random(8))
    want = {
        (a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if jaccard(a[1], b[1], 3) >= 0.6
    }
    noise = [rows[0], ("x1", None, 1), ("x2", "", 1), ("x3", "too short", 1), (None, rows[0][1], 1)]
    df = spark.createDataFrame(rows + noise, "id string, content string, n int").repartition(3)
    for bucket, broadcast in ((64, 10**6), (2, 0)):
        monkeypatch.setattr(N, "BUCKET", bucket)
        monkeypatch.setattr(N, "BROADCAST_ROWS", broadcast)
        found = N.near_duplicates(df, "id", "content", 0.6, 3, 30)
        got = [tuple(r) for r in found.pairs().collect()]
        assert len(got) == len(set(got)) and set(got) == want
    docs = {r.id: r for r in found.documents().collect()}
    assert len(docs) == len(rows) and docs["e000"].class_id == docs["d000"].class_id
    assert N.near_duplicates(df.limit(0), "id", "content").pairs().count() == 0


def test_sketch_estimates_the_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[1000:]
    x, owner = np.concatenate([a, b]), np.repeat([0, 1], 2000)
    s = N.fast_similarity_sketch(x, owner, 2, 4096)
    assert (s != N._NONE).all() and abs((s[0] == s[1]).mean() - 1 / 3) < 0.03
    tiny = N.fast_similarity_sketch(pool[:1], np.zeros(1, int), 1, 96)
    assert (tiny != N._NONE).all()
