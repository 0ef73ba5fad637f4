import random
from collections import Counter
from itertools import combinations

from cairnflow.llm import cooccurrence


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [([rng.choice([" A", "b", "C ", "d", "E", "", None, "f"]) for _ in range(rng.randrange(6))], 1) for _ in range(300)]
    rows += [([f"i{k}" for k in range(40)] + ["a"], 2)] * 3 + [(None, 0), ([], 0)]
    df = spark.createDataFrame(rows, "concepts array<string>, a int")
    single, pairs, n = Counter(), Counter(), 0
    for c, _ in rows:
        b = sorted({x.strip().lower() for x in c or [] if x and x.strip()})
        n += bool(b)
        single.update(b)
        pairs.update(combinations(b, 2))
    want = {
        (a, b, k, single[a], single[b], n)
        for (a, b), k in pairs.items()
        if k >= 3 and k * 500 >= n and k * n * 10 >= 11 * single[a] * single[b]
    }
    for chunk in (64, 7):
        got = cooccurrence.associations(df, "concepts", 3, 500, 1.1, chunk).collect()
        assert {tuple(r[:6]) for r in got} == want and len(got) == len(want)
    assert cooccurrence.associations(df.limit(0), "concepts").count() == 0
