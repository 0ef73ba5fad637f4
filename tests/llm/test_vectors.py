import numpy as np
import pytest

from cairnflow.llm import vectors as V


def brute(rows, k, least):
    ok = sorted({i: np.array(v, float) for i, v in rows if i and usable(v)}.items())
    out = {}
    for i, v in ok:
        s = sorted(
            (-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 12), j) for j, w in ok if j != i
        )
        out[i] = [(j, -x) for x, j in s if least is None or -x >= least][:k]
    return {(i, j) for i, near in out.items() for j, _ in near}


def usable(v):
    return v is not None and len(v) == 32 and None not in v and bool(np.isfinite(v).all()) and any(v)


def rows(n):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((n // 4, 32))
    x = np.repeat(centre, 4, axis=0) + 0.35 * rng.standard_normal((len(centre) * 4, 32))
    x *= rng.uniform(0.1, 9, (len(x), 1))
    out = [(f"v{k:04d}", [float(np.float32(a)) for a in v]) for k, v in enumerate(x)]
    out += [(f"copy{k}", out[5][1]) for k in range(9)]
    bad = [[0.0] * 32, [1.0] * 31, [float("nan")] * 32, [float("inf")] * 32, [], None, [None] * 32]
    return out + [(f"bad{k}", v) for k, v in enumerate(bad)] + [(None, out[0][1]), out[0]]


@pytest.mark.parametrize("least,list_rows,cells", [(0.8, 16_384, 4096), (0.8, 30, 4096), (None, 16_384, 4096), (None, 30, 4096), (0.8, 40, 5), (None, 40, 5)])
def test_against_brute_force(spark, monkeypatch, least, list_rows, cells):
    monkeypatch.setattr(V, "PER_LIST", 60 if cells > 5 else 30)
    monkeypatch.setattr(V, "LIST_ROWS", list_rows)
    monkeypatch.setattr(V, "CELLS", cells)
    monkeypatch.setattr(V, "CELL_ROWS", 90)
    data = rows(400)
    df = spark.createDataFrame([(i, v, 1) for i, v in data], "id string, e array<float>, rank int").repartition(3)
    got = V.nearest(df, "id", "e", 32, 5, least).collect()
    pairs = {(r.id, r.neighbour) for r in got}
    want = brute(data, 5, least)
    assert len(pairs) == len(got)
    assert len(want & pairs) >= (0.98 if least else 0.9) * len(want)
    if least:
        assert pairs <= {(a, b) for a, b in brute(data, 10**6, least)}
    assert {r.neighbour for r in got if r.id == "copy3"} == {"copy0", "copy1", "copy2", "copy4", "copy5"}


def test_bounds_hold():
    rng = np.random.default_rng(4)
    u = V.unit(rng.standard_normal((300, 128)))
    bits, fit, levels, low, step = V.encode(u, V.rotation(128))
    est, columns, rows_ = V.estimate(128, bits, fit, levels, low, step)
    bound = columns[None, :] + rows_[:, None]
    off = ~np.eye(300, dtype=bool)
    error = np.abs(est - u @ u.T)[off]
    assert (error <= bound[off]).mean() > 0.98 and abs((est - u @ u.T)[off].mean()) < 0.01


def test_empty(spark):
    df = spark.createDataFrame([("a", None)], "id string, e array<float>")
    assert V.nearest(df, "id", "e", 32).count() == 0
    one = spark.createDataFrame([("a", [1.0] * 32)], "id string, e array<float>")
    assert V.nearest(one, "id", "e", 32).count() == 0


def test_k_best_of_a_block():
    rng = np.random.default_rng(9)
    x = V.unit(rng.standard_normal((700, 16)) + 2 * np.repeat(rng.standard_normal((70, 16)), 10, axis=0))
    x[3] = x[2]  # a tie
    codes = V.encode(x, V.rotation(16))
    est, columns, rows_ = V.estimate(16, codes[0], codes[1], codes[2][:50], codes[3][:50], codes[4][:50], 4.0)
    est[np.arange(50), np.arange(50)] = -np.inf
    row, col, s = V.k_best(est, columns, rows_, x[:50], x, 3)
    exact = np.round(x[:50].astype(float) @ x.T.astype(float), 12)
    exact[np.arange(50), np.arange(50)] = -np.inf
    for r in range(50):
        kth = np.sort(exact[r])[-3]
        assert set(col[row == r]) == set(np.flatnonzero(exact[r] >= kth))
    assert np.allclose(s, exact[row, col], atol=1e-9)
