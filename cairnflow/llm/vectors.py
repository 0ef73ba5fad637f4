"""Most similar vectors for every vector, with randomly rotated one-bit codes.

Each unit vector is rotated by one random orthogonal matrix and kept as a packed code of sign
bits and two correction scalars.  From the code of one vector and the four-bit quantised
rotation of another their inner product is estimated without bias, with an error bound that
follows from the scalars.  Only pairs whose upper bound reaches the wanted similarity, and
reaches the k-th best lower bound, are reranked with the full vectors.

Which pairs are estimated at all is decided by lists: centres are fitted on a bounded sample,
every vector stands in its ``m`` nearest lists, and the vectors of a list are compared with
each other.  The number of lists grows with the collection, so the work for one vector hardly
does; above ``CELLS`` lists there are two levels, cells fitted on one sample and lists fitted inside
each cell on a sample of its own.  Equal vectors are folded into one before anything is compared,
and a list above ``LIST_ROWS`` is compared in blocks.

With a least similarity few pairs are left, so codes go to the lists and vectors only to the
pairs.  Without one every vector keeps candidates, so vectors go to the lists with the codes and
are reranked there; each list gives the ``k`` best of its vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cairnflow.sources.tables import materialize

#: Vectors a list is planned for, rows of a list compared in one block.
PER_LIST, LIST_ROWS = 400, 16_384
#: Most lists of one level, and vectors of a cell that are put into its lists by one task.
CELLS, CELL_ROWS = 4_096, 65_536
#: Vectors on which the centres of a level, or of one cell, are fitted, at most.
SAMPLE = 32_768
#: Width of the error bounds in standard deviations of the worst case: with a least similarity and without.
WIDTH, WIDTH_K = 2.5, 1.0
_SEED = 20_240_601


def usable(v: Column, dim: int) -> Column:
    """Arrays of ``dim`` finite numbers that are not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0)


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that very large and very small numbers keep their direction."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def centres(sample: np.ndarray, n: int, rounds: int = 3) -> np.ndarray:
    """Spherical k-means from the first ``n`` vectors of the sample."""
    c = sample[:n].copy()
    for _ in range(rounds):
        near = np.concatenate([(part @ c.T).argmax(axis=1) for part in np.array_split(sample, len(sample) // 2048 + 1)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        length = np.linalg.norm(sums, axis=1)
        c[length > 1e-6] = sums[length > 1e-6] / length[length > 1e-6, None]
    return c


def encode(u: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, inner product of code and vector, packed four-bit levels, lowest level, step)."""
    o = u @ turn.T
    fit = np.abs(o).sum(axis=1) / math.sqrt(o.shape[1])
    low = o.min(axis=1)
    step = np.maximum((o.max(axis=1) - low) / 15, 1e-12)
    level = np.rint((o - low[:, None]) / step[:, None]).clip(0, 15).astype(np.uint8)
    if level.shape[1] % 2:
        level = np.pad(level, ((0, 0), (0, 1)))
    return np.packbits(o > 0, axis=1), fit, level[:, ::2] << 4 | level[:, 1::2], low, step


def estimate(dim: int, bits, fit, levels, low, step, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(estimated inner products of queries (rows) and coded vectors (columns), error of each column, error of each row)."""
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32)
    signs *= 2
    signs -= 1
    signs /= (math.sqrt(dim) * fit)[:, None]
    level = np.empty((len(levels), 2 * levels.shape[1]), np.float32)
    level[:, ::2], level[:, 1::2] = levels >> 4, levels & 15
    q = level[:, :dim] * step[:, None] + low[:, None]
    code_error = width * np.sqrt(np.maximum(1 - fit**2, 0)) / fit / math.sqrt(max(dim - 1, 1))
    return q @ signs.T, code_error.astype(np.float32), (width * step / math.sqrt(12)).astype(np.float32)


def reaching(est, column_error, row_error, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the pairs that can be among the k best of their row and reach ``least``."""
    row, col = np.nonzero(est >= (least - row_error)[:, None] - column_error[None, :])
    n = np.bincount(row, minlength=len(est))
    crowded = n[row] > k
    if crowded.any():  # the k-th best lower bound among what is left of a row
        r, c = row[crowded], col[crowded]
        error = column_error[c] + row_error[r]
        lower = est[r, c] - error
        order = np.lexsort((-lower, r))
        first = np.searchsorted(r[order], r)
        kth = lower[order][first + k - 1]
        keep = ~crowded
        keep[crowded] = est[r, c] + error >= kth
        row, col = row[keep], col[keep]
    return row, col


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """A number not above the k-th greatest of each row: the k-th greatest of the maxima of groups of columns."""
    n, m = values.shape
    if m >= 32 * k:
        g = m // 8
        values = np.maximum.reduceat(values, np.arange(0, g * 8, 8), axis=1)
    if values.shape[1] <= k:
        return np.full(n, -np.inf, values.dtype)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def k_best(est, column_error, row_error, q_full, d_full, k: int, single: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, similarity) of the k best of each row, ties included; minus infinity in ``est`` marks pairs that do not count.
    ``single`` may hold both sides in single precision.

    What cannot reach the k-th best lower bound of its row is left out, the rest is reranked: in single precision first, and
    what stays in double precision."""
    kth = _kth(est - column_error, k) - 2 * row_error
    row, col = np.nonzero((est + column_error >= kth[:, None]) & (est > -np.inf))
    size = 131_072
    q32, d32 = single or (q_full.astype(np.float32), d_full.astype(np.float32))
    near = [np.einsum("ij,ij->i", q32[row[x : x + size]], d32[col[x : x + size]]) for x in range(0, len(row), size)]
    s = np.concatenate(near) if near else np.empty(0, np.float32)
    est.fill(-np.inf)
    est[row, col] = s
    keep = s >= _kth(est, k)[row] - 1e-5
    row, col = row[keep], col[keep]
    s = np.round(np.concatenate([np.einsum("ij,ij->i", q_full[row[x : x + size]].astype(float), d_full[col[x : x + size]].astype(float)) for x in range(0, len(row), size)] or [np.empty(0)]), 12)
    order = np.lexsort((-s, row))
    row, col, s = row[order], col[order], s[order]
    first, last = np.searchsorted(row, row), np.searchsorted(row, row, side="right") - 1
    keep = s >= s[np.minimum(first + k - 1, last)]
    return row[keep], col[keep], s[keep]


def nearest(
    vectors: DataFrame, vector_id: str, vector: str, dim: int, k: int = 5, least: float | None = None
) -> DataFrame:
    """The ``k`` most similar vectors of every usable vector.

    Columns: ``id, neighbour, similarity`` (cosine), ``rank`` (ties: smaller neighbour first).
    With ``least`` only neighbours of at least that cosine.  Vectors that are null, of another
    length, all zero or not finite, and rows without id take no part.  A repeated row counts
    once.  Equal vectors are neighbours like any others, each with its own row.  Extra columns
    are ignored.
    """
    spark = vectors.sparkSession
    slim = vectors.select(F.col(vector_id).alias("id"), F.col(vector).alias("v")).filter(
        F.col("id").isNotNull() & usable(F.col("v"), dim)
    )
    keyed = slim.select("id", F.xxhash64("v").alias("c1"), F.xxhash64(F.lit(1), "v").alias("c2"), "v")
    lowest = Window.partitionBy("c1", "c2").orderBy("id")
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    classes = materialize(
        keyed.withColumn("n", F.dense_rank().over(lowest))
        .filter(F.col("n") <= k + 1)
        .groupBy("c1", "c2")
        .agg(F.first("v").alias("v"), F.array_sort(F.collect_set("id")).alias("ids"))
        .withColumns({"vid": F.monotonically_increasing_id(), "norm": F.sqrt(total)}),
        "vector-classes",
    )
    n = classes.count()
    if n == 0:
        kind = dict(slim.dtypes)["id"]
        return spark.createDataFrame([], f"id {kind}, neighbour {kind}, similarity double, rank int")
    wanted = max(1, n // PER_LIST)
    lists = min(CELLS, wanted)
    # a pair at a stated similarity must share a list; among k nearest of any similarity a few may be missed
    near = 2 + math.ceil(math.log2(wanted) / 2) if least is not None else 1 + math.ceil(math.log2(wanted) / 3)
    memberships = min(lists, near) if lists > 1 else 1
    if wanted > CELLS:  # two lists in each cell
        memberships = min(lists, memberships // 2 + 1)
    share = max(1, n // SAMPLE)
    sample = (
        classes.filter(F.pmod(F.xxhash64("vid", F.lit(3)), F.lit(share)) == 0).select("v").limit(SAMPLE).toPandas()["v"]
    )
    fitted = unit(np.stack(sample.to_numpy())) if len(sample) else np.eye(1, dim, dtype=np.float32)
    fitted = fitted[np.random.default_rng(_SEED).permutation(len(fitted))]
    lists = min(lists, len(fitted))
    memberships = min(memberships, lists)
    shared = spark.sparkContext.broadcast((centres(fitted, lists), rotation(dim)))
    slim_v = classes.select("vid", "v")
    with_vectors = least is None

    def chunks(batches, names):
        middle, turn = shared.value
        size = max(1, min(4096, 8_000_000 // len(middle)))
        for b in batches:
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for lo in range(0, len(flat), size):
                raw = flat[lo : lo + size]
                u = unit(raw)
                yield names(b.column("vid")[lo : lo + size].to_numpy(), raw, u, _nearest_centres(u, middle, memberships), turn)

    if wanted <= CELLS:

        def placed(names, schema: str) -> DataFrame:
            return slim_v.mapInArrow(lambda batches: chunks(batches, names), schema)

    else:
        placed = _two_levels(slim_v, chunks, dim, wanted, lists)

    def list_only(vid, raw, u, top, turn):
        at, count = np.unique(top, return_counts=True)
        return pa.record_batch([pa.array(at.astype(np.int64)), pa.array(count.astype(np.int64))], names=["list", "n"])

    sizes = placed(list_only, "list long, n long").groupBy("list").agg(F.sum("n").alias("n")).filter(F.col("n") > LIST_ROWS)
    blocks = {r.list: -(-r.n // LIST_ROWS) for r in sizes.collect()}

    def assign(vid, raw, u, top, turn):
        bits, fit, levels, low, step = encode(u, turn)
        at, row = top.reshape(-1).astype(np.int64), np.repeat(np.arange(len(u)), top.shape[1])
        own = np.zeros(len(at), np.int32)
        for hot, k_ in blocks.items():  # few: lists far above their planned size
            mine = at == hot
            own[mine] = (vid[row[mine]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(k_)
        count = np.array([blocks.get(int(a), 1) for a in at]) if blocks else np.ones(len(at), np.int64)
        # role 0: query and vector, 1: query only, 2: vector only
        cols = [(at, own, own, np.zeros(len(at), np.int8), row)]
        for d in range(1, int(count.max(initial=1))):
            more = count > d
            other = (own[more] + d) % count[more]
            cols.append((at[more], own[more], other, np.ones(more.sum(), np.int8), row[more]))
            cols.append((at[more], other, own[more], np.full(more.sum(), 2, np.int8), row[more]))
        at, q, d, role, row = (np.concatenate(c) for c in zip(*cols))
        take = pa.array(row)
        columns = {
            "list": pa.array(at),
            "q": pa.array(q.astype(np.int32)),
            "d": pa.array(d.astype(np.int32)),
            "role": pa.array(role),
            "vid": pa.array(vid[row]),
            "bits": pa.array([x.tobytes() for x in bits]).take(take),
            "fit": pa.array(fit[row].astype(np.float32)),
            "levels": pa.array([x.tobytes() for x in levels]).take(take),
            "low": pa.array(low[row].astype(np.float32)),
            "step": pa.array(step[row].astype(np.float32)),
        }
        if with_vectors:
            columns["raw"] = pa.array([x.tobytes() for x in raw.astype(np.float64 if raw.dtype == np.float64 else np.float32)]).take(take)
        return pa.record_batch(list(columns.values()), names=list(columns))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        role = pdf["role"].to_numpy()
        qs, ds = np.flatnonzero(role != 2), np.flatnonzero(role != 1)
        vid = pdf["vid"].to_numpy()
        bits = np.frombuffer(b"".join(pdf["bits"]), np.uint8).reshape(len(pdf), -1)
        levels = np.frombuffer(b"".join(pdf["levels"]), np.uint8).reshape(len(pdf), -1)
        fit, low, step = (pdf[c].to_numpy() for c in ("fit", "low", "step"))
        if with_vectors:
            joined = b"".join(pdf["raw"])
            full = np.frombuffer(joined, np.float64 if len(joined) == 8 * dim * len(pdf) else np.float32).reshape(-1, dim)
            full = full / np.abs(full).max(axis=1, keepdims=True).astype(np.float64)
            full /= np.sqrt((full * full).sum(axis=1))[:, None]
            single = full.astype(np.float32)
        found = []
        size = max(1, 4_000_000 // max(1, len(ds)))
        at = np.argsort(vid[ds], kind="stable")
        for lo in range(0, len(qs), size):
            part = qs[lo : lo + size]
            est, column_error, row_error = estimate(dim, bits[ds], fit[ds], levels[part], low[part], step[part], WIDTH_K if with_vectors else WIDTH)
            own = np.minimum(np.searchsorted(vid[ds], vid[part], sorter=at), len(ds) - 1)  # a vector stands in a list once
            same = vid[ds][at[own]] == vid[part]
            est[np.flatnonzero(same), at[own][same]] = -np.inf
            if with_vectors:
                r, c, s = k_best(est, column_error, row_error, full[part], full[ds], k, (single[part], single[ds]))
                found.append((vid[part][r], vid[ds][c], s))
            else:
                r, c = reaching(est, column_error, row_error, k, least)
                found.append((vid[part][r], vid[ds][c]))
        if with_vectors:
            a, b, s = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            return pd.DataFrame({"vid": a, "nv": b, "s": s})
        a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    schema = "list long, q int, d int, role byte, vid long, bits binary, fit float, levels binary, low float, step float"
    grouped = placed(assign, schema + (", raw binary" if with_vectors else "")).groupBy("list", "q", "d")
    if with_vectors:
        other = materialize(grouped.applyInPandas(compare, "vid long, nv long, s double").groupBy("vid", "nv").agg(F.max("s").alias("s")), "reranked")
        return _neighbours(other, classes, keyed, k)
    pairs = grouped.applyInPandas(compare, "a long, b long").distinct()
    full = classes.select("vid", "v", "norm")
    a = full.select(F.col("vid").alias("a"), F.col("v").alias("va"), F.col("norm").alias("na"))
    b = full.select(F.col("vid").alias("b"), F.col("v").alias("vb"), F.col("norm").alias("nb"))
    dot = F.aggregate(
        F.zip_with("va", "vb", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x
    )
    near = pairs.join(a, "a").join(b, "b").select("a", "b", F.round(dot / (F.col("na") * F.col("nb")), 12).alias("s"))
    near = materialize(near.filter(F.col("s") >= least), "reranked")
    both = F.array(
        F.struct(F.col("a").alias("vid"), F.col("b").alias("nv"), "s"), F.struct(F.col("b").alias("vid"), F.col("a").alias("nv"), "s")
    )
    return _neighbours(near.select(F.explode(both).alias("x")).select("x.*"), classes, keyed, k)


def _nearest_centres(u: np.ndarray, middle: np.ndarray, m: int) -> np.ndarray:
    """The ``m`` nearest centres of each row."""
    if len(middle) <= m:
        return np.tile(np.arange(len(middle)), (len(u), 1))
    return np.argpartition(-(u @ middle.T), m - 1, axis=1)[:, :m]


def _two_levels(slim_v: DataFrame, chunks, dim: int, wanted: int, cells: int):
    """Lists inside cells: ``f(names, schema)`` puts each vector into the two nearest lists of each of its cells.

    A cell has as many lists as its vectors ask for, fitted on at most ``SAMPLE`` of them.  A cell
    above ``CELL_ROWS`` vectors is taken in parts, each with all its centres.
    """
    kind = np.float64 if dict(slim_v.dtypes)["v"] == "array<double>" else np.float32

    def to_cells(vid, raw, u, top, turn):
        row = np.repeat(np.arange(len(u)), top.shape[1])
        vectors = pa.array([x.tobytes() for x in raw.astype(kind)]).take(pa.array(row))
        return pa.record_batch([pa.array(top.reshape(-1).astype(np.int64)), pa.array(vid[row]), vectors], names=["cell", "vid", "raw"])

    in_cells = slim_v.mapInArrow(lambda batches: chunks(batches, to_cells), "cell long, vid long, raw binary")
    in_cells = materialize(in_cells, "vectors-in-cells")
    size = in_cells.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    by_hash = Window.partitionBy("cell").orderBy(F.xxhash64("vid", F.lit(5)), "vid")
    sample = in_cells.withColumn("n", F.row_number().over(by_hash)).filter(F.col("n") <= SAMPLE).join(size, "cell")

    planned = PER_LIST

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        u = unit(np.frombuffer(b"".join(pdf["raw"]), kind).reshape(-1, dim))
        n = max(1, min(-(-int(pdf["size"].iloc[0]) // planned), -(-len(u) // 4)))
        return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "size": pdf["size"].iloc[:1], "centres": [centres(u, n).tobytes()]})

    fitted = materialize(sample.groupBy("cell").applyInPandas(fit, "cell long, size long, centres binary"), "cell-centres")
    parts = F.ceil(F.col("size") / CELL_ROWS).cast("int")
    salted = fitted.select("cell", "centres", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    rows = in_cells.join(fitted.select("cell", parts.alias("parts")), "cell").select(
        "cell", F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int").alias("part"), "vid", "raw"
    )
    turn = rotation(dim)

    def placed(names, schema: str) -> DataFrame:
        def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.Table.from_batches([], schema=names(*empty).schema)
            raw = np.frombuffer(b"".join(left.column("raw").to_pylist()), kind).reshape(-1, dim)
            u = unit(raw)
            middle = np.frombuffer(right.column("centres")[0].as_py(), np.float32).reshape(-1, dim)
            at = key[0].as_py() * (1 << 24) + np.concatenate([_nearest_centres(x, middle, 2) for x in np.array_split(u, len(u) // 2048 + 1)])
            return pa.Table.from_batches([names(left.column("vid").to_numpy(), raw, u, at, turn)])

        empty = np.empty(0, np.int64), np.ones((0, dim), kind), np.ones((0, dim), np.float32), np.empty((0, 1), np.int64), turn
        by = "cell", "part"
        return rows.groupBy(*by).cogroup(salted.groupBy(*by)).applyInArrow(run, schema)

    return placed


def _neighbours(other: DataFrame, classes: DataFrame, keyed: DataFrame, k: int) -> DataFrame:
    """The ``k`` best neighbours of every id, from the similarities ``vid, nv, s`` of different vectors and the classes of equal ones."""
    names = classes.select("vid", "c1", "c2", "ids")
    offers = (
        other.join(names.select(F.col("vid").alias("nv"), "ids"), "nv")
        .select("vid", "s", F.explode("ids").alias("neighbour"))
        .unionByName(
            names.filter(F.size("ids") > 1).select("vid", F.lit(1.0).alias("s"), F.explode("ids").alias("neighbour"))
        )
    )
    best = Window.partitionBy("vid").orderBy(F.desc("s"), "neighbour")
    offers = offers.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n")
    members = keyed.select("id", "c1", "c2").distinct().join(names.select("vid", "c1", "c2"), ["c1", "c2"])
    mine = Window.partitionBy("id").orderBy(F.desc("s"), "neighbour")
    return (
        members.select("id", "vid")
        .join(offers, "vid")
        .filter(F.col("id") != F.col("neighbour"))
        .withColumn("rank", F.row_number().over(mine))
        .filter(F.col("rank") <= k)
        .select("id", "neighbour", F.col("s").alias("similarity"), "rank")
    )
