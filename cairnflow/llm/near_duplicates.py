"""Near-duplicate records by fast similarity sketching, banding and exact verification.

Every text becomes the set of its word shingles.  The sketch of a set has ``t`` coordinates
and is filled in rounds: in round i each element is hashed to a bin and a value and the bin
keeps the least (i, value).  From round t on, round i fills bin i - t from all elements, so
after 2 t rounds every coordinate is certainly filled; for sets that are not tiny a few rounds
do.  Two sets agree in a coordinate with a probability equal to their Jaccard similarity, with
the concentration of independent draws.  Coordinates are grouped into bands; records that agree
in a whole band are candidates, and each candidate pair is verified on the full shingle sets.

Scale: equal shingle sets are folded into one class before anything is paired, so copies cost
one representative however many they are.  Bucket keys held by one class only are dropped
before the pairing; buckets above ``BUCKET`` members are cut into blocks, and each pair of
blocks is a task of its own, so no bucket is collected whole and none is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cairnflow.llm.leakage import words
from cairnflow.sources.tables import materialize

#: Rows of a band and number of bands; at similarity 0.6 a pair is missed with probability (1 - 0.6^3)^36 < 0.0002.
ROWS, BANDS = 3, 36
#: Members of a bucket that are paired in one group.
BUCKET = 64
#: A table of shared bucket keys of at most so many rows is broadcast (16 bytes a row).
BROADCAST_ROWS = 500_000

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64) of ``x + seed``."""
    z = x + np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def _seed(*n: int) -> int:
    return xxhash.xxh3_64_intdigest(repr(n).encode())


def fast_similarity_sketch(x: np.ndarray, owner: np.ndarray, n: int, t: int) -> np.ndarray:
    """Sketches (n x t) of the sets given as elements ``x`` with their owners 0..n-1."""
    sketch = np.full(n * t, _NONE)
    for i in range(2 * t):
        h = _mix(x, _seed(1, i))
        bins = (h % np.uint64(t)).astype(np.int64) if i < t else i - t
        np.minimum.at(sketch, owner * t + bins, np.uint64(i << 48) | h >> np.uint64(16))
        open_ = (sketch.reshape(n, t) == _NONE).any(axis=1)
        if not open_[owner].any():
            break
        keep = open_[owner]
        x, owner = x[keep], owner[keep]
    return sketch.reshape(n, t)


def band_keys(sketch: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit key for each band of each sketch."""
    out = np.empty((len(sketch), bands), np.uint64)
    for b in range(bands):
        k = np.full(len(sketch), np.uint64(_seed(2, b)))
        for r in range(rows):
            k = _mix(k ^ sketch[:, b * rows + r], _seed(3, r))
        out[:, b] = k
    return out


class Shingler:
    """Word shingles as 64-bit numbers; remembers the hashes of words."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def __call__(self, text_words: list[str]) -> np.ndarray:
        if len(self.known) > 300_000:
            self.known.clear()
        known, digest = self.known, xxhash.xxh3_64_intdigest
        try:
            ids = [known[w] for w in text_words]
        except KeyError:
            for w in text_words:
                if w not in known:
                    known[w] = digest(w.encode("utf-8", "surrogatepass"))
            ids = [known[w] for w in text_words]
        a = np.array(ids, np.uint64)
        n = len(a) - self.size + 1
        if n < 1:
            return np.empty(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for k in range(self.size):
            h = _mix(h ^ a[k : k + n], _seed(4, k))
        return np.unique(h)


@dataclass
class NearDuplicates:
    """``members``: id, class_id (one row per id); ``links``: class_a, class_b, similarity.

    Records of one class have the same set of shingles.  ``links`` holds each pair of
    different classes whose similarity reaches the threshold once.
    """

    members: DataFrame
    links: DataFrame

    def pairs(self) -> DataFrame:
        """``id_a, id_b`` (smaller first) of all records linked, copies expanded."""
        a = self.members.select(F.col("class_id").alias("class_a"), F.col("id").alias("ia"))
        b = self.members.select(F.col("class_id").alias("class_b"), F.col("id").alias("ib"))
        across = self.links.join(a, "class_a").join(b, "class_b").select("ia", "ib")
        same = a.join(b, (F.col("class_a") == F.col("class_b")) & (F.col("ia") < F.col("ib"))).select("ia", "ib")
        return across.unionByName(same).select(
            F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")
        )

    def documents(self) -> DataFrame:
        """``id, class_id, n_links``: one row per record with the number of classes its class is linked to."""
        ends = self.links.select(F.explode(F.array("class_a", "class_b")).alias("class_id"))
        n = ends.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
        return self.members.join(n, "class_id", "left").select(
            "id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")
        )


def near_duplicates(
    records: DataFrame,
    record_id: str,
    text: str,
    threshold: float = 0.8,
    shingle: int = 5,
    min_words: int | None = None,
    rows: int = ROWS,
    bands: int = BANDS,
) -> NearDuplicates:
    """Classes and links of the records whose shingle sets have a Jaccard similarity of at least ``threshold``.

    Texts of fewer than ``min_words`` words (at least ``shingle``), null and empty texts and
    rows without id take no part.  A row delivered twice counts once.  If one id has different
    texts, it is a member of several classes.  Extra columns are ignored.
    """
    least = max(min_words or shingle, shingle)
    slim = (
        records.select(F.col(record_id).cast("string").alias("id"), F.col(text).alias("text"))
        .filter(F.col("id").isNotNull() & (F.length("text") >= 2 * least - 1))
    )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(shingle)
        for batch in batches:
            sets, at = [], []
            for k, t in enumerate(batch.column("text").to_pylist()):
                w = words(t)
                if len(w) >= least:
                    sets.append(shingles(w))
                    at.append(k)
            if not sets:
                continue
            sizes = np.array([len(s) for s in sets])
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            starts = np.cumsum(sizes) - sizes
            keys = band_keys(fast_similarity_sketch(flat, owner, len(sets), rows * bands), rows, bands)

            def lists(a: np.ndarray, offsets: np.ndarray) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(a.view(np.int64)))

            yield pa.record_batch(
                [
                    batch.column("id").take(pa.array(at)),
                    pa.array(np.add.reduceat(_mix(flat, _seed(5)), starts).view(np.int64)),
                    pa.array(np.bitwise_xor.reduceat(_mix(flat, _seed(6)), starts).view(np.int64)),
                    pa.array(sizes.astype(np.int32)),
                    lists(keys.reshape(-1), np.arange(len(sets) + 1) * bands),
                    lists(flat, np.append(starts, len(flat))),
                ],
                names=["id", "c1", "c2", "n", "bands", "shingles"],
            )

    sets = materialize(
        slim.mapInArrow(
            sketch, "id string, c1 long, c2 long, n int, bands array<long>, shingles array<long>"
        ).withColumn("rid", F.monotonically_increasing_id()),
        "shingle-sets",
    )
    classes = materialize(
        sets.groupBy("c1", "c2").agg(F.min("id").alias("class_id"), F.min(F.struct("rid", "n", "bands")).alias("s")).select(
            "c1", "c2", "class_id", "s.rid", "s.n", "s.bands"
        ),
        "classes",
    )
    members = sets.select("id", "c1", "c2").distinct().join(classes.select("c1", "c2", "class_id"), ["c1", "c2"])
    pairs = candidate_pairs(classes, threshold)
    # verification: the full sets of the two representatives
    full = sets.select("rid", "shingles")
    a = full.select(F.col("rid").alias("a"), F.col("shingles").alias("sa"))
    b = full.select(F.col("rid").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("double")
    verified = (
        pairs.join(a, "a")
        .join(b, "b")
        .select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("similarity"))
        .filter(F.col("similarity") >= threshold)
    )
    verified = materialize(verified, "links")
    name = classes.select("rid", "class_id")
    links = verified.join(name.select(F.col("rid").alias("a"), F.col("class_id").alias("class_a")), "a").join(
        name.select(F.col("rid").alias("b"), F.col("class_id").alias("class_b")), "b"
    )
    return NearDuplicates(
        members.select("id", "class_id").distinct(), links.select("class_a", "class_b", "similarity")
    )


def candidate_pairs(classes: DataFrame, threshold: float) -> DataFrame:
    """``a, b`` (a < b): classes that agree in a band and whose sizes allow the threshold."""
    entries = classes.select("rid", "n", F.explode("bands").alias("key"))
    shared = materialize(
        entries.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > 1), "shared-keys"
    )
    side = F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared
    blocks = F.expr(f"cast(ceil(m / {BUCKET}) as int)")
    placed = (
        entries.join(side, "key")
        .withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key",
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            F.struct("rid", "n", "own").alias("e"),
        )
    )
    grouped = placed.groupBy("key", "i", "j").agg(F.array_sort(F.collect_list("e")).alias("es"))
    fits = lambda x, y: (F.least(x["n"], y["n"]) >= threshold * F.greatest(x["n"], y["n"])) & (
        # inside one block all pairs, between two blocks only pairs across
        (F.col("i") == F.col("j")) | (x["own"] != y["own"])
    )
    couples = F.flatten(
        F.transform(
            F.col("es"),
            lambda x, k: F.transform(
                F.filter(F.slice(F.col("es"), k + 2, F.size("es")), lambda y: fits(x, y)),
                lambda y: F.struct(x["rid"].alias("a"), y["rid"].alias("b")),
            ),
        )
    )
    return (
        grouped.filter(F.size("es") > 1)
        .select(F.explode(couples).alias("p"))
        .select("p.a", "p.b")
        .distinct()
    )
