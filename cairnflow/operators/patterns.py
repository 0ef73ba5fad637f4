"""Gists, patterns and abstractions: built from clusters, matched, de-duplicated, linked."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cairnflow.functions import exprs as X
from cairnflow.operators import clusters as K, graph, search


def mean_vectors(members: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """key, ``v``: element-wise sum of the usable vectors of a group over the number of all its members."""
    n = members.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    usable = members.filter(X.usable_vector(F.col(vector)) & (F.size(vector) == dim))
    sums = usable.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.sum(F.col("x").cast("double")).alias("x"))
    rows = sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("xs"))  # one entry for each dimension
    return rows.join(n, key).select(key, F.expr("transform(xs, p -> p.x / n)").alias("v"))


def gists(members: DataFrame, memories: DataFrame, dim: int = 128, concepts: int = 7) -> DataFrame:
    """One gist for each ``cluster`` of ``members`` (``cluster, id``).

    Columns: ``cluster, n_sources, salience`` (the greatest), ``project`` (the most frequent that is
    not empty, ties by name), ``raw_id`` and ``summary`` of the newest source (a content of at most
    100 characters where the summary is empty), ``concepts`` (the most frequent in lower case, ties
    by name) and ``v``, the mean vector.  Members that are no memory are left out; a repeated
    member counts once.
    """
    m = members.select("cluster", "id").distinct().join(memories, "id")
    newest = F.struct(F.col("created_at"), F.col("id"))
    text = F.when(F.trim(F.coalesce("summary", F.lit(""))) == "", X.truncate(F.col("content"), 100)).otherwise(F.col("summary"))
    base = m.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_sources"), F.max("salience").alias("salience"), F.max_by("raw_id", newest).alias("raw_id"), F.max_by(text, newest).alias("summary")
    )
    owned = m.filter(F.coalesce("project", F.lit("")) != "").groupBy("cluster", "project").agg(F.count(F.lit(1)).alias("k"))
    project = search.top_k(owned, ["cluster"], [F.desc("k"), F.col("project")], 1).select("cluster", "project")
    held = m.select("cluster", F.explode(X.folded_set(F.col("concepts"))).alias("c")).groupBy("cluster", "c").agg(F.count(F.lit(1)).alias("k"))
    best = search.top_k(held, ["cluster"], [F.desc("k"), F.col("c")], concepts)
    named = best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "c"))), lambda x: x["c"]).alias("concepts"))
    vectors = mean_vectors(m.select("cluster", "embedding"), "cluster", "embedding", dim)
    out = base.join(project, "cluster", "left").join(named, "cluster", "left").join(vectors, "cluster", "left")
    return out.withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>")))


def merge(memories: DataFrame, edges: DataFrame, members: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clusters become gists: (memories, edges, mapping ``id, gist_id``).

    The sources of a cluster turn to state merged, its gist is added as an active memory with the
    id ``gist-`` and the cluster's, and the sources' edges are redirected to it.
    """
    g = gists(members, memories)
    gist_id = F.concat(F.lit("gist-"), F.col("cluster"))
    mapping = members.select("id", gist_id.alias("gist_id")).join(memories.select("id"), "id", "left_semi")
    now = F.lit(as_of).cast("timestamp_ntz")
    made = {
        "id": gist_id, "raw_id": F.col("raw_id"), "timestamp": now, "content": F.col("summary"), "summary": F.col("summary"), "concepts": F.col("concepts"),
        "embedding": F.col("v").cast("array<float>"), "salience": F.col("salience"), "access_count": F.lit(0).cast("long"), "state": F.lit("active"),
        "created_at": now, "updated_at": now, "source": F.lit("consolidation"), "project": F.col("project"),
    }
    kinds = dict(memories.dtypes)
    fresh = g.select(*[made.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in memories.columns])
    merged = memories.join(mapping.select("id", F.lit("merged").alias("_s")), "id", "left")
    merged = merged.withColumn("state", F.coalesce("_s", "state")).select(memories.columns)
    return merged.unionByName(fresh), graph.redirect(edges, mapping), mapping


def extract(memories: DataFrame, least: int = 3, salience: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """New patterns of each project: (``id, project, title, concepts, strength, v``, evidence ``pattern_id, memory_id``).

    Concept clusters of at least ``least`` active memories of that salience; the strength of a new
    pattern grows with its evidence from 0.5.
    """
    m = memories.filter((F.col("state") == "active") & (F.col("salience") >= salience))
    slim = m.select("id", F.coalesce("project", F.lit("")).alias("project"), "concepts", F.col("embedding").alias("v"), "created_at")
    members = K.by_concepts(slim, ["project"], least).select(F.col("leader").alias("cluster"), "id")
    g = gists(members, memories)
    patterns = g.select(
        F.concat(F.lit("pattern-"), F.col("cluster")).alias("id"), "project", F.col("summary").alias("title"), "concepts",
        reset_strength(F.col("n_sources")).alias("strength"), "v",
    )
    return patterns, members.select(F.concat(F.lit("pattern-"), F.col("cluster")).alias("pattern_id"), F.col("id").alias("memory_id"))


def reset_strength(n: Column) -> Column:
    """Strength of a pattern by its evidence alone: at most 0.95, or 1 above 50 pieces."""
    return F.least(F.when(n > 50, 1.0).otherwise(0.95), 0.5 + 0.03 * F.log2(1 + n))


def _near(jaccard: float, cosine: float):
    """Whether titles and vectors make near-duplicates, for rows (first axis) against leaders (second axis)."""

    def absorbs(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        wa, wb = ([set(K._low(str(x or "").split())) for x in df["title"]] for df in (a, b))
        shared = K._shared(pd.Series([sorted(w) for w in wa]), pd.Series([sorted(w) for w in wb]))
        union = np.array([len(w) for w in wb])[:, None] + np.array([len(w) for w in wa])[None, :] - shared
        words = np.where(union > 0, shared / np.maximum(union, 1), 1.0) >= jaccard
        near = K._cosines(a["v"], b["v"]) >= cosine
        na, nb = (np.array([len(str(x or "").split()) for x in df["title"]]) for df in (a, b))
        short = (nb <= 4)[:, None] | (na <= 4)[None, :]
        return np.where(short, words & near, words | near)

    return absorbs


def duplicates(items: DataFrame, keys: list[str], first: Column, jaccard: float, cosine: float) -> DataFrame:
    """keys, ``id, leader``: each item (``id, title, v``) and the one that stands for it; items come in the order of ``first``, descending.

    Items that nothing else stands for lead themselves.
    """
    df = items.select(*keys, "id", "title", "v", first.alias("created_at"))
    return K.leader_fold(df, keys, ["title", "v"], _near(jaccard, cosine), 1)


def fold_duplicates(patterns: DataFrame, evidence: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patterns with state and strength, evidence): a leader keeps the greatest strength and all evidence, the others are archived."""
    best = patterns.join(found.select("id", "leader"), "id").groupBy("leader").agg(F.max("strength").alias("_best"))
    p = patterns.join(found.select("id", "leader"), "id", "left").join(best.withColumnRenamed("leader", "id"), "id", "left")
    gone = F.col("leader").isNotNull() & (F.col("leader") != F.col("id"))
    p = p.withColumns({"state": F.when(gone, "archived").otherwise(F.col("state")), "strength": F.when(gone, F.col("strength")).otherwise(F.coalesce("_best", "strength"))})
    moved = evidence.join(found.select(F.col("id").alias("pattern_id"), "leader"), "pattern_id", "left")
    moved = moved.select(F.coalesce("leader", "pattern_id").alias("pattern_id"), "memory_id").distinct()
    return p.drop("leader", "_best"), moved


def first_similar(rows: DataFrame, heads: DataFrame, jaccard: float = 0.6, cosine: float = 0.85) -> DataFrame:
    """``id, match``: for each row (``id, title, v``) the oldest head that its title or vector is close to.

    The heads are a stated set, taken in blocks from the oldest; a row that a block has matched leaves.
    """

    def absorbs(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        wa, wb = ([set(K._low(str(x or "").split())) for x in df["title"]] for df in (a, b))
        shared = K._shared(pd.Series([sorted(w) for w in wa]), pd.Series([sorted(w) for w in wb]))
        union = np.array([len(w) for w in wb])[:, None] + np.array([len(w) for w in wa])[None, :] - shared
        return (np.where(union > 0, shared / np.maximum(union, 1), 1.0) >= jaccard) | (K._cosines(a["v"], b["v"]) >= cosine)

    return K.first_match(rows.select("id", "title", "v"), heads.select("id", "title", "v", "created_at"), ["title", "v"], absorbs)


def link_evidence(replayed: DataFrame, patterns: DataFrame, evidence: DataFrame, k: int = 3, gain: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """(new evidence ``pattern_id, memory_id, score``, patterns ``id, strength``): each replayed memory joins its ``k``
    nearest patterns if they share a concept; each joining raises the strength."""
    near = search.vector_top_k(patterns, "id", "v", replayed, "id", "v", k)
    near = near.select(F.col("query_id").alias("memory_id"), F.col("id").alias("pattern_id"), "score")
    a = replayed.select(F.col("id").alias("memory_id"), X.folded_set(F.col("concepts")).alias("ca"))
    b = patterns.select(F.col("id").alias("pattern_id"), X.folded_set(F.col("concepts")).alias("cb"))
    new = near.join(a, "memory_id").join(b, "pattern_id").filter(F.arrays_overlap("ca", "cb")).select("pattern_id", "memory_id", "score")
    new = new.join(evidence, ["pattern_id", "memory_id"], "left_anti")
    n = new.groupBy(F.col("pattern_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return new, patterns.join(n, "id", "left").select("id", F.least(F.lit(1.0), F.col("strength") + gain * F.coalesce("n", F.lit(0))).alias("strength"))


def self_test(patterns: DataFrame, evidence: DataFrame, memories: DataFrame, k: int = 10) -> DataFrame:
    """``id, passed`` of each pattern with evidence: whether the ``k`` memories nearest to its own vector hold some of it.

    A pattern without a usable vector fails.
    """
    near = search.vector_top_k(memories, "id", "v", patterns, "id", "v", k).select(F.col("query_id").alias("pattern_id"), F.col("id").alias("memory_id"))
    hit = near.join(evidence, ["pattern_id", "memory_id"], "left_semi").select(F.col("pattern_id").alias("id")).distinct().withColumn("passed", F.lit(True))
    tested = evidence.select(F.col("pattern_id").alias("id")).distinct().join(patterns.select("id"), "id", "left_semi")
    return tested.join(hit, "id", "left").select("id", F.coalesce("passed", F.lit(False)).alias("passed"))


def decay_principles(items: DataFrame, as_of: str, grace: int = 14, rate: float = 0.98, least: float = 0.3) -> DataFrame:
    """Confidence of principles by days without confirmation beyond the grace, rounded to three places; what falls below ``least`` goes."""
    days = F.floor(F.expr(f"timestampdiff(SECOND, last_confirmed, TIMESTAMP_NTZ'{as_of}')") / 86400)
    worn = F.round(F.col("confidence") * F.pow(F.lit(rate), F.greatest(F.lit(0), days - grace)), 3)
    return items.withColumn("confidence", F.when(days > grace, worn).otherwise(F.col("confidence"))).filter((days <= grace) | (F.col("confidence") >= least))


def latest(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Upsert history to current rows: the last version of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in version])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
