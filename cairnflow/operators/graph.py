"""The association graph: edges, neighbourhoods, spreading activation, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairnflow.functions import exprs as X, word_lists as W
from cairnflow.operators import pairs
from cairnflow.sources.tables import discard, materialize


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge once from either end: ``node, other`` and the edge's columns."""
    rest = [c for c in edges.columns if c not in ("source_id", "target_id")]
    forth = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("other"), *rest)
    back = edges.select(F.col("target_id").alias("node"), F.col("source_id").alias("other"), *rest)
    return forth.unionByName(back)


def degrees(edges: DataFrame) -> DataFrame:
    both = undirected(edges)
    return both.groupBy("node").agg(
        F.count(F.lit(1)).alias("degree"), F.round(F.sum("strength"), 4).alias("total_strength"), F.max("strength").alias("max_strength")
    )


def induced(edges: DataFrame, nodes: DataFrame, node: str = "id") -> DataFrame:
    """Edges with both ends in ``nodes``; two semi joins, so a null id keeps or drops nothing by accident."""
    keep = nodes.select(node).distinct()
    return edges.join(keep.select(F.col(node).alias("source_id")), "source_id", "left_semi").join(
        keep.select(F.col(node).alias("target_id")), "target_id", "left_semi"
    )


def prune(edges: DataFrame, least: float) -> DataFrame:
    return edges.filter(F.col("strength") >= least)


def links(edges: DataFrame) -> DataFrame:
    """What activation spreads over: each edge from either end with the weight of its relation, written once for any number of calls."""
    both = undirected(edges).select(
        "node", "other", "strength", F.coalesce("activation_count", F.lit(0)).alias("count"),
        X.weight_of(F.col("relation_type"), W.RELATION_WEIGHTS, 1.0).alias("weight"),
    )
    return materialize(both, "links")


def spread_activation(
    entries: DataFrame,
    edges: DataFrame,
    keys: list[str],
    hops: int = 3,
    decay: float = 0.7,
    threshold: float = 0.1,
) -> DataFrame:
    """Activation that spreads from entry points over undirected ``edges``, or their ``links``.

    ``entries``: keys, ``id, activation``.  At hop h a node passes ``activation * strength *
    decay^(h + 1) * weight of the relation`` to each neighbour if that is above ``threshold``;
    a neighbour keeps the greatest offer and the edge's ``activation_count``; only nodes that
    improved pass on in the next hop.  Returns keys, ``id, activation, activation_count, hop``
    (null for entry points that no neighbour outbid).

    A bounded number of hops, each a join and a group-by on the frontier.  The state is written
    between hops: it is read twice, and a plan that repeats itself would double with every hop.
    """
    over = edges if "node" in edges.columns else links(edges)
    state = entries.select(
        *keys, "id", F.col("activation").cast("double").alias("activation"),
        F.lit(0).cast("long").alias("activation_count"), F.lit(None).cast("int").alias("hop"), F.lit(True).alias("fresh"),
    )
    state_read = None  # the table that ``state`` is computed from
    for h in range(hops):
        state, last = materialize(state, f"activation-{h}"), state_read
        if last is not None:
            discard(last)
        state_read = state
        offer = F.round(F.col("activation") * F.col("strength") * (decay ** (h + 1)) * F.col("weight"), 12)
        offers = (
            state.filter("fresh")
            .join(over, F.col("id") == F.col("node"))
            .select(*keys, F.col("other").alias("id"), F.struct(offer.alias("p"), F.col("count").alias("c")).alias("o"))
            .filter(F.col("o.p") > threshold)
            .groupBy(*keys, "id")
            .agg(F.max("o").alias("o"))
        )
        better = F.col("o.p") > F.coalesce(F.col("activation"), F.lit(-1.0))
        state = state.join(offers, [*keys, "id"], "full_outer").select(
            *keys,
            "id",
            F.when(better, F.col("o.p")).otherwise(F.col("activation")).alias("activation"),
            F.when(better, F.col("o.c")).otherwise(F.col("activation_count")).alias("activation_count"),
            F.when(better, F.lit(h)).otherwise(F.col("hop")).alias("hop"),
            F.coalesce(better, F.lit(False)).alias("fresh"),
        )
    return state.drop("fresh")


def relation_of(seconds_apart: Column, source_known: Column, shared: Column, opposite: Column) -> Column:
    """Relation of a new edge by its rules, in order."""
    return (
        F.when(source_known & (seconds_apart > 0) & (seconds_apart < 300), "temporal")
        .when(shared >= 2, "reinforces")
        .when(opposite, "contradicts")
        .otherwise("similar")
    )


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``id, component`` of every linked id; the component is its smallest id.

    Alternates hooking every node to the least label around it and jumping to the label's
    label, so a chain of n nodes takes a logarithmic number of rounds.  The labels are written
    after each round (lineage stays short) and only a count of changes reaches the driver.
    """
    both = materialize(
        links.select(F.col(a).alias("id"), F.col(b).alias("other"))
        .unionByName(links.select(F.col(b).alias("id"), F.col(a).alias("other")))
        .filter(F.col("id") != F.col("other"))
        .distinct(),
        "component-links",
    )
    labels = materialize(
        both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component")), "component-labels"
    )
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("other"), "component"), "other").groupBy("id").agg(
            F.min("component").alias("near")
        )
        hooked = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        # what a node learns also goes to the node that its old label names
        pushed = hooked.groupBy(F.col("old").alias("id")).agg(F.min("component").alias("pushed"))
        merged = hooked.join(pushed, "id", "left").select("id", "old", F.least("component", "pushed").alias("component"))
        jumped = merged.join(
            merged.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left"
        )
        step = materialize(
            jumped.select("id", "old", F.coalesce("root", "component").alias("component")), "component-labels"
        )
        changed = step.filter(F.col("old") != F.col("component")).limit(1).count()
        discard(labels)
        labels = step.select("id", "component")
        if not changed:
            return labels
    raise RuntimeError("components did not settle; raise rounds")


def redirect(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges repointed from ``id`` to ``gist_id``; of edges that fall together the oldest stays, loops go."""
    m = mapping.select("id", "gist_id")
    moved = (
        edges.join(m.select(F.col("id").alias("source_id"), F.col("gist_id").alias("_s")), "source_id", "left")
        .join(m.select(F.col("id").alias("target_id"), F.col("gist_id").alias("_t")), "target_id", "left")
        .withColumns({"moved": F.col("_s").isNotNull() | F.col("_t").isNotNull()})
        .withColumns({"source_id": F.coalesce("_s", "source_id"), "target_id": F.coalesce("_t", "target_id")})
        .filter(F.col("source_id") != F.col("target_id"))
        .drop("_s", "_t")
    )
    first = Window.partitionBy("source_id", "target_id").orderBy("moved", "created_at", F.desc("strength"), "relation_type")
    return moved.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "moved")


def strengthen(edges: DataFrame, replayed: DataFrame, boost: float = 1.05) -> DataFrame:
    """Edges with replayed ends: times ``boost`` for each, at most 1."""
    ids = replayed.select("id").distinct().withColumn("_r", F.lit(1))
    n = F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))
    return (
        edges.join(ids.select(F.col("id").alias("source_id"), F.col("_r").alias("_a")), "source_id", "left")
        .join(ids.select(F.col("id").alias("target_id"), F.col("_r").alias("_b")), "target_id", "left")
        .withColumns({"strength": F.least(F.lit(1.0), F.col("strength") * F.pow(F.lit(boost), n)), "activation_count": F.col("activation_count") + n})
        .drop("_a", "_b")
    )


def shared_concept_pairs(memories: DataFrame, least: int, share: float = 0.0, without: DataFrame | None = None) -> DataFrame:
    """``a, b, shared`` (a < b) of memories with at least ``least`` equal concepts (without letter case), and at least the
    ``share`` of the longer list, but not the pairs ``without``; they are counted block against block (``pairs.sharing``)."""
    lists = memories.select("id", X.folded_set(F.col("concepts")).alias("cs"))
    return pairs.sharing(lists, least, share, without)


def strongest_per_pair(edges: DataFrame) -> DataFrame:
    """Of the edges of an unordered pair: explicit before derived, then the strongest."""
    pair = edges.withColumns({"a": F.least("source_id", "target_id"), "b": F.greatest("source_id", "target_id")})
    w = Window.partitionBy("a", "b").orderBy("is_auto", F.desc("strength"), "kind")
    return pair.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("a", "b", "kind", "strength", "is_auto")


def explicit_edges(items: DataFrame, item_id: str, metadata: str) -> DataFrame:
    """Edges that the metadata of new memories name: ``source_id, target_id, strength, relation_type, activation_count``.

    ``associations`` is a list of objects with ``memory_id`` and ``relation``; entries without either, broken JSON and
    null metadata give none.  Repeated entries count once.
    """
    entries = F.from_json(F.get_json_object(metadata, "$.associations"), "array<struct<memory_id:string,relation:string>>")
    e = items.select(F.col(item_id).alias("source_id"), F.explode(entries).alias("e"))
    named = (F.coalesce("e.memory_id", F.lit("")) != "") & (F.coalesce("e.relation", F.lit("")) != "")
    return e.filter(named).select(
        "source_id", F.col("e.memory_id").alias("target_id"), F.lit(0.9).alias("strength"), F.col("e.relation").alias("relation_type"), F.lit(1).alias("activation_count")
    ).distinct()


def set_strength(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges with the ``strength`` of the change for their pair (``a, b``), whichever way either is written; the greatest of several."""
    pair = [F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b")]
    new = changes.select(*pair, F.col("strength").alias("_s")).groupBy("_a", "_b").agg(F.max("_s").alias("_s"))
    e = edges.withColumns({"_a": F.least("source_id", "target_id"), "_b": F.greatest("source_id", "target_id")})
    return e.join(new, ["_a", "_b"], "left").withColumn("strength", F.coalesce("_s", "strength")).select(edges.columns)


def activate(edges: DataFrame, traversed: DataFrame, as_of: str) -> DataFrame:
    """Edges with one more activation for each traversal (``source_id, target_id``), stamped with the moment."""
    n = traversed.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("_n"))
    e = edges.join(n, ["source_id", "target_id"], "left")
    now = F.when(F.col("_n").isNotNull(), F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("last_activated"))
    return e.withColumns({"activation_count": F.coalesce("activation_count", F.lit(0)) + F.coalesce("_n", F.lit(0)), "last_activated": now}).select(edges.columns)


def adjust(memories: DataFrame, edges: DataFrame, good: DataFrame, bad: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reinforcing and weakening by feedback: (memories, edges).

    Each mention of a memory in ``good`` (``id``) adds 0.02 salience, up to 1, and multiplies the strength of its edges by
    1.05, up to 1; then each in ``bad`` takes 0.01 and multiplies by 0.95, both not below 0.05.
    """
    n = (
        good.select("id", F.lit(1).alias("g"), F.lit(0).alias("b")).unionByName(bad.select("id", F.lit(0).alias("g"), F.lit(1).alias("b")))
        .groupBy("id").agg(F.sum("g").alias("_g"), F.sum("b").alias("_b"))
    )
    up = F.least(F.lit(1.0), F.col("salience") + 0.02 * F.coalesce("_g", F.lit(0)))
    down = F.when(F.coalesce("_b", F.lit(0)) > 0, F.greatest(F.lit(0.05), up - 0.01 * F.col("_b"))).otherwise(up)
    m = memories.join(n, "id", "left").withColumn("salience", down).select(memories.columns)
    ends = [n.select(F.col("id").alias(c), F.col("_g").alias(f"_g{k}"), F.col("_b").alias(f"_b{k}")) for k, c in enumerate(("source_id", "target_id"))]
    e = edges.join(ends[0], "source_id", "left").join(ends[1], "target_id", "left")
    g, b = (sum((F.coalesce(f"{x}{k}", F.lit(0)) for k in (0, 1)), F.lit(0)) for x in ("_g", "_b"))
    up = F.when(g > 0, F.least(F.lit(1.0), F.col("strength") * F.pow(F.lit(1.05), g))).otherwise(F.col("strength"))
    down = F.when(b > 0, F.greatest(F.lit(0.05), up * F.pow(F.lit(0.95), b))).otherwise(up)
    return m, e.withColumn("strength", down).select(edges.columns)
