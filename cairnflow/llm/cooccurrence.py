"""Items that appear together, by blocking of large baskets.

Only items frequent enough to be in a reported pair take part (a pair is never more frequent
than its rarer item, so this loses nothing).  Small baskets give their pairs at once.  A huge
basket is cut into chunks of items, each pair of chunks becomes a row of its own and these rows
are spread over the tasks, so no task ever holds the square of a basket.  Both kinds of pairs
are counted together with map-side partial sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cairnflow.sources.tables import materialize

#: Items of a chunk; baskets up to this size are not cut.
CHUNK = 64
#: A frequency table of at most so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def clean_items(items: DataFrame, array: str) -> DataFrame:
    """``basket``: the distinct, trimmed, lower-cased items that are not blank; empty ones dropped."""
    trimmed = F.transform(F.col(array), lambda x: F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    basket = F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != "")))
    return items.select(basket.alias("basket")).filter(F.size("basket") > 0)


def pair_counts(baskets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``a, b, n_ab`` with a < b over ``codes``, sorted arrays of distinct codes."""

    def within(c):
        return F.flatten(
            F.transform(c, lambda x, i: F.transform(F.slice(c, i + 2, F.size(c)), lambda y: F.struct(x.alias("a"), y.alias("b"))))
        )

    def across(c, d):
        return F.flatten(F.transform(c, lambda x: F.transform(d, lambda y: F.struct(x.alias("a"), y.alias("b")))))

    small = baskets.filter(F.size("codes") <= chunk).select(F.explode(within(F.col("codes"))).alias("p"))
    starts = F.expr(f"sequence(1, size(codes), {chunk})")
    large = (
        baskets.filter(F.size("codes") > chunk)
        .select("codes", F.explode(starts).alias("i"))
        .select("codes", "i", F.explode(F.expr(f"sequence(i, size(codes), {chunk})")).alias("j"))
        .select(
            F.slice("codes", F.col("i"), chunk).alias("c"),
            F.when(F.col("i") < F.col("j"), F.slice("codes", F.col("j"), chunk)).alias("d"),
            F.rand(7).alias("r"),
        )
        .repartition("r")
        .select(F.explode(F.when(F.col("d").isNull(), within(F.col("c"))).otherwise(across(F.col("c"), F.col("d")))).alias("p"))
    )
    return (
        small.unionByName(large)
        .groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b"))
        .agg(F.count(F.lit(1)).alias("n_ab"))
    )


def associations(
    items: DataFrame,
    array: str,
    min_pairs: int = 5,
    one_in: int = 500,
    min_lift: float = 4.0,
    chunk: int = CHUNK,
) -> DataFrame:
    """Pairs of items that occur together in at least ``min_pairs`` baskets and in at least
    one of ``one_in``, at least ``min_lift`` times as often as chance.

    Columns: ``item_a, item_b`` (cleaned, smaller first), ``n_ab, n_a, n_b, n, lift, pmi``.
    Null arrays, null and blank items are dropped; an item counts once per basket; ``n`` is
    the number of baskets with an item left.  No basket at all gives no rows.
    """
    spark = items.sparkSession
    baskets = materialize(clean_items(items, array).withColumn("rid", F.monotonically_increasing_id()), "baskets")
    n = baskets.count()
    floor = max(min_pairs, -(-n // one_in))
    freq = (
        baskets.select(F.explode("basket").alias("item"))
        .groupBy("item")
        .agg(F.count(F.lit(1)).alias("n_item"))
        .filter(F.col("n_item") >= floor)
    )
    freq = materialize(freq.withColumn("code", F.monotonically_increasing_id()), "frequent-items")
    side = F.broadcast(freq) if freq.count() <= BROADCAST_ROWS else freq
    codes = (
        baskets.select("rid", F.explode("basket").alias("item"))
        .join(side, "item")
        .groupBy("rid")
        .agg(F.array_sort(F.collect_list("code")).alias("codes"))
        .filter(F.size("codes") > 1)
    )
    pairs = pair_counts(codes, chunk).filter(F.col("n_ab") >= floor)
    fa = side.select(F.col("code").alias("a"), F.col("item").alias("ia"), F.col("n_item").alias("na"))
    fb = side.select(F.col("code").alias("b"), F.col("item").alias("ib"), F.col("n_item").alias("nb"))
    swap = F.col("ia") > F.col("ib")

    def pick(x: str, y: str):
        return F.when(swap, F.col(y)).otherwise(F.col(x))

    scored = pairs.join(fa, "a").join(fb, "b").select(
        pick("ia", "ib").alias("item_a"),
        pick("ib", "ia").alias("item_b"),
        "n_ab",
        pick("na", "nb").alias("n_a"),
        pick("nb", "na").alias("n_b"),
        F.lit(n).cast("long").alias("n"),
    )
    lift = F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    exact = F.col("n_ab").cast("decimal(20,0)") * F.col("n") >= F.lit(min_lift).cast("decimal(10,4)") * (
        F.col("n_a").cast("decimal(12,0)") * F.col("n_b").cast("decimal(12,0)")
    )
    return scored.filter(exact).withColumns({"lift": lift, "pmi": F.log2(lift)})
