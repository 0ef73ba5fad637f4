"""The text-corpus pipeline: cleaners, filters, budgets, shards, gates, splits, triplets."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cairnflow.functions import exprs as X, word_lists as W
from cairnflow.operators import chunks

_STRIP = r"(?U)^\s+|\s+$"


def nfkc(c: Column) -> Column:
    """Compatibility normal form (Arrow batches); ASCII text passes untouched."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    return run(c)


def tidy(c: Column) -> Column:
    """Line ends, runs of empty lines and outer blanks; without Unicode normalisation (all in the JVM)."""
    lines = F.regexp_replace(c, "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, "\n{3,}", "\n\n"), _STRIP, "")


def normalize(c: Column) -> Column:
    return tidy(nfkc(c))


# fixed values: the patterns of the cleaners below define their results
def clean_paper(t: Column) -> Column:
    """Without mark-up commands, citations, environments, inline formula signs, figure references and the reference list."""
    t = F.regexp_replace(t, r"\\(?:textbf|textit|emph|underline)\{([^}]*)\}", "$1")
    t = F.regexp_replace(t, r"\\(?:cite|ref|label|eqref)\{[^}]*\}", "")
    t = F.regexp_replace(t, r"\\(?:begin|end)\{[^}]*\}", "")
    t = F.regexp_replace(t, r"\$([^$]+)\$", "$1")
    t = F.regexp_replace(t, r"(?i)[\[(](?:Figure|Fig\.|Table|Tab\.)\s*\d+[)\]]", "")
    half = F.floor(F.length(t) / 2).cast("int")
    tail = F.substr(t, half + 1)
    cut = F.regexp_instr(tail, F.lit(r"(?i)\n\s*References\s*\n"))
    return F.regexp_replace(F.when(cut > 0, F.left(t, half + cut - 1)).otherwise(t), _STRIP, "")


def clean_code(t: Column) -> Column:
    return F.regexp_replace(t, r"[ \t\f\x0B]+(?=\n|$)", "")


def clean_answer(t: Column) -> Column:
    """Code tags as backticks, other tags away, five entities decoded."""
    t = F.regexp_replace(F.regexp_replace(t, "(?s)<code>(.*?)</code>", "`$1`"), "<[^>]+>", "")
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def clean_commit(t: Column, lines: int = 100) -> Column:
    parts = F.split(t, "\n")
    return F.when(
        F.size(parts) > lines, F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), F.lit("\n[diff truncated]"))
    ).otherwise(t)


#: How a source is cleaned, by the start of its name.
CLEANERS = {"papers": clean_paper, "code": clean_code, "mail": clean_answer, "commits": clean_commit}


def clean_documents(docs: DataFrame, text: str = "text", source: str = "source", least: int = 100, unicode: bool = True) -> DataFrame:
    """``text`` cleaned by its source, documents shorter than ``least`` characters dropped."""
    base = normalize(F.col(text)) if unicode else tidy(F.col(text))
    d = docs.withColumn("_t", base)
    out = None
    for start, f in CLEANERS.items():
        test, value = F.col(source).startswith(start), f(F.col("_t"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return d.withColumn(text, out.otherwise(F.col("_t"))).drop("_t").filter(F.length(text) >= least)


def ascii_share(c: Column, n: int = 1000) -> Column:
    head = F.left(c, F.lit(n))
    return F.length(F.regexp_replace(head, r"[^\x00-\x7F]", "")) / F.greatest(F.length(head), F.lit(1))


def generated(c: Column) -> Column:
    return X.any_of(F.lower(F.left(c, F.lit(500))), W.GENERATED_MARKERS)


def code_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    return docs.filter(F.length(t).between(50, 100_000) & (ascii_share(t) >= 0.5) & ~generated(t))


def token_budget(docs: DataFrame, source: str, order: Sequence[str], tokens: str, budget: int) -> DataFrame:
    """Documents of each source in order until the budget is reached; the crossing one is kept.

    The running sums are those of ``offsets`` over (source, order) less the source's first one, so a source
    that holds most documents is summed in many tasks."""
    o = offsets(docs, [source, *order], tokens)
    first = o.groupBy(F.col(source).alias("_source")).agg(F.min("offset").alias("_first"))
    placed = o.join(first, F.col(source).eqNullSafe(F.col("_source")))
    return placed.withColumn("before", F.col("offset") - F.col("_first")).filter(F.col("before") < budget).drop("offset", "_source", "_first")


def offsets(docs: DataFrame, order: Sequence[str], tokens: str) -> DataFrame:
    """Adds ``offset``: tokens of all documents before, in the order; by prefix sums over range chunks.

    A running sum over everything would be one task.  The rows are range-partitioned, summed per
    partition, the few partition totals are accumulated and each row adds its partition's start.
    """
    from cairnflow.sources.tables import materialize

    parts = materialize(
        docs.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()),
        "offsets",
    )
    totals = parts.groupBy("_p").agg(F.sum(tokens).alias("_s"))
    starts = totals.withColumn(
        "_start", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("_p", "_start")
    w = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(tokens).over(w), F.lit(0))
    return parts.join(F.broadcast(starts), "_p").withColumn("offset", F.col("_start") + own).drop("_p", "_start")


def shards(docs: DataFrame, order: Sequence[str], tokens: str, size: int) -> DataFrame:
    """``shard`` of every document piece: ``first_shard, last_shard`` by its token offsets; pieces straddle shards."""
    o = offsets(docs, order, tokens)
    end = F.greatest(F.col("offset") + F.col(tokens) - 1, F.col("offset"))
    return o.withColumns({"first_shard": F.expr(f"offset div {size}"), "last_shard": F.floor(end / size).cast("long")})


def token_windows(docs: DataFrame, doc_id: str, ids: str, length: int) -> DataFrame:
    """Windows of ``length + 1`` tokens at a stride of ``length``; the last one may be short, none of one token."""
    n = F.size(ids)
    starts = F.sequence(F.lit(0), n - 2, F.lit(length))
    d = docs.filter(n >= 2).select(doc_id, ids, F.explode(starts).alias("start"))
    return d.select(doc_id, "start", F.slice(F.col(ids), F.col("start") + 1, length + 1).alias("window"))


def mix_audit(docs: DataFrame, group: str, tokens: str, weights: dict[str, float]) -> DataFrame:
    """Actual against wanted share of each group: ``group, tokens, actual, wanted, delta, flagged``."""
    spark = docs.sparkSession
    want = spark.createDataFrame([(k, float(v) / sum(weights.values())) for k, v in weights.items()], f"{group} string, wanted double")
    n = docs.groupBy(group).agg(F.sum(tokens).alias("tokens"))
    total = Window.partitionBy(F.lit(1))
    both = want.join(n, group, "full_outer").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    share = 100 * F.col("tokens") / F.sum("tokens").over(total)
    return both.select(
        group, "tokens", F.round(share, 4).alias("actual"), F.round(100 * F.coalesce("wanted", F.lit(0.0)), 4).alias("wanted")
    ).withColumn("delta", F.round(F.col("actual") - F.col("wanted"), 4)).withColumn("flagged", F.abs("delta") > 5)


def sample_share(docs: DataFrame, key: str, share: float) -> DataFrame:
    """A deterministic sample: rows whose MD5 of the key falls below the share."""
    h = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return docs.filter(h < int(share * 2**32))


def split_eval(docs: DataFrame, key: str, share: float = 0.1) -> DataFrame:
    """Adds ``part``: train or eval, by the MD5 of the key, so a row's part never depends on the others."""
    h = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return docs.withColumn("part", F.when(h < int(share * 2**32), "eval").otherwise("train"))


def length_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """min, max, mean, median and the element at place int(0.95 n), per key; the places from counts per value."""
    d = df.filter(F.col(value).isNotNull()).select(*keys, value)
    out = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.round(F.avg(value), 6).alias("mean")
    )
    for name, share in (("median", 0.5), ("p95", 0.95)):
        at = chunks.nth(d, keys, value, share).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(value).alias(name))
        test = F.lit(True)
        for k in keys:
            test = test & F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = out.join(at, test).drop(*[f"_{k}" for k in keys])
    return out


_FIELDS = "gist summary content narrative concepts structured_concepts significance emotional_tone outcome salience".split()


def gate(examples: DataFrame, response: str) -> DataFrame:
    """Adds ``failures`` and ``warnings`` of the quality gate to captured responses (JSON text).

    Groups of checks end the list, as each needs the ones before: parsing, missing fields,
    types, values; the soft checks only run on what passed."""
    v = F.col(response)
    parsed = F.try_parse_json(v)
    is_object = parsed.isNotNull() & v.rlike(r"(?s)^\s*\{")
    get = lambda name: F.get_json_object(v, f"$.{name}")
    kind = lambda name: F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))
    keep = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    present = F.json_object_keys(F.when(is_object, v))
    missing = keep(*[F.when(~F.coalesce(F.array_contains(present, f), F.lit(False)), f"missing_field:{f}") for f in _FIELDS])
    types = keep(
        F.when(~F.coalesce(kind("gist") == "STRING", F.lit(False)), "gist_not_string"),
        F.when(~F.coalesce(kind("summary") == "STRING", F.lit(False)), "summary_not_string"),
        F.when(~F.coalesce(kind("concepts").startswith("ARRAY"), F.lit(False)), "concepts_not_array"),
        F.when(~F.coalesce(kind("salience").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False)), "salience_not_number"),
    )
    sal = get("salience").try_cast("double")
    enum = lambda name, ok: F.when((F.coalesce(get(name), F.lit("")) != "") & ~get(name).isin(ok), F.concat(F.lit(f"invalid_{name}:"), get(name)))
    values = keep(
        F.when(F.length(get("gist")) > 60, F.concat(F.lit("gist_too_long:"), F.length(get("gist")).cast("string"))),
        F.when(F.length(get("summary")) > 100, F.concat(F.lit("summary_too_long:"), F.length(get("summary")).cast("string"))),
        F.when(~sal.between(0, 1), F.concat(F.lit("salience_out_of_range:"), get("salience"))),
        enum("significance", W.SIGNIFICANCES), enum("emotional_tone", W.TONES), enum("outcome", W.OUTCOMES),
        F.when(F.lower(F.trim(get("gist"))).isin(W.PLACEHOLDER_GISTS), "placeholder_gist"),
        F.when(F.trim(F.coalesce(get("content"), F.lit(""))) == "", "empty_content"),
    )
    concepts = F.from_json(get("concepts"), "array<string>")
    n = F.coalesce(F.size(concepts), F.lit(0))
    hits = F.size(F.filter(concepts, lambda c: F.lower(c).isin(W.CONTROLLED_VOCABULARY)))
    soft = keep(
        F.when((n > 0) & (hits / F.greatest(n, F.lit(1)) < 0.3), F.concat(F.lit("low_vocab_coverage:"), F.format_string("%.2f", hits / F.greatest(n, F.lit(1))))),
        F.when(F.length(F.coalesce(get("narrative"), F.lit(""))) < 20, F.concat(F.lit("short_narrative:"), F.length(F.coalesce(get("narrative"), F.lit(""))).cast("string"))),
        F.when((sal > 0.9) & (get("significance") == "routine"), "high_salience_routine"),
        F.when((sal < 0.1) & get("significance").isin("important", "critical"), "low_salience_important"),
        F.when((F.length(get("content")) > 200) & (n < 3), F.concat(F.lit("few_concepts:"), n.cast("string"))),
    )
    failures = (
        F.when(~F.coalesce(is_object, F.lit(False)), F.array(F.lit("json_parse_failure")))
        .when(F.size(missing) > 0, missing).when(F.size(types) > 0, types).otherwise(values)
    )
    d = examples.withColumn("failures", failures)
    return d.withColumn("warnings", F.when(F.size("failures") == 0, soft).otherwise(none))


def gate_statistics(gated: DataFrame) -> DataFrame:
    """``reason, n``: failures and warnings by their name before the colon, and what passed."""
    all_ = F.concat("failures", "warnings")
    reasons = gated.select(F.explode(F.when(F.size(all_) == 0, F.array(F.lit("passed"))).otherwise(all_)).alias("r"))
    return reasons.groupBy(F.split_part("r", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def triplets(memories: DataFrame, edges: DataFrame, least: float = 0.7) -> DataFrame:
    """``anchor, positive, negative, relation``: strong links as positives, and for each a memory of
    the same project that is not linked to the anchor as negative.

    The memories of a project stand on a ring in the order of their hash, and an anchor takes the
    next one that it is not linked to, all the way round: the linked ones are turned into
    distances from the anchor, and the first distance missing among them is the place.  No pairs
    of a project are formed.  Only an anchor linked to its whole project gets a null negative."""
    text = F.left(F.concat_ws(" ", "summary", "content"), F.lit(2000))
    ok = memories.filter((F.col("state") != "archived") & (F.length(text) >= 20)).select("id", F.coalesce("project", F.lit("")).alias("project"))
    pair = edges.filter(F.col("strength") >= least).withColumns({"a": F.least("source_id", "target_id"), "b": F.greatest("source_id", "target_id")})
    w = Window.partitionBy("a", "b").orderBy(F.desc("strength"), "source_id")
    pos = pair.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    pos = pos.join(ok.select(F.col("id").alias("a")), "a", "left_semi").join(ok.select(F.col("id").alias("b")), "b", "left_semi")
    hashed = chunks.chunked(ok.withColumn("_h", F.md5("id")), ["project"], ["_h", "id"])
    size = ok.groupBy("project").agg(F.count(F.lit(1)).alias("size"))
    numbered = chunks.numbered(hashed, ["project"], ["_h", "id"], "at").withColumn("at", F.col("at") - 1)
    placed = numbered.drop("_h", "_p").join(size, "project")
    anchors = placed.join(pos.select(F.col("source_id").alias("id")).distinct(), "id", "left_semi").withColumnRenamed("id", "anchor")
    linked = edges.select(F.col("source_id").alias("anchor"), F.col("target_id").alias("id")).unionByName(
        edges.select(F.col("target_id").alias("anchor"), F.col("source_id").alias("id"))
    )
    others = placed.select("id", F.col("project").alias("_project"), F.col("at").alias("_at"))
    near = anchors.join(linked.filter("anchor <> id").distinct(), "anchor").join(others, "id").filter("project = _project")
    near = near.select("anchor", F.pmod(F.col("_at") - F.col("at"), F.col("size")).alias("far"))
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("anchor").orderBy("far")))
    run = near.filter("far = _n").groupBy("anchor").agg(F.count(F.lit(1)).alias("run"))
    first = anchors.join(run, "anchor", "left").withColumn("far", F.coalesce("run", F.lit(0)) + 1).filter("far < size")
    first = first.select("anchor", "project", F.pmod(F.col("at") + F.col("far"), F.col("size")).alias("at"))
    free = first.join(placed.select("project", F.col("at").cast("long").alias("at"), F.col("id").alias("negative")), ["project", "at"]).select("anchor", "negative")
    return pos.select(F.col("source_id").alias("anchor"), F.col("target_id").alias("positive"), F.col("relation_type").alias("relation"), "strength").join(free, "anchor", "left")
