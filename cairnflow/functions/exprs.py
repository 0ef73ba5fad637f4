"""Column expressions: text, sets, vectors, hashes and scores.  All run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from cairnflow.functions import word_lists as W

BLANK = r"[ \t\n\r\f\x0B]"


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def weight_of(c: Column, weights: dict, default: float) -> Column:
    """Weight of a value by a small fixed table."""
    out = None
    for k, v in weights.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default))


def any_of(c: Column, parts, whole: bool = False) -> Column:
    """Whether the text contains (or is) one of the parts."""
    return reduce(lambda a, b: a | b, [(c == p) if whole else c.contains(p) for p in parts])


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def fields(c: Column) -> Column:
    """Runs of non-blank characters; null gives an empty array."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), BLANK + "+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(fields(c))


def tokens(c: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def truncate(c: Column, n: int) -> Column:
    """At most ``n`` characters, then an ellipsis."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def read_head(c: Column, n: int, mark: str = "\n[truncated]") -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(mark))).otherwise(c)


def query_terms(c: Column) -> Column:
    """Search terms of a query: ASCII letters and digits of each word, lower case, no stop words."""
    cleaned = F.transform(fields(c), lambda x: F.lower(F.regexp_replace(x, "[^A-Za-z0-9]", "")))
    stop = lit_array(W.QUERY_STOP_WORDS)
    return F.filter(cleaned, lambda x: (F.length(x) >= 2) & ~F.array_contains(stop, x))


def match_expression(c: Column) -> Column:
    """Prefix-match expression of a query: ``term* OR term*``."""
    return F.array_join(F.transform(query_terms(c), lambda x: F.concat(x, F.lit("*"))), " OR ")


def query_concepts(c: Column) -> Column:
    stop = lit_array(W.CONCEPT_STOP_WORDS)
    trimmed = F.transform(fields(F.lower(c)), lambda x: F.regexp_replace(x, "^[.,!?;:\"']+|[.,!?;:\"']+$", ""))
    return F.filter(trimmed, lambda x: (F.length(x) > 2) & ~F.array_contains(stop, x))


def keywords(c: Column, n: int = 10) -> Column:
    stop = lit_array(W.KEYWORD_STOP_WORDS)
    kept = F.filter(fields(F.lower(c)), lambda x: (F.length(x) >= 3) & ~F.array_contains(stop, x))
    return F.slice(F.array_distinct(kept), 1, n)


def folded_set(c: Column) -> Column:
    """Distinct lower-cased elements without nulls; null arrays count as empty."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.transform(F.filter(F.coalesce(c, none), lambda x: x.isNotNull()), lambda x: F.lower(x)))


def dedup_keep_first(c: Column) -> Column:
    """Case-insensitive duplicates removed, the first spelling kept."""
    start = F.array().cast("array<string>")
    return F.aggregate(
        F.coalesce(c, start),
        start,
        lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)),
    )


def clean_concepts(c: Column) -> Column:
    """Lower-cased, trimmed, without labels and over-general terms, distinct."""
    none = F.array().cast("array<string>")
    cs = F.transform(F.coalesce(c, none), lambda x: F.lower(F.trim(x)))
    n = F.size(F.coalesce(c, none))
    return F.array_distinct(
        F.filter(
            cs,
            lambda x: (x != "")
            & ~x.contains(":")
            & ~x.startswith("source")
            & ~x.startswith("type")
            & (x != "general")
            & ~((x == "memory") & (n > 3)),
        )
    )


def default_concepts(content: Column, kind: Column, source: Column) -> Column:
    """Source and type labels and the first plain words, five in all."""
    common = lit_array(W.COMMON_WORDS)
    strip = "^[.,;:!?\"'()\\[\\]{}\\-/\\\\]+|[.,;:!?\"'()\\[\\]{}\\-/\\\\]+$"
    words = F.transform(fields(content), lambda x: F.lower(F.regexp_replace(x, strip, "")))
    plain = F.filter(
        words,
        lambda x: (F.length(x) > 4)
        & (F.length(x) < 40)
        & (F.length(F.regexp_replace(x, "[^a-z0-9_-]", "")) >= 0.8 * F.length(x))
        & ~F.array_contains(common, x),
    )
    labels = F.filter(
        F.array(
            F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.lit("source:"), source)),
            F.when(F.coalesce(kind, F.lit("")) != "", F.concat(F.lit("type:"), kind)),
        ),
        lambda x: x.isNotNull(),
    )
    out = F.slice(F.concat(labels, F.array_distinct(plain)), 1, 5)
    return F.when(F.size(out) == 0, lit_array(["fallback", "unprocessed"])).otherwise(out)


def path_concepts(path: Column) -> Column:
    stem = F.regexp_replace(path, r"\.[^./]*$", "")
    noise = lit_array(W.PATH_NOISE)
    parts = F.transform(F.split(stem, r"[/\\_.\-]"), lambda x: F.lower(x))
    return F.array_distinct(
        F.filter(parts, lambda x: (F.length(x) > 2) & ~F.array_contains(noise, x) & ~x.rlike("^[0-9x]+$"))
    )


def command_concepts(c: Column) -> Column:
    parts = fields(c)
    first = F.lower(F.get(parts, F.lit(0)))
    sub = F.get(F.filter(F.slice(parts, 2, 1_000_000), lambda x: ~x.startswith("-")), F.lit(0))
    both = F.filter(
        F.array(first, F.when(first.isin(W.COMPOUND_COMMANDS), F.lower(sub))), lambda x: x.isNotNull()
    )
    return both


def event_verb(kind: Column) -> Column:
    return F.when(kind.startswith("file_"), F.substring(kind, 6, 1_000)).otherwise(F.lit(""))


def shared_count(a: Column, b: Column) -> Column:
    """Elements of ``b`` (repeats counted) that ``a`` holds, without letter case."""
    low = folded_set(a)
    none = F.array().cast("array<string>")
    return F.size(F.filter(F.coalesce(b, none), lambda x: F.array_contains(low, F.lower(x))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unequal or zero vectors."""
    n = norm(a) * norm(b)
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (n > 0)
    return F.when(usable, dot(a, b) / n).otherwise(F.lit(0.0))


def usable_vector(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def content_hash(*parts: Column) -> Column:
    """16 bytes of the SHA-256 of the parts joined by NUL."""
    return F.left(F.sha2(F.concat_ws("\0", *[F.coalesce(p, F.lit("")) for p in parts]), 256), F.lit(32))


def keyword_score(content: Column) -> Column:
    low = F.lower(content)
    terms = [
        F.when(low.contains(word), F.lit(weight)).otherwise(F.lit(0.0))
        for weight, words in W.KEYWORD_WEIGHTS
        for word in words
    ]
    return reduce(lambda a, b: a + b, terms)


def first_salience(source: Column, content: Column) -> Column:
    low = F.lower(content)
    base = weight_of(source, {"user": 0.7, "terminal": 0.5, "filesystem": 0.4, "clipboard": 0.45, "ingest": 0.6}, 0.5)
    add = lambda words, x: F.when(any_of(low, words), F.lit(x)).otherwise(F.lit(0.0))
    total = (
        base
        + add(["error", "fail", "panic"], 0.15)
        + add(["todo", "important", "fixme"], 0.1)
        + add(["decision", "decided", "chose"], 0.1)
        + F.when(F.octet_length(content) > 500, F.lit(0.05)).otherwise(F.lit(0.0))
    )
    return F.least(F.lit(1.0), total)


def contradicts(a: Column, b: Column) -> Column:
    x, y = F.lower(a), F.lower(b)
    pairs = [(x.contains(p) & y.contains(q)) | (x.contains(q) & y.contains(p)) for p, q in W.OPPOSITES]
    return reduce(lambda p, q: p | q, pairs)


def sensitive_file(path: Column) -> Column:
    return any_of(F.lower(F.element_at(F.split(path, "/"), -1)), W.SENSITIVE_NAMES)


def binary_file(path: Column) -> Column:
    base = F.element_at(F.split(F.lower(path), "/"), -1)
    return base.contains(".") & F.element_at(F.split(base, r"\."), -1).isin(W.BINARY_EXTENSIONS)


def binary_content(c: Column) -> Column:
    """More than a tenth of the first 512 characters are control characters."""
    head = F.left(c, F.lit(512))
    rest = F.regexp_replace(head, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return (F.length(head) > 0) & ((F.length(head) - F.length(rest)) / F.greatest(F.length(head), F.lit(1)) > 0.1)


def excluded_path(path: Column, patterns) -> Column:
    return any_of(F.concat(path, F.lit("/")), patterns)


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>?|>", " "), r"\s+", " "))


def markup_share(c: Column) -> Column:
    head = F.left(F.trim(c), F.lit(2001))
    return (F.length(head) - F.length(F.regexp_replace(head, "<[^>]*>?", ""))) / F.greatest(F.length(head), F.lit(1))


def json_in_prose(c: Column) -> Column:
    """The JSON object in a text: as it is, inside a fence, or from the first to the last brace."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(F.trim(c).startswith("{"), F.trim(c)).when(fenced != "", fenced).when(braces != "", braces)


def short_duration(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, F.format_string("%ds", seconds.cast("long")))
        .when(seconds < 3600, F.format_string("%dm", (seconds / 60).cast("long")))
        .when(seconds < 86400, F.format_string("%dh", (seconds / 3600).cast("long")))
        .otherwise(F.format_string("%dd", (seconds / 86400).cast("long")))
    )
