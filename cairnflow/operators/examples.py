"""Filters of raw corpora, the source mix, and training examples from captured calls and stored memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairnflow.functions import exprs as X, word_lists as W
from cairnflow.operators import corpus as C


def web_filter(pages: DataFrame, text: str = "text", score: str = "score", least: float = 3.0) -> DataFrame:
    """Pages with a quality score of at least ``least`` and 100 to 50,000 characters; null scores and texts go."""
    return pages.filter((F.col(score) >= least) & F.length(text).between(100, 50_000))


def classify_papers(papers: DataFrame, text: str = "text", fields: str = "fields", head: int = 5_000) -> DataFrame:
    """Papers with their ``subject``: neuro before cs, each by a field of study and a keyword in the first ``head`` characters.

    Papers of neither and texts below 200 characters are dropped."""
    start = F.left(F.col(text), F.lit(head))
    named = X.folded_set(F.transform(F.coalesce(fields, F.array().cast("array<string>")), lambda x: F.trim(x)))
    neuro = F.arrays_overlap(named, X.lit_array(W.NEURO_FIELDS)) & start.rlike("(?i)" + "|".join(W.NEURO_KEYWORDS))
    cs = F.arrays_overlap(named, X.lit_array(W.CS_FIELDS)) & start.rlike("(?i)" + "|".join(W.CS_KEYWORDS))
    return papers.withColumn("subject", F.when(neuro, "neuro").when(cs, "cs")).filter(F.col("subject").isNotNull() & (F.length(text) >= 200))


def posts(rows: DataFrame, least: int = 3) -> DataFrame:
    """Questions (type 1) and answers (type 2) of some score as documents: ``id, text``.

    ``rows``: ``id, post_type, score, tags`` (an array or ``<a><b>``), ``title, body``.  Questions need a wanted tag; the
    title stands before the body; cleaned texts below 100 characters go."""
    raw = F.lower(F.col("tags"))
    tags = F.filter(F.split(F.regexp_replace(raw, "[<>]", " "), " "), lambda x: x != "")
    wanted = F.coalesce(F.arrays_overlap(tags, X.lit_array(W.POST_TAGS)), F.lit(False))
    kept = rows.filter(F.col("post_type").isin(1, 2) & (F.coalesce("score", F.lit(0)) >= least) & ((F.col("post_type") != 1) | wanted))
    titled = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.col("title"), F.lit("\n\n"), F.coalesce("body", F.lit("")))).otherwise(F.coalesce("body", F.lit("")))
    return kept.select("id", C.clean_answer(titled).alias("text")).filter(F.length("text") >= 100)


def commit_documents(commits: DataFrame, quota: int | None = None) -> DataFrame:
    """``id, lang, text`` of commits (``id, lang, subject, message, old, new``): subject, message and the first lines of what changed.

    Thirty lines of the old and the new content, or fifty of a new file.  Commits without a subject are dropped; with a
    ``quota`` so many of each language stay, by id."""
    lines = lambda c, n: F.array_join(F.slice(F.split(c, "\n"), 1, n), "\n")
    subject, message = F.trim(F.coalesce("subject", F.lit(""))), F.trim(F.coalesce("message", F.lit("")))
    old, new = F.coalesce("old", F.lit("")), F.coalesce("new", F.lit(""))
    body = (
        F.when((old != "") & (new != ""), F.concat(F.lit("\n\nBefore:\n"), lines(old, 30), F.lit("\n\nAfter:\n"), lines(new, 30)))
        .when(new != "", F.concat(F.lit("\n\nNew file:\n"), lines(new, 50)))
        .otherwise("")
    )
    text = F.concat(F.lit("Commit: "), subject, F.when((message != "") & (message != subject), F.concat(F.lit("\n\n"), message)).otherwise(""), body)
    out = commits.filter(subject != "").select("id", "lang", text.alias("text"))
    if quota is None:
        return out
    n = F.row_number().over(Window.partitionBy("lang").orderBy("id"))
    return out.withColumn("_n", n).filter(F.col("_n") <= quota).drop("_n")


def config_filter(files: DataFrame, text: str = "text") -> DataFrame:
    """Configuration files of 20 to 50,000 characters."""
    return files.filter(F.length(text).between(20, 50_000))


def with_end(ids: Column, end: int) -> Column:
    """Token ids and the end-of-text token; null texts stay null, empty ones are the end alone."""
    return F.when(ids.isNotNull(), F.array_append(ids, F.lit(end)))


def weighted_mix(docs: DataFrame, source: str, key: str, weights: dict[str, float], draws: int) -> DataFrame:
    """``source, doc_id, epoch, at``: so many draws from the sources by their weights, in the order of ``at``.

    A deterministic form of weighted sampling: a source gives its share of the draws, evenly spread (its j-th draw stands at
    ``(j + 0.5) / share``), and starts again from its first document when it is exhausted.  Sources without documents or
    weight give nothing; their share is not passed on."""
    total = sum(weights.values())
    share = X.weight_of(F.col(source), {k: w / total for k, w in weights.items()}, 0.0)
    d = docs.select(F.col(source).alias("source"), F.col(key).alias("doc_id"), share.alias("share"), F.lit(1).alias("one")).filter("share > 0")
    placed = C.offsets(d, ["source", "doc_id"], "one")
    size = placed.groupBy("source").agg(F.min("offset").alias("first"), F.count(F.lit(1)).alias("n"))
    p = placed.join(size, "source").withColumns({"k": F.col("offset") - F.col("first"), "wanted": F.round(F.col("share") * draws)})
    last = F.floor((F.col("wanted") - 1 - F.col("k")) / F.col("n"))
    e = p.filter(last >= 0).select("source", "doc_id", "share", "k", "n", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("epoch"))
    return e.select("source", "doc_id", "epoch", F.round((F.col("k") + F.col("epoch") * F.col("n") + 0.5) / F.col("share"), 6).alias("at"))


def messages(turns: DataFrame, responses: DataFrame, markers: tuple[str, ...] = ()) -> DataFrame:
    """``id, system, user, response``: the last system and user message (``id, turn, role, text``) of each call and its response.

    Calls without a user message or with a blank response are dropped.  What follows the first of the ``markers`` that
    stands in the user message (not at its start) is cut off."""
    last = turns.groupBy("id").agg(
        F.max_by("text", F.when(F.col("role") == "system", F.col("turn"))).alias("system"), F.max_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("user")
    )
    user = F.col("user")
    for m in reversed(markers):  # the first marker that occurs decides
        user = F.when(F.instr("user", m) > 1, F.regexp_replace(F.substring_index("user", m, 1), r"\s+$", "")).otherwise(user)
    kept = responses.filter(F.trim(F.coalesce("response", F.lit(""))) != "").join(last, "id").filter(F.coalesce("user", F.lit("")) != "")
    return kept.select("id", F.coalesce("system", F.lit("")).alias("system"), user.alias("user"), "response")


def encoding_like(response: Column) -> Column:
    """Whether a response is a JSON object with the fields of an encoding."""
    ok = F.lit(True)
    for f in ("gist", "summary", "content", "salience", "concepts"):
        ok = ok & F.get_json_object(response, f"$.{f}").isNotNull()
    return F.coalesce(F.try_parse_json(response).isNotNull() & ok, F.lit(False))


def included(calls: DataFrame, task_types: list[str]) -> DataFrame:
    """Calls (``task_type, parse_success, error, response``) that parsed, did not fail and are of a wanted type; unknown ones
    count as encodings where their response looks like one."""
    kind = F.coalesce("task_type", F.lit("unknown"))
    wanted = kind.isin(task_types)
    if "encoding" in task_types:
        wanted = wanted | ((kind == "unknown") & encoding_like(F.col("response")))
    return calls.filter(F.coalesce("parse_success", F.lit(True)) & (F.coalesce("error", F.lit("")) == "") & wanted)


#: The delimiters of the two prompt formats, before and after system, user and response.
PLAIN = ("<|system|>\n", "\n<|user|>\n", "\n<|assistant|>\n", "<|endoftext|>")
CHAT = ("<|im_start|>system\n", "<|im_end|>\n<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n", "<|im_end|>\n")


def prompt(system: Column, user: Column, response: Column, form: tuple[str, ...] = PLAIN) -> tuple[Column, Column]:
    """(prefix, completion) of an example; a chat without a system message starts at the user's."""
    a, b, c, end = (F.lit(x) for x in form)
    prefix = F.concat(a, system, b, user, c)
    if form is CHAT:
        prefix = F.when(system == "", F.concat(F.lit(CHAT[1].split("\n", 1)[1]), user, c)).otherwise(prefix)
    return prefix, F.concat(response, end)


def budgeted(examples: DataFrame, most: int, tokens=X.fields, form: tuple[str, ...] = PLAIN) -> DataFrame:
    """``id, input, completion_start, n``: the tokens of each example within ``most``, and where the response starts (the loss mask).

    A longer example loses tokens of its user message, never of its response; where that cannot do it is dropped.
    ``tokens`` is a function from a text column to an array column."""
    system, user, suffix, end = (F.lit(x) for x in form)
    head, tail = tokens(F.concat(system, F.col("system"), user)), tokens(suffix)
    done = tokens(F.concat(F.col("response"), end))
    room = most - F.size("_done") - F.size("_head") - F.size("_tail")
    e = examples.withColumns({"_head": head, "_tail": tail, "_done": done, "_user": tokens(F.col("user"))}).filter((room >= 1) | (F.size("_user") == 0) & (room >= 0))
    prefix = F.concat("_head", F.slice("_user", F.lit(1), F.greatest(room, F.lit(0))), "_tail")
    e = e.withColumn("_prefix", prefix)
    return e.select("id", F.concat("_prefix", "_done").alias("input"), F.size("_prefix").alias("completion_start"), (F.size("_prefix") + F.size("_done")).alias("n"))


def compression_pairs(rows: DataFrame, accuracy: float = 0.95, ratio: float = 3.0) -> DataFrame:
    """``id, task, user, response``: good compressions (``id, accuracy, ratio, input, output``) in both directions."""
    good = rows.filter((F.col("accuracy") >= accuracy) & (F.col("ratio") >= ratio) & (F.coalesce("input", F.lit("")) != "") & (F.coalesce("output", F.lit("")) != ""))
    forth = good.select("id", F.lit("compression").alias("task"), F.col("input").alias("user"), F.col("output").alias("response"))
    return forth.unionByName(good.select("id", F.lit("decompression").alias("task"), F.col("output").alias("user"), F.col("input").alias("response")))


def synthesis_pairs(turns: DataFrame) -> DataFrame:
    """``id, user, response``: the first user message and the last assistant message that is not blank; calls lacking either go."""
    said = turns.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    out = said.groupBy("id").agg(
        F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("user"), F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("response")
    )
    return out.filter("user IS NOT NULL AND response IS NOT NULL")


def scenarios(memories: DataFrame, edges: DataFrame, k: int | None = 5_000, strength: float = 0.6) -> DataFrame:
    """``id, summary, content, concepts, project, n_related, strongest``: told memories with what is strongly linked to them.

    Active ones of the agent's with a summary above 20 characters, the ``k`` newest (all, if null); content falls back to
    the summary, the project to unknown; up to five concepts."""
    m = memories.filter((F.col("source") == "mcp") & (F.col("state") == "active") & (F.length("summary") > 20))
    m = m if k is None else m.orderBy(F.desc("timestamp"), "id").limit(k)
    both = edges.filter(F.col("strength") >= strength)
    ends = both.select(F.col("source_id").alias("id"), F.col("target_id").alias("o"), "strength").unionByName(both.select(F.col("target_id").alias("id"), F.col("source_id").alias("o"), "strength"))
    linked = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n_related"), F.max("strength").alias("strongest"))
    return m.join(linked, "id", "left").select(
        "id", "summary", F.when(F.coalesce("content", F.lit("")) == "", F.col("summary")).otherwise(F.col("content")).alias("content"),
        F.slice(F.coalesce("concepts", F.array().cast("array<string>")), 1, 5).alias("concepts"), F.when(F.coalesce("project", F.lit("")) == "", "unknown").otherwise(F.col("project")).alias("project"),
        F.coalesce("n_related", F.lit(0)).alias("n_related"), "strongest",
    )


def generation_scores(rows: DataFrame, response: str, truth: str | None = None) -> DataFrame:
    """Adds ``json_valid, fields_present, summary_ok, gist_ok, concepts_ok, salience_ok, score`` (0 to 9) of generated encodings and,
    against the ``truth``, ``concept_jaccard`` and ``salience_delta``.  Text that is no JSON object scores 0."""
    shape = "gist string, summary string, content string, concepts array<string>, salience double"
    c = F.col(response)
    valid = F.coalesce(F.try_parse_json(c).isNotNull() & F.trim(c).startswith("{"), F.lit(False))
    x = rows.withColumns({"json_valid": valid, "_x": F.when(valid, F.from_json(c, shape))})
    present = sum((F.get_json_object(c, f"$.{f}").isNotNull().cast("int") for f in ("gist", "summary", "content", "concepts", "salience")), F.lit(0))
    out = x.withColumns(
        {
            "fields_present": F.when(F.col("json_valid"), present).otherwise(0),
            "summary_ok": F.coalesce((F.length("_x.summary") > 10) & (F.length("_x.summary") <= 120), F.lit(False)),
            "gist_ok": F.coalesce((F.length("_x.gist") > 5) & (F.length("_x.gist") <= 70), F.lit(False)),
            "concepts_ok": F.coalesce(F.size("_x.concepts").between(2, 8), F.lit(False)),
            "salience_ok": F.coalesce((F.col("_x.salience") > 0) & (F.col("_x.salience") <= 1), F.lit(False)),
        }
    )
    flag = lambda name, w: F.when(F.col(name), w).otherwise(0.0)
    out = out.withColumn("score", flag("json_valid", 2.0) + F.col("fields_present") / 5 * 2.0 + flag("summary_ok", 1.5) + flag("gist_ok", 1.0) + flag("concepts_ok", 1.5) + flag("salience_ok", 1.0))
    if truth is not None:
        t = F.from_json(F.col(truth), shape)
        low = lambda a: X.folded_set(a)
        out = out.withColumn("_t", t).withColumns(
            {
                "concept_jaccard": F.when(F.col("json_valid"), X.jaccard(low(F.col("_x.concepts")), low(F.col("_t.concepts")))),
                "salience_delta": F.abs(F.col("_x.salience") - F.col("_t.salience")),
            }
        ).drop("_t")
    return out.drop("_x")
