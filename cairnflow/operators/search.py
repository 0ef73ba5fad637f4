"""Full-text, vector and concept search for a set of queries against all rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from cairnflow.functions import exprs as X
from cairnflow.operators.pairs import flat
from cairnflow.sources.tables import in_parts, materialize

K1, B = 1.2, 0.75
#: Entries of posting lists above which full-text search leaves out lists that cannot bring a document in.
PRUNE_ABOVE = 5_000_000
#: Queries compared with the vectors in one pass.
QUERY_BLOCK = 4096
#: Documents that a task scores, and vectors that it compares, at once.
DOC_PART, VECTOR_PART = 100_000, 32_768
#: Queries of a task that holds them against all documents.
TASK_QUERIES = 2048
#: Queries whose best rows are picked at once inside a task.
QUERY_STRIPE = 256


def postings(docs: DataFrame, doc_id: str, text: Column) -> tuple[DataFrame, DataFrame]:
    """(doc_id, term, tf), a row for each place of a term, and (doc_id, length) of the documents that have a token.

    Both are read several times by a search, and by any number of searches, so they are written once."""
    words = docs.select(F.col(doc_id).alias("doc_id"), X.tokens(text).alias("words"))
    lists = materialize(words.select("doc_id", F.explode("words").alias("term"), F.lit(1).cast("long").alias("tf")), "postings")
    lengths = words.filter(F.size("words") > 0).groupBy("doc_id").agg(F.sum(F.size("words")).alias("length"))
    return lists, materialize(lengths, "lengths")


def bm25(
    docs: DataFrame, doc_id: str, text: Column, queries: DataFrame, query_id: str, query: Column, k: int | None = 10, group: DataFrame | None = None
) -> DataFrame:
    """``bm25_of`` the posting lists of ``docs``."""
    return bm25_of(*postings(docs, doc_id, text), queries, query_id, query, k, group)


def bm25_of(lists: DataFrame, lengths: DataFrame, queries: DataFrame, query_id: str, query: Column, k: int | None = 10, group: DataFrame | None = None) -> DataFrame:
    """Best ``k`` documents of each query: ``query_id, doc_id, score, rank``.

    A query term matches every term that starts with it; term frequencies of a prefix are
    summed and its document frequency counts documents.  The inverse document frequency is
    ``ln(1 + (N - n + 0.5) / (n + 0.5))``.  Ties go to the smaller document id.  Queries without
    terms and documents without tokens give no rows.

    The vocabulary is expanded to its prefixes of the lengths that the queries use, so prefixes
    are found by an equality join and never by comparing all terms with all prefixes.

    With ``k`` and more than ``PRUNE_ABOVE`` entries in the posting lists, or with ``group`` (document id ``doc_id`` and ``g``; then
    the best ``k`` are those of each group, and ``g`` is returned), a task holds some queries against all documents part by
    part and returns their best only; what a query merely matches is never written nor moved.
    """
    terms = queries.select(
        F.col(query_id).alias("query_id"), F.explode(F.array_distinct(X.query_terms(query))).alias("prefix")
    )
    prefixes = terms.select("prefix").distinct().withColumn("l", F.length("prefix"))
    sizes = [r.l for r in prefixes.select("l").distinct().collect()]
    if not sizes:
        sizes = [1]
    vocabulary = lists.select("term").distinct()
    starts = vocabulary.select("term", F.explode(X.lit_array(sizes)).alias("l")).filter(F.length("term") >= F.col("l"))
    matches = (
        starts.select("term", F.left("term", F.col("l")).alias("prefix")).join(prefixes.select("prefix"), "prefix")
    )
    inside = group is not None or k is not None and lists.count() > PRUNE_ABOVE
    hits = lists.join(F.broadcast(matches) if inside else matches, "term").groupBy("prefix", "doc_id").agg(F.sum("tf").alias("tf"))  # the vocabulary
    hits = materialize(hits, "hits") if inside else hits
    counts = hits.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    corpus = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avg_length"))
    idf = F.log(1 + (F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    parts = hits.join(counts, "prefix").join(lengths, "doc_id").crossJoin(F.broadcast(corpus)).select("prefix", "doc_id", (idf * share).alias("part"))  # one row
    if not inside:
        scored = parts.join(terms, "prefix").groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 9).alias("score"))
        return top_k(scored, ["query_id"], [F.desc("score"), F.col("doc_id")], k)
    parts = materialize(parts.withColumn("g", F.lit("")) if group is None else parts.join(group, "doc_id"), "parts")
    found = _best_documents(parts, terms, k)
    return found.drop("g") if group is None else found


def _best_documents(parts: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """``query_id, g, doc_id, score, rank``: the best ``k`` documents of each query and group by the sum of their ``parts``."""
    docs = parts.groupBy("g", "doc_id").agg(F.collect_list(F.struct("prefix", "part")).alias("x"))
    docs = materialize(docs.select("g", "doc_id", F.col("x.prefix").alias("prefixes"), F.col("x.part").alias("parts")), "scored-documents")
    _, read = in_parts(docs, "document-parts", ["g", "doc_id"], DOC_PART)
    used = terms.join(parts.select("prefix").distinct(), "prefix", "left_semi").groupBy("query_id").agg(F.collect_list("prefix").alias("prefixes"))
    asked = materialize(used, "asked")
    tasks = max(1, -(-asked.count() // TASK_QUERIES))

    def scored(t: pa.Table, wanted: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The places and scores of the best in a part, query after query."""
        names, _, sizes = flat(t["prefixes"])
        values = flat(t["parts"])[0].to_numpy(zero_copy_only=False)
        rows, g = np.repeat(np.arange(len(sizes)), sizes), t["g"].combine_chunks().dictionary_encode()
        g = g.indices.to_numpy(zero_copy_only=False)
        vocabulary = pc.unique(names)
        codes = pc.index_in(names, value_set=vocabulary).to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        cuts = np.cumsum(np.bincount(codes, minlength=len(vocabulary)))[:-1]
        lists = dict(zip(vocabulary.to_pylist(), zip(np.split(rows[order], cuts), np.split(values[order], cuts))))
        known: dict[tuple, tuple] = {}
        for words in wanted:
            key = tuple(sorted(w for w in words if w in lists))
            if key not in known:
                total = np.zeros(len(sizes))
                for w in key:
                    at, x = lists[w]
                    total[at] += x
                at = np.unique(np.concatenate([lists[w][0] for w in key])) if len(key) > 1 else lists[key[0]][0] if key else np.zeros(0, int)
                known[key] = _first_of_groups(at, np.round(total[at], 9), g[at], k)
            yield known[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = b.column("prefixes").to_pylist()
            best = [([], []) for _ in wanted]
            gs, ids, before = [], [], 0
            for one in read:
                t = one()
                if not t.num_rows:
                    continue
                for (places, scores), (at, score) in zip(best, scored(t, wanted)):
                    places.append(at + before)
                    scores.append(score)
                gs.append(t["g"].combine_chunks())
                ids.append(t["doc_id"].combine_chunks())
                before += t.num_rows
            if not before:
                continue
            g_all, id_all = pa.concat_arrays(gs), pa.concat_arrays(ids)
            code = g_all.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            out = []
            for i, (places, scores) in enumerate(best):
                at, score = np.concatenate(places), np.concatenate(scores)
                order = np.lexsort((at, -score, code[at]))
                at, score = at[order], score[order]
                rank = np.arange(len(at)) - np.searchsorted(code[at], code[at]) + 1
                out.append((np.full((rank <= k).sum(), i), at[rank <= k], score[rank <= k], rank[rank <= k]))
                if sum(len(x[0]) for x in out[-256:]) > 100_000 or i == len(best) - 1 or len(out) == 256:
                    q, at, score, rank = (np.concatenate(x) for x in zip(*out))
                    out = []
                    yield pa.record_batch([b.column("query_id").take(pa.array(q)), g_all.take(pa.array(at)), id_all.take(pa.array(at)), pa.array(score), pa.array(rank, pa.int32())], names=["query_id", "g", "doc_id", "score", "rank"])

    kinds = dict(asked.dtypes) | {"doc_id": dict(docs.dtypes)["doc_id"]}
    return asked.repartition(tasks, "query_id").mapInArrow(run, f"query_id {kinds['query_id']}, g string, doc_id {kinds['doc_id']}, score double, rank int")


def _first_of_groups(at: np.ndarray, score: np.ndarray, g: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places and scores that can be among the best ``k`` of their group; groups and places ascend."""
    if not len(at):
        return at, score
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    lengths = np.diff(np.append(starts, len(at)))
    if len(starts) == 1:
        floor = np.partition(score, -k)[-k] if len(score) > k else -np.inf
    else:
        left = score.copy()
        for r in range(k):  # the k-th greatest of the different scores
            floor = np.repeat(np.maximum.reduceat(left, starts), lengths)
            left[left >= floor] = -np.inf
    keep = np.flatnonzero(score >= floor)
    order = keep[np.lexsort((at[keep], -score[keep], g[keep]))]  # ties: the first
    place = np.arange(len(order)) - np.searchsorted(g[order], g[order])
    order = order[place < k]
    return at[order], score[order]


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None) -> DataFrame:
    """The first ``k`` rows of each key with their ``rank``; a limit per group reaches the shuffle's input."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def vector_top_k(
    vectors: DataFrame,
    vector_id: str,
    vector: str,
    queries: DataFrame,
    query_id: str,
    query_vector: str,
    k: int = 10,
    exclude_self: bool = False,
    least: float | None = None,
    group: str | None = None,
) -> DataFrame:
    """Best ``k`` vectors of each query by cosine: ``query_id, id, score, rank``.

    With ``group`` (a column of both sides) only vectors of the query's group count; a null group
    matches nothing.

    The queries are a stated set: they are taken in blocks of ``QUERY_BLOCK``, each block as one
    matrix against the rows of every partition.  A task keeps ``k`` per query and batch, so what
    is shuffled does not grow with the vectors of a task.  More queries than a block (without ``group``) are spread over
    tasks, each of which reads all vectors part by part and returns its queries' best only.  Vectors that are null, empty, zero,
    not finite or of another length than the query's match nothing.
    """
    g = (F.lit("") if group is None else F.col(group).cast("string")).alias("g")
    rows = vectors.select(F.col(vector_id).alias("id"), F.col(vector).cast("array<double>").alias("v"), g)
    rows = rows.filter(X.usable_vector(F.col("v")) & F.col("g").isNotNull())
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("v"), g)
    asked = asked.filter(X.usable_vector(F.col("v")) & F.col("g").isNotNull())
    types = dict(asked.dtypes)["query_id"], dict(rows.dtypes)["id"]
    n = asked.count()
    if n > QUERY_BLOCK and group is None:
        return _best_vectors(rows.drop("g"), asked.drop("g"), n, types, k, exclude_self, least)
    blocks = max(1, -(-n // QUERY_BLOCK))
    out = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        found = _scan(rows, [tuple(r) for r in part.collect()], types, k, exclude_self, least)
        out = found if out is None else out.unionByName(found)
    return top_k(out, ["query_id"], [F.desc("score"), F.col("id")], k)


#: Queries and vectors of one product of matrices.
_TILE = 4096
#: More than the error of a cosine in single precision.
_SLACK = 1e-5


def _best_vectors(rows: DataFrame, asked: DataFrame, n: int, types: tuple[str, str], k: int, exclude_self: bool, least: float | None) -> DataFrame:
    """``vector_top_k`` for many queries: products in single precision tell which vectors can be among a query's best, their
    cosines are then computed in double precision.  Parts come in the order of ids, so of equal scores the first stays."""
    _, read = in_parts(rows, "vectors-by-id", ["id"], VECTOR_PART)
    asked = materialize(asked, "asked-vectors")
    keep = k + exclude_self

    def lengths(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        values, starts, sizes = flat(column)
        values = values.to_numpy(zero_copy_only=False)
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            m = values[starts[at][:, None] + np.arange(d)].astype(np.float64)
            yield int(d), at, m / np.linalg.norm(m, axis=1, keepdims=True)

    def best(q: np.ndarray, state: tuple, m: np.ndarray, places: np.ndarray) -> tuple:
        """The state (query, place, score of what is kept; floor of each query) after further vectors."""
        (who, at, score), floor = state
        q4, m4 = q.astype(np.float32), m.astype(np.float32)
        for lo in range(0, len(m4), _TILE // 2):
            cos = q4 @ m4[lo : lo + _TILE // 2].T
            bound = floor
            if not np.isfinite(floor).all() and cos.shape[1] > keep:
                bound = np.maximum(floor, np.partition(cos, -keep, axis=1)[:, -keep])
            row, col = np.divmod(np.flatnonzero(cos >= (bound - _SLACK).astype(np.float32)[:, None]), cos.shape[1])
            if not len(row):
                continue
            exact = np.round(np.einsum("ij,ij->i", q[row], m[lo + col]), 9)
            use = exact >= floor[row] if least is None else exact >= np.maximum(floor[row], least)
            who, at, score = (np.concatenate(x) for x in ((who, row[use]), (at, places[lo + col[use]]), (score, exact[use])))
            order = np.lexsort((at, -score, who))
            who, at, score = who[order], at[order], score[order]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            last = rank == keep - 1
            floor = floor.copy()
            floor[who[last]] = score[last]
            who, at, score = (x[rank < keep] for x in (who, at, score))
        return (who, at, score), floor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, _TILE):
                b, before, ids = whole.slice(first, _TILE), 0, []
                asked_ = list(lengths(b.column("v")))
                states = {d: ((np.zeros(0, int), np.zeros(0, int), np.zeros(0)), np.full(len(q), -np.inf)) for d, _, q in asked_}
                for one in read:
                    t = one()
                    if not t.num_rows:
                        continue
                    there = {d: (at, m) for d, at, m in lengths(t["v"])}
                    for d, _, q in asked_:
                        if d in there:
                            states[d] = best(q, states[d], there[d][1], there[d][0] + before)
                    ids.append(t["id"].combine_chunks())
                    before += t.num_rows
                for d, own, _ in asked_:
                    who, at, score = states[d][0]
                    if len(who):
                        q, found = b.column("query_id").take(pa.array(own[who])), pa.concat_arrays(ids).take(pa.array(at))
                        out = pa.record_batch([q, found, pa.array(score)], names=["query_id", "id", "score"])
                        yield out.filter(pc.not_equal(q.cast(pa.string()), found.cast(pa.string()))) if exclude_self else out

    found = asked.repartition(max(1, -(-n // _TILE)), "query_id").mapInArrow(run, f"query_id {types[0]}, id {types[1]}, score double")
    return top_k(found, ["query_id"], [F.desc("score"), F.col("id")], k)


def _scan(rows: DataFrame, queries: list, types: tuple[str, str], k: int, exclude_self: bool, least: float | None):
    by_kind: dict[tuple[int, str], tuple[list, list]] = {}
    for q, v, g in queries:
        ids, vs = by_kind.setdefault((len(v), g), ([], []))
        ids.append(q)
        vs.append(v)
    shared = rows.sparkSession.sparkContext.broadcast(
        {d: (ids, np.array(vs) / np.linalg.norm(vs, axis=1, keepdims=True)) for d, (ids, vs) in by_kind.items()}
    )
    arrow_q = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[types[0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, gs, v = b.column("id").to_pylist(), b.column("g").to_pylist(), b.column("v")
            flat, starts = v.flatten().to_numpy(zero_copy_only=False), v.offsets.to_numpy()
            starts, lengths = starts[:-1] - starts[0], np.diff(starts)
            places: dict[tuple[int, str], list[int]] = {}
            for i, g in enumerate(gs):
                places.setdefault((int(lengths[i]), g), []).append(i)
            for kind, (qids, q) in shared.value.items():
                at = places.get(kind)
                if not at:
                    continue
                m = flat[starts[at][:, None] + np.arange(kind[0])].astype(np.float64)
                m /= np.linalg.norm(m, axis=1, keepdims=True)
                sims = np.round(m @ q.T, 9)
                own = np.array([ids[i] for i in at], dtype=object)
                order = np.argsort(own, kind="stable")
                sims, own = sims[order], own[order]
                keep = min(k + exclude_self, len(own))
                for lo in range(0, len(qids), QUERY_STRIPE):
                    part = sims[:, lo : lo + QUERY_STRIPE]
                    floor = np.partition(part, len(own) - keep, axis=0)[len(own) - keep]
                    row, col = np.nonzero(part >= (floor if least is None else np.maximum(floor, least)))
                    best = np.lexsort((row, -part[row, col], col))  # ties: the smaller id
                    row, col = row[best], col[best]
                    place = np.arange(len(col)) - np.searchsorted(col, col)
                    row, col = row[place < keep], col[place < keep]
                    names = [qids[lo + c] for c in col]
                    found = own[row].tolist()
                    use = [i for i, (q, f) in enumerate(zip(names, found)) if not (exclude_self and q == f)]
                    yield pa.record_batch(
                        [
                            pa.array([names[i] for i in use], arrow_q),
                            pa.array([found[i] for i in use], b.schema.field("id").type),
                            pa.array(part[row, col][use] if use else [], pa.float64()),
                        ],
                        names=["query_id", "id", "score"],
                    )

    return rows.mapInArrow(run, f"query_id {types[0]}, id {types[1]}, score double")


def concept_search(memories: DataFrame, queries: DataFrame, query_id: str, concepts: str, k: int | None = 10) -> DataFrame:
    """Memories that hold one of the query's concepts (without letter case), by salience: ``query_id, id, salience, hits, rank``.

    With ``k`` only the first ``k`` memories of each concept are joined, since the order doesn't depend on the query: what
    is behind them in every concept of a query is behind the query's first ``k``.  The hits are then counted for these."""
    low = F.array_distinct(F.transform(F.col(concepts), lambda x: F.lower(x)))
    asked = queries.select(F.col(query_id).alias("query_id"), low.alias("cs"))
    each = asked.select("query_id", F.explode("cs").alias("c"))
    sets = memories.select("id", "salience", X.folded_set(F.col("concepts")).alias("held"))
    held = sets.select("id", "salience", F.explode("held").alias("c"))
    if k is None:
        hits = each.join(held, "c").groupBy("query_id", "id").agg(F.max("salience").alias("salience"), F.count(F.lit(1)).alias("hits"))
        return top_k(hits, ["query_id"], [F.desc("salience"), F.col("id")], None)
    used = held.join(each.select("c").distinct(), "c", "left_semi").groupBy("c", "id").agg(F.max("salience").alias("salience"))
    first = materialize(top_k(used, ["c"], [F.desc("salience"), F.col("id")], k).drop("rank"), "concept-heads")
    found = each.join(first, "c").groupBy("query_id", "id").agg(F.max("salience").alias("salience"))
    best = materialize(top_k(found, ["query_id"], [F.desc("salience"), F.col("id")], k), "concept-best")
    both = best.select("query_id", "id").join(asked, "query_id").join(sets.select("id", "held"), "id")
    hits = both.groupBy("query_id", "id").agg(F.sum(F.size(F.array_intersect("cs", "held"))).alias("hits"))
    return best.join(hits, ["query_id", "id"]).select("query_id", "id", "salience", "hits", "rank")


def text_contains_search(rows: DataFrame, texts: Column, needles: list[str], state: Column | None = None) -> DataFrame:
    """Rows whose list, written as JSON, contains one of the needles (ASCII case ignored): the substring form of concept search."""
    low = F.lower(F.to_json(texts))
    hit = F.lit(False)
    for n in needles:
        hit = hit | low.contains(n.lower())
    return rows.filter(hit if state is None else hit & state)


def reciprocal_rank_fusion(lists: list[DataFrame], keys: Sequence[str], c: int = 60, k: int | None = 10) -> DataFrame:
    """Sum of ``1 / (c + rank)`` over ranked lists with the columns keys, id, rank."""
    union = lists[0].select(*keys, "id", "rank")
    for other in lists[1:]:
        union = union.unionByName(other.select(*keys, "id", "rank"))
    scored = union.groupBy(*keys, "id").agg(F.round(F.sum(1.0 / (c + F.col("rank"))), 9).alias("score"))
    return top_k(scored, keys, [F.desc("score"), F.col("id")], k)
