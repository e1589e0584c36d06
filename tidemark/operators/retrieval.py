"""BM25 and vector top-k, rank fusion, reranking, and the pieces around them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.text import tokens
from tidemark.session import checkpointed

K1, B = 1.2, 0.75
#: Terms of queries that are sent to all tasks at once, at most (24 bytes each); more queries take further passes.
ASKED = 1_000_000
#: Texts and queries whose scores are held at once.
TEXTS, QUESTIONS = 2048, 1024


def k_best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest of each row, of equal ones the first."""
    n, m = scores.shape
    if m <= k:
        return np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
    least = np.partition(scores, m - k, axis=1)[:, m - k]
    above = scores > least[:, None]
    tied = scores == least[:, None]
    return np.nonzero(above | (tied & (np.cumsum(tied, 1) <= (k - above.sum(1))[:, None])))


def _block_scorer(asked, by_id: bool):
    """Rows (block, chunk_id, term, part), a block's rows together -> (query, chunk_id, score) of the k best of each block.

    asked: broadcast (terms sorted, their queries' numbers, their weights, number of queries, k).  If
    the numbers are not in the order of the ids (by_id), what ties with the k-th is given out as well.
    """

    def scored(chunk: np.ndarray, term: np.ndarray, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        terms, query, weight, n, k = asked.value
        ids, at = np.unique(chunk, return_inverse=True)
        order = np.argsort(term, kind="stable")
        term, at, part = term[order], at[order], part[order]
        edges = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        lo, hi = np.searchsorted(terms, term[edges], "left"), np.searchsorted(terms, term[edges], "right")
        bounds = list(zip(edges.tolist(), [*edges[1:].tolist(), len(term)], lo.tolist(), hi.tolist(), strict=True))
        for first in range(0, n, QUESTIONS):
            sums = np.zeros((min(QUESTIONS, n - first), len(ids)))
            for i, j, a, z in bounds:
                a, z = a + np.searchsorted(query[a:z], [first, first + QUESTIONS])
                if a < z:
                    sums[(query[a:z] - first)[:, None], at[i:j]] += weight[a:z, None] * part[i:j]
            scores = np.where(sums > 0, np.round(sums, 6), -1.0)
            if by_id:
                q, d = k_best(scores, k)
                q, d = q[scores[q, d] >= 0], d[scores[q, d] >= 0]
            else:
                least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.zeros(len(sums))
                q, d = np.nonzero((scores >= 0) & (scores >= least[:, None]))
            yield q + first, ids[d], scores[q, d]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flushed() -> Iterator[pa.RecordBatch]:
            for q, chunk, score in scored(*(np.concatenate([h[i] for h in held]) for i in range(3))):
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(chunk), pa.array(score)], names=["number", "chunk", "score"])

        for b in batches:
            block, *columns = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            cuts = np.flatnonzero(np.diff(block)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(block)], strict=True):
                if hi > lo:
                    if held and block[lo] != key:
                        yield from flushed()
                        held = []
                    key = block[lo]
                    held.append([c[lo:hi] for c in columns])
        if held:
            yield from flushed()

    return run


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """query_id, chunk_id, score, rank: the k best texts of each query(query_id, query), scores to six decimals, ties to smaller ids.

    Texts are cut into words once.  Only the queries' terms are kept of them, as counts in a table of
    postings, which also has each text's length; the number of texts with a term, the mean length and
    the scores come from it.  Postings are dealt by text to blocks, and a block adds up its scores
    for all queries as a matrix and gives out only its best.  Terms are told apart by 64-bit hashes.
    The constant factor k1 + 1 is left out; it changes no rank.
    """
    spark = docs.sparkSession
    hashed = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    asked = checkpointed(queries.select("query_id", F.explode(F.array_distinct(hashed(tokens(F.col("query"))))).alias("term")).distinct())
    length = F.xxhash64(F.lit(""))  # the empty word is in no text: its posting stands for the text itself
    terms = asked.select("term").union(spark.range(1).select(length)).distinct()
    # As the one row of an explode the words are made once; a projection would be made again wherever it is used.
    words = docs.select(F.col(id_col).alias("chunk_id"), F.explode(F.array(tokens(F.col(text_col)))).alias("words"))
    posted = words.select("chunk_id", F.size("words").alias("len"), F.explode(F.concat(F.array(F.lit("")), "words")).alias("word")).select("chunk_id", "len", F.xxhash64("word").alias("term"))
    postings = checkpointed(posted.join(terms, "term", "left_semi").groupBy("chunk_id", "len", "term").agg(F.count("*").alias("tf")))
    texts = postings.where(F.col("term") == length)
    n_docs, mean = texts.agg(F.count("*"), F.avg("len")).first()
    kind = dict(postings.dtypes)["chunk_id"]
    if not n_docs:
        return queries.select("query_id", F.lit(None).cast(kind).alias("chunk_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank")).limit(0)
    postings = postings.where(F.col("term") != length)
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = checkpointed(asked.join(postings.groupBy("term").agg(F.count("*").alias("df")), "term").select("query_id", "term", idf.alias("idf")))
    passes = max(1, -(-weights.count() // ASKED))
    part = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("len") / (mean or 1.0)))
    block = F.pmod(F.xxhash64("chunk_id"), F.lit(-(-n_docs // TEXTS)))
    number = {} if kind in ("int", "bigint") else {"chunk_id": F.xxhash64("chunk_id")}  # other ids are found again by their hash
    dealt = postings.select(block.alias("block"), number.get("chunk_id", F.col("chunk_id").cast("long")).alias("chunk"), "term", part.alias("part"))
    dealt = dealt.repartition("block").sortWithinPartitions("block")
    found = None
    for i in range(passes):
        rows = weights.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i).toPandas()  # about ASKED rows
        ids, query = np.unique(rows["query_id"].to_numpy(), return_inverse=True)
        order = np.lexsort((query, rows["term"]))
        sent = spark.sparkContext.broadcast((rows["term"].to_numpy(np.int64)[order], query[order], rows["idf"].to_numpy(float)[order], len(ids), k))
        names = spark.createDataFrame([(n, x) for n, x in enumerate(ids.tolist())], "number long, query_id " + dict(weights.dtypes)["query_id"])
        best = dealt.mapInArrow(_block_scorer(sent, not number), "number long, chunk long, score double").join(names, "number")
        found = best if found is None else found.unionByName(best)
    found = found.select("query_id", F.col("chunk").alias("chunk_id"), F.round("score", 6).alias("score"))
    if number:
        found = found.withColumnRenamed("chunk_id", "_h").join(texts.select("chunk_id", F.xxhash64("chunk_id").alias("_h")), "_h").select("query_id", "chunk_id", "score")
    return ranked(found.withColumn("chunk_id", F.col("chunk_id").cast(kind)), k)


def ranked(scored: DataFrame, k: int, *more: Column) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *(more or (F.asc("chunk_id"),)))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "chunk_id", vector_col: str = "embedding", block: int = TEXTS, group: int = QUESTIONS) -> DataFrame:
    """query_id, chunk_id, score (cosine, six decimals), rank: exact, in blocks of vectors by groups of queries.

    A block gives out only its k best for each query.  Rows without a vector take no part; a zero vector has similarity 0.  Ids keep their types.
    """
    v = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("chunk_id"), F.col(vector_col).cast("array<double>").alias("v"))
    q = queries.where(F.col(vector_col).isNotNull()).select("query_id", F.col(vector_col).cast("array<double>").alias("v"))
    n_blocks, n_groups = max(8, -(-v.count() // block)), max(1, -(-q.count() // group))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = v.select(F.pmod(F.xxhash64("chunk_id"), F.lit(n_blocks)).cast("int").alias("b"), spread(n_groups).alias("g"), "chunk_id", "v")
    asked = q.select(spread(n_blocks).alias("b"), F.pmod(F.xxhash64("query_id"), F.lit(n_groups)).cast("int").alias("g"), "query_id", "v")

    def search(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(wanted):
            return pd.DataFrame({"query_id": wanted["query_id"][:0], "chunk_id": rows["chunk_id"][:0], "score": pd.Series(dtype="float64")})
        rows = rows.sort_values("chunk_id")
        a, b = np.stack(rows["v"].to_numpy()), np.stack(wanted["v"].to_numpy())
        size = np.linalg.norm(b, axis=1)[:, None] * np.linalg.norm(a, axis=1)[None]
        sims = np.divide(b @ a.T, size, out=np.zeros(size.shape), where=size > 0)
        sims = np.round(sims, 6)
        i, j = k_best(sims, k)
        return pd.DataFrame({"query_id": wanted["query_id"].to_numpy()[i], "chunk_id": rows["chunk_id"].to_numpy()[j], "score": sims[i, j]})

    found = held.groupBy("b", "g").cogroup(asked.groupBy("b", "g")).applyInPandas(search, f"query_id {dict(q.dtypes)['query_id']}, chunk_id {dict(v.dtypes)['chunk_id']}, score double")
    return ranked(found, k)


def rrf(channels: DataFrame, k: int = 20, constant: int = 60) -> DataFrame:
    """Fuse (query_id, channel, chunk_id, rank): sum of 1 / (constant + rank), eight decimals; and the channels of each."""
    fused = channels.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 8).alias("score"), F.array_join(F.sort_array(F.collect_set("channel")), ",").alias("channels"))
    return ranked(fused, k)


def keep_best(results: DataFrame) -> DataFrame:
    """Several lists of a query as one: the best score of each id, in the order in which ids first appear (variant, rank)."""
    seen = F.min(F.struct("variant", "rank"))
    best = results.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), seen.alias("_seen"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_seen", "chunk_id"))).drop("_seen")


def variants(query: Column, rewrites: Column, parts: Column, most: int = 6) -> Column:
    """The query, its rewrites and sub-questions, each once, blank ones aside."""
    return F.slice(F.array_distinct(F.filter(F.concat(F.array(query), F.coalesce(rewrites, F.array().cast("array<string>")), F.coalesce(parts, F.array().cast("array<string>"))), lambda x: F.trim(x) != "")), 1, most)


def overlap_score(query: Column, content: Column, width: int = 256) -> Column:
    """The reranker when no model is given: the share of the query's terms in the content's first characters."""
    q = F.array_distinct(tokens(query))
    shared = F.size(F.array_intersect(q, tokens(F.substring(content, 1, width))))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.round(shared / F.when(F.size(q) > 0, F.size(q)), 6))


def rerank(candidates: DataFrame, k: int, score: Column | None = None) -> DataFrame:
    """Candidates(query_id, rank, query, content, ...) by score, ties by the rank they had."""
    scored = candidates.withColumn("rerank_score", overlap_score(F.col("query"), F.col("content")) if score is None else score)
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, published: DataFrame, k: int = 5, pool: int = 20) -> DataFrame:
    """query_id, chunk_id, score, channels, place.

    Both channels' 20 best are fused, cut to 20, and only then filtered to what is published: a
    query may end with fewer than k.
    """
    words = bm25_top_k(docs, queries, pool).select("query_id", F.lit("bm25").alias("channel"), "chunk_id", "rank")
    near = vector_top_k(vectors, query_vectors, pool).select("query_id", F.lit("vector").alias("channel"), "chunk_id", "rank")
    fused = rrf(words.unionByName(near), pool).join(published.select("chunk_id"), "chunk_id", "left_semi")
    w = Window.partitionBy("query_id").orderBy("rank")
    return fused.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("query_id", "chunk_id", "score", "channels", "place")


def fan_out(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, chunk_id, score, rank: the k best texts of every variant of queries(query_id, variants), as one list (see keep_best)."""
    parts = queries.select("query_id", F.posexplode("variants").alias("variant", "query"))
    found = bm25_top_k(docs, parts.select(F.struct("query_id", "variant").alias("s"), "query").select(F.to_json("s").alias("query_id"), "query"), k)
    named = found.withColumn("s", F.from_json("query_id", f"query_id {dict(parts.dtypes)['query_id']}, variant int"))
    return keep_best(named.select("s.query_id", "s.variant", "chunk_id", "rank", "score"))


def gate(visible: Column, asked: Column, intent: Column) -> Column:
    """What is done before anything is searched: EMPTY without a visible base among those asked for (none asked: all visible ones), BLOCKED out of scope, else SEARCH."""
    wanted = F.when(F.coalesce(F.size(asked), F.lit(0)) > 0, F.array_intersect(asked, visible)).otherwise(visible)
    return F.when(F.coalesce(F.size(wanted), F.lit(0)) <= 0, "EMPTY").when(F.coalesce(intent == "OUT_OF_SCOPE", F.lit(False)), "BLOCKED").otherwise("SEARCH")


def rerank_ladder(candidates: DataFrame, answers: DataFrame, k: int) -> DataFrame:
    """Candidates(query_id, rank, ...; rank from 1) by the first scores of answers(query_id, model, judge) that fit: rung, rerank_score and place.

    model has a score for each candidate; if their number differs, the scores in judge's text (the
    first JSON array) count; if these don't fit either, the order stays, with scores of 0.  A null
    score is 0; ties keep their order.
    """
    from tidemark.functions.jsons import first_array

    n = F.count("*").over(Window.partitionBy("query_id"))
    judged = F.from_json(first_array(F.col("judge")), "array<double>")
    told = candidates.withColumn("_n", n).join(answers.select("query_id", "model", judged.alias("_judged")), "query_id", "left")
    rung = F.when(F.size("model") == F.col("_n"), "model").when(F.size("_judged") == F.col("_n"), "judge").otherwise("order")
    score = lambda c: F.coalesce(F.get(c, F.col("rank") - 1).cast("double"), F.lit(0.0))
    scored = told.withColumn("rung", rung).withColumn("rerank_score", F.when(F.col("rung") == "model", score("model")).when(F.col("rung") == "judge", score("_judged")).otherwise(0.0))
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("_n", "model", "_judged")


def clamp_intent(intent: Column, allowed: list[str]) -> Column:
    """An intent of the allowed ones, else OUT_OF_SCOPE; with none allowed, blank is OTHER and the rest stays."""
    t = F.trim(F.coalesce(intent, F.lit("")))
    if not allowed:
        return F.when(t == "", "OTHER").otherwise(t)
    return F.when(t.isin(allowed), t).otherwise("OUT_OF_SCOPE")


def fallback_rewrite(query: Column, last_user: Column, failed: Column, most: int = 15) -> Column:
    """When analysis failed, a short query is joined with the last user turn (or the longer one stands, if it holds the other)."""
    joined = F.when(last_user.contains(query), last_user).when(query.contains(last_user), query).otherwise(F.concat_ws(" ", last_user, query))
    return F.when(failed & (F.length(query) <= most) & (F.trim(F.coalesce(last_user, F.lit(""))) != ""), joined).otherwise(query)
