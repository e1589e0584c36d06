"""Exact top-k inner products over an impact-ordered, score-at-a-time index.

The vectors are cut into blocks; a block's index holds, for each component and each sign of a
query's component, posting segments of equal quantised impact, in descending order.  A query
takes segments of all components by descending impact (query weight times quantised value),
which gives every vector a lower bound; what is still to come bounds the rest from above.  It
stops only when the vectors that may still be members are proven to be few; those are rescored
exactly.  A block streams the queries past its index, so neither side is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import table, written

LEVELS = 64
BLOCK, LEAST_BLOCKS, QUERY_GROUP = 4096, 16, 1 << 16


class ImpactIndex:
    """Impact-ordered postings of one block of integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by], vectors[by].astype(np.int64)
        low, high = self.vectors.min(0), self.vectors.max(0)
        self.step = np.maximum(1, -(-(high - low + 1) // LEVELS))
        self.posted, self.levels, self.cuts = [], [], []
        for x in ((self.vectors - low) // self.step, (high - self.vectors) // self.step):
            order = np.argsort(-x, axis=0, kind="stable").T  # component x posting
            levels = np.take_along_axis(x.T, order, 1)
            # cuts[d, l]: postings of component d with level l or more
            cuts = np.stack([np.searchsorted(-row, -np.arange(LEVELS + 1), "right") for row in levels])
            self.posted.append(np.ascontiguousarray(order))
            self.levels.append(np.ascontiguousarray(levels))
            self.cuts.append(cuts)

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows of the block that don't have the id own; ties to smaller ids."""
        n = len(self.ids)
        mine = slice(*np.searchsorted(self.ids, [own, own + 1]))
        weight, side = np.abs(query), (query < 0).astype(int)
        unit = weight * self.step
        found = np.zeros(n, np.int64)
        taken = np.zeros(len(query), np.int64)
        level = np.full(len(query), LEVELS, np.int64)  # segments of this level or more are taken
        least = np.flatnonzero(unit > 0)
        bar = int(unit.max(initial=0)) * LEVELS
        maybe = np.arange(n)
        while len(least) and bar:
            bar //= 2
            for d in least:
                to = max(1, -(-bar // int(unit[d]))) if bar else 1
                if to >= level[d]:
                    continue
                cut = self.cuts[side[d]][d, to]
                if cut > taken[d]:
                    span = slice(taken[d], cut)
                    found[self.posted[side[d]][d, span]] += unit[d] * self.levels[side[d]][d, span]
                    taken[d] = cut
                level[d] = to
            rest = int((weight * (level * self.step - 1)).sum())  # below level l at most l * step - 1 is added
            known = np.delete(found, mine) if mine.stop > mine.start else found
            bound = np.partition(known, len(known) - k)[len(known) - k] if len(known) > k else 0
            maybe = np.flatnonzero(found + rest >= bound)
            if len(maybe) <= max(4 * k, n // 16) or (level[least] == 1).all():
                break
        scores = self.vectors[maybe] @ query
        keep = self.ids[maybe] != own
        ids, scores = self.ids[maybe][keep], scores[keep]
        if len(scores) > 4 * k:
            good = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            ids, scores = ids[good], scores[good]
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]


def _matrix(column: pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _searcher(k: int):
    """Over partitions sorted by block, each block's vectors before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, index = None, [], None
        for b in batches:
            block, group, asks = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            ids, vectors = b.column(3).to_numpy(zero_copy_only=False), _matrix(b.column(4))
            edges = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (group[1:] != group[:-1]) | (asks[1:] != asks[:-1])]))
            rows = []
            for lo, hi in zip(edges, [*edges[1:], len(block)], strict=True):
                if (block[lo], group[lo]) != key:
                    key, held, index = (block[lo], group[lo]), [], None
                if not asks[lo]:
                    held.append((ids[lo:hi], vectors[lo:hi]))
                    continue
                if not held:
                    continue
                if index is None:
                    width = max(x.shape[1] for _, x in held)
                    index = ImpactIndex(np.concatenate([i for i, _ in held]), np.concatenate([_wide(x, width) for _, x in held]))
                width = index.vectors.shape[1]
                for q, x in zip(ids[lo:hi], vectors[lo:hi], strict=True):
                    x = x[:width] if len(x) >= width else np.pad(x, (0, width - len(x)))
                    near, scores = index.search(int(q), x, k)
                    rows.append((np.full(len(near), q), near, scores))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*rows, strict=True)], names=["query_id", "vec_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k rows of vectors with the largest integer inner product.

    A component x becomes floor(scale * x), x as double; a score is the sum of products, exact as
    long as it fits in 63 bits.  Ties go to the smaller id.  A row with the query's own id is no
    candidate.  Rows whose id or vector is null, or whose vector holds a null or a number that is
    not finite, take no part; shorter vectors count as padded with zeros; rows that repeat id and
    vector count once.  Ids must be whole numbers.  No rows, no result.  Other columns are ignored.
    """

    def whole(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        fit = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where(F.coalesce(fit, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("vector")).distinct()

    asked, rows = written(whole(queries), "asked"), written(whole(vectors), "vectors")
    n_blocks = max(LEAST_BLOCKS, -(-rows.count() // BLOCK))
    n_groups = max(1, -(-asked.count() // QUERY_GROUP))
    spot = F.xxhash64("id")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = rows.select(F.pmod(spot, F.lit(n_blocks)).cast("int").alias("block"), numbers(n_groups).alias("group"), F.lit(0).alias("asks"), "id", "vector")
    posed = asked.select(numbers(n_blocks).alias("block"), F.pmod(spot, F.lit(n_groups)).cast("int").alias("group"), F.lit(1).alias("asks"), "id", "vector")
    tiles = held.unionByName(posed).repartition(n_blocks * n_groups, "block", "group").sortWithinPartitions("block", "group", "asks")
    best = tiles.mapInArrow(_searcher(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.vector) + 1), lambda i: q.vector[i] * c.vector[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
