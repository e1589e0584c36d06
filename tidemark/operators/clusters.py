"""A clustered vector index: vectors by their nearest centroid, a few lists read for each question.

Vectors are compared by their cosine, so they are kept at length 1.  k-means is fitted on a bounded
sample, taken by hash; every vector is put into the list of its nearest centroid, and a list's radius
is the distance of its farthest vector.  A search reads the lists nearest to the question; how many is
set by measuring the recall on a bounded sample of the vectors themselves.  The exact search goes on
from there: a list that, by its radius, can't hold anything better than what was found is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from tidemark.operators.retrieval import QUESTIONS, TEXTS, k_best, ranked
from tidemark.session import checkpointed

#: Lists at most, vectors of the fitting sample for each list, and rounds of k-means.
LISTS, SAMPLE, ROUNDS = 1024, 64, 8
#: Vectors that the number of lists to read is measured with, at most.
PROBES = 400


@dataclass
class Clusters:
    """lists: list, chunk_id, v (of length 1); centroids and radius by list number; nprobe lists are read."""

    lists: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    nprobe: int = 0


def _unit(df: DataFrame, id_col: str, vector_col: str, name: str) -> DataFrame:
    """id and v, of length 1; rows without id or vector, and zero vectors, are left out, as nothing is near to them."""
    v = F.col(vector_col).cast("array<double>")
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).alias(name), v.alias("v")).withColumn("size", size)
    return rows.where("size > 0").select(name, F.transform("v", lambda x: x / F.col("size")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest centroid and its distance."""
    d = np.maximum(0, (x * x).sum(1)[:, None] + (centroids * centroids).sum(1) - 2 * x @ centroids.T)
    at = d.argmin(1)
    return at, np.sqrt(d[np.arange(len(x)), at])


def fit(unit: DataFrame, n_lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of k-means on a sample of n_lists * SAMPLE vectors by hash; each round is one pass of partial sums."""
    spark = unit.sparkSession
    sample = checkpointed(unit.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(n_lists * SAMPLE))
    start = [r.v for r in sample.orderBy(F.xxhash64(F.lit(1), "chunk_id"), "chunk_id").limit(n_lists).collect()]  # at most LISTS
    centroids = np.array(start, float)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(centroids)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            c = sent.value
            total, count = np.zeros_like(c), np.zeros(len(c), np.int64)
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column(0))
                    at, _ = _nearest(x, c)
                    np.add.at(total, at, x)
                    count += np.bincount(at, minlength=len(c))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.float64()))], names=["list", "n", "total"])

        parts = sample.select("v").mapInArrow(sums, "list long, n long, total array<double>")
        dims = F.posexplode("total").alias("d", "x")
        summed = parts.select("list", "n", dims).groupBy("list", "d").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        for r in summed.groupBy("list").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("d", "x"))).alias("x")).collect():  # the centroids
            centroids[r.list] = np.array([y.x for y in r.x]) / r.n
    return centroids


def cluster(vectors: DataFrame, n_lists: int | None = None, id_col: str = "chunk_id", vector_col: str = "embedding", k: int = 20, recall: float = 0.95) -> Clusters:
    """Fit, fill the lists, and set nprobe to reach the recall of k on the sample (see ``measured``).

    Without n_lists about the square root of the number of vectors, LISTS at most.
    """
    spark = vectors.sparkSession
    unit = checkpointed(_unit(vectors, id_col, vector_col, "chunk_id"))
    n = unit.count()
    n_lists = max(1, min(n_lists or int(np.sqrt(n)), LISTS, n)) if n else 1
    if not n:
        return Clusters(unit.withColumn("list", F.lit(0)), np.zeros((0, 0)), np.zeros(0))
    centroids = fit(unit, n_lists)
    sent = spark.sparkContext.broadcast(centroids)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, far = _nearest(_matrix(b.column(1)), sent.value)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(far)], names=["chunk_id", "v", "list", "far"])

    kind = dict(unit.dtypes)["chunk_id"]
    lists = checkpointed(unit.mapInArrow(placed, f"chunk_id {kind}, v array<double>, list int, far double"))
    radius = np.zeros(n_lists)
    for r in lists.groupBy("list").agg(F.max("far").alias("far")).collect():  # at most LISTS
        radius[r.list] = r.far
    found = Clusters(lists.select("list", "chunk_id", "v"), centroids, radius)
    found.nprobe = measured(found, k, recall)
    return found


def measured(index: Clusters, k: int, recall: float) -> int:
    """The least number of lists that find this share of the k nearest, on up to PROBES of the vectors, in one exact search."""
    some = index.lists.orderBy(F.xxhash64(F.lit(2), "chunk_id"), "chunk_id").limit(PROBES)
    asked = checkpointed(some.select(F.col("chunk_id").alias("query_id"), "v"))
    found = _scored(index, _spread(index, asked, len(index.centroids)), asked, k, with_place=True)
    places = ranked(found, k).groupBy("place").agg(F.count("*").alias("n")).collect()  # at most LISTS
    count = np.zeros(len(index.centroids) + 1, np.int64)
    for r in places:
        count[r.place] = r.n
    share = np.cumsum(count) / max(1, count.sum())
    return int(np.searchsorted(share, recall - 1e-12)) or 1


def _spread(index: Clusters, asked: DataFrame, most: int, least: DataFrame | None = None) -> DataFrame:
    """query_id, list, place: the lists of each asked (query_id, v), nearest first, from place 1 to most.

    With least (query_id, least: the k-th best cosine so far, null if there are fewer), those beyond
    ``most`` that may hold something as good.
    """
    sent = asked.sparkSession.sparkContext.broadcast((index.centroids, index.radius))
    rows = asked.select("query_id", "v", F.lit(None).cast("double").alias("least")) if least is None else asked.join(least, "query_id", "left").select("query_id", "v", "least")
    beyond = least is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, radius = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (centroids * centroids).sum(1) - 2 * x @ centroids.T))
            place = np.empty(d.shape, np.int64)
            np.put_along_axis(place, d.argsort(1, kind="stable"), np.broadcast_to(np.arange(1, d.shape[1] + 1), d.shape), 1)
            if beyond:
                # At a distance t the cosine of unit vectors is 1 - t * t / 2; nothing in a list is nearer than this.
                near = np.maximum(0, d - radius - 1e-6)
                bar = pa.compute.fill_null(b.column(2), -2.0).to_numpy(zero_copy_only=False)
                take = (place > most) & (1 - near * near / 2 >= bar[:, None] - 2e-6)
            else:
                take = place <= most
            q, at = np.nonzero(take)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(q)), pa.array(at.astype(np.int32)), pa.array(place[q, at].astype(np.int32))], names=["query_id", "list", "place"])

    return rows.mapInArrow(run, f"query_id {dict(asked.dtypes)['query_id']}, list int, place int")


def _scored(index: Clusters, spread: DataFrame, asked: DataFrame, k: int, with_place: bool = False) -> DataFrame:
    """query_id, chunk_id, score (and place): the k best of each list for its questions.

    A list is cut into parts of TEXTS vectors and its questions into groups, by hash, so that no task
    grows with a list or with the number of its questions.
    """
    parts = index.lists.groupBy("list").agg(F.ceil(F.count("*") / TEXTS).cast("int").alias("parts"))
    groups = spread.groupBy("list").agg(F.ceil(F.count("*") / QUESTIONS).cast("int").alias("groups"))
    sizes = checkpointed(groups.join(parts, "list"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = index.lists.join(sizes, "list").select("list", F.pmod(F.xxhash64("chunk_id"), "parts").cast("int").alias("part"), numbers("groups").alias("group"), "chunk_id", "v")
    posed = spread.join(sizes, "list").select("list", numbers("parts").alias("part"), F.pmod(F.xxhash64("query_id"), "groups").cast("int").alias("group"), "query_id", "place").join(asked, "query_id")
    key = ["list", "part", "group"]

    def search(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(wanted):
            return pd.DataFrame({"query_id": wanted["query_id"][:0], "chunk_id": rows["chunk_id"][:0], "score": pd.Series(dtype="float64"), "place": wanted["place"][:0]})
        rows = rows.sort_values("chunk_id")
        sims = np.round(np.stack(wanted["v"].to_numpy()) @ np.stack(rows["v"].to_numpy()).T, 6)
        i, j = k_best(sims, k)
        return pd.DataFrame({"query_id": wanted["query_id"].to_numpy()[i], "chunk_id": rows["chunk_id"].to_numpy()[j], "score": sims[i, j], "place": wanted["place"].to_numpy()[i]})

    kinds = f"query_id {dict(asked.dtypes)['query_id']}, chunk_id {dict(index.lists.dtypes)['chunk_id']}, score double, place int"
    found = held.groupBy(*key).cogroup(posed.groupBy(*key)).applyInPandas(search, kinds)
    return found if with_place else found.drop("place")


def search(index: Clusters, queries: DataFrame, k: int = 20, vector_col: str = "embedding", exact: bool = False) -> DataFrame:
    """query_id, chunk_id, score (cosine, six decimals), rank: the k best in the nprobe nearest lists of each query, or, if exact, of all.

    Exact costs a second pass over the lists that may still hold one of the k best.  Zero vectors have
    no direction: they are not found, and find nothing.
    """
    asked = checkpointed(_unit(queries, "query_id", vector_col, "query_id"))
    if not len(index.centroids):
        return asked.join(index.lists, F.lit(False)).select("query_id", "chunk_id", F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    near = _scored(index, _spread(index, asked, index.nprobe), asked, k)
    if not exact:
        return ranked(near, k)
    near = checkpointed(ranked(near, k))
    least = near.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = checkpointed(_spread(index, asked, index.nprobe, least))
    return ranked(near.drop("rank").unionByName(_scored(index, rest, asked, k)), k)


def recall_at(found: DataFrame, exact: DataFrame, k: int = 20) -> DataFrame:
    """query_id, hits, wanted: how many of each query's exact k best were found."""
    hits = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return hits.groupBy("query_id").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.count("*").alias("wanted"))


def delete_keys(index: Clusters, keys: DataFrame, key: str = "chunk_id") -> Clusters:
    """Without the given ids; radii stay bounds."""
    return Clusters(checkpointed(index.lists.join(keys.select(F.col(key).alias("chunk_id")), "chunk_id", "left_anti")), index.centroids, index.radius, index.nprobe)


def upsert(index: Clusters, rows: DataFrame, id_col: str = "chunk_id", vector_col: str = "embedding") -> Clusters:
    """With rows in place of those with their ids, in the lists of the centroids as they are; of rows with one id any one counts."""
    unit = _unit(rows, id_col, vector_col, "chunk_id").dropDuplicates(["chunk_id"])
    spread = checkpointed(_spread(index, unit.select(F.col("chunk_id").alias("query_id"), "v"), 1).select("list", F.col("query_id").alias("chunk_id")))
    new = spread.join(unit, "chunk_id").select("list", "chunk_id", "v")
    lists = checkpointed(delete_keys(index, rows, id_col).lists.unionByName(new))
    centre = rows.sparkSession.createDataFrame([(i, c) for i, c in enumerate(index.centroids.tolist())], "list int, c array<double>")
    far = F.sqrt(F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    radius = index.radius.copy()
    for r in new.join(F.broadcast(centre), "list").groupBy("list").agg(F.max(far).alias("far")).collect():  # at most LISTS
        radius[r.list] = max(radius[r.list], r.far)
    return Clusters(lists, index.centroids, radius, index.nprobe)
