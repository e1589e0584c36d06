"""The clustered vector index against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.operators import clusters, retrieval


def rows(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<double>")


def asked(df):
    return df.withColumnRenamed("chunk_id", "query_id")


@pytest.fixture(scope="module")
def points():
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 10))
    return centres[r.integers(0, 12, 1500)] + 0.25 * r.normal(size=(1500, 10))


@pytest.fixture(scope="module")
def index(spark, points):
    return clusters.cluster(frame(spark, points), 24, k=10)


def test_exact_search_is_exact_and_skips_lists(spark, points, index):
    df = frame(spark, points)
    q = asked(df.where("chunk_id % 50 = 0"))
    exact = clusters.search(index, q, 10, exact=True)
    assert rows(exact) == rows(retrieval.vector_top_k(df, q, 10))
    assert 1 <= index.nprobe <= 8 and len(index.centroids) == 24


def test_recall_of_the_lists_that_are_read(spark, points, index):
    q = asked(frame(spark, points).where("chunk_id % 50 = 0"))
    told = clusters.recall_at(clusters.search(index, q, 10), clusters.search(index, q, 10, exact=True)).collect()
    assert len(told) == 30 and sum(r.hits for r in told) >= 0.9 * sum(r.wanted for r in told)


def test_every_vector_is_in_its_nearest_list(points, index):
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    d = np.linalg.norm(unit[:, None] - index.centroids, axis=2)
    for r in index.lists.collect():
        assert d[r.chunk_id, r["list"]] <= d[r.chunk_id].min() + 1e-9 and d[r.chunk_id, r["list"]] <= index.radius[r["list"]] + 1e-9
    assert index.lists.count() == 1500


def test_changes(spark, points, index):
    r = np.random.default_rng(5)
    new = frame(spark, r.normal(size=(40, 10)), 1490)
    changed = clusters.delete_keys(clusters.upsert(index, new), spark.range(0, 100).withColumnRenamed("id", "chunk_id"))
    df = frame(spark, points).where("chunk_id BETWEEN 100 AND 1489").unionByName(new)
    q = asked(df.where("chunk_id % 50 = 0"))
    assert rows(clusters.search(changed, q, 5, exact=True)) == rows(retrieval.vector_top_k(df, q, 5))


def test_few_equal_and_missing_vectors(spark):
    same = frame(spark, np.ones((300, 4)))
    more = same.unionByName(spark.createDataFrame([(900, None), (None, [1.0] * 4), (901, [0.0] * 4)], same.schema))
    index = clusters.cluster(more, k=5)
    found = clusters.search(index, asked(same.where("chunk_id < 2")), 5, exact=True)
    assert [(q, c) for q, _, c, _ in rows(found)] == [(q, c) for q in (0, 1) for c in range(5)]
    none = clusters.cluster(same.limit(0))
    assert clusters.search(none, asked(same), 5).count() == 0


def test_measured_recall_on_the_given_vectors(spark):
    v = spark.read.parquet(f"{SMALL}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    index = clusters.cluster(v)
    q = asked(v.where("chunk_id % 50 = 0"))
    told = clusters.recall_at(clusters.search(index, q), retrieval.vector_top_k(v, q)).agg(F.sum("hits") / F.sum("wanted")).first()[0]
    assert told >= 0.9 and index.nprobe <= len(index.centroids)
