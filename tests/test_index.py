"""The kept BM25 index against searching anew."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import postings, retrieval
from tidemark.operators.postings import Postings


def rows(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())


@pytest.fixture
def texts():
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(80)]
    return [(i, " ".join(r.choice(vocabulary[: 1 + r.randrange(80)]) for _ in range(r.randint(0, 60)))) for i in range(400)]


def frame(spark, pairs, kind="long"):
    return spark.createDataFrame(pairs, f"chunk_id {kind}, content string")


QUERIES = [(1, "w1 w2 w70"), (2, "w0"), (3, "nothing"), (4, ""), (5, None), (6, "w3 w3 W4, w79")]


def test_index_is_the_same_after_every_change(spark, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "TEXTS", 32)
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    index = Postings(spark, f"file://{tmp_path}/index")
    held = {}

    def check():
        live = frame(spark, sorted(held.items()))
        assert rows(index.search(queries, 7)) == rows(retrieval.bm25_top_k(live, queries, 7))

    assert index.search(queries).count() == 0
    held.update(texts)
    assert index.upsert(frame(spark, [*texts, (None, "w1")])) == 1
    check()
    held.update({i: "w70 " + t for i, t in texts[:90]} | {1000: "w1 w2", 1001: None})
    assert index.upsert(frame(spark, [(i, held[i]) for i in [*range(90), 1000, 1001]])) == 2
    check()
    for i in (5, 100, 101, 1001):
        held.pop(i)
    assert index.delete(frame(spark, [(5, ""), (100, ""), (101, ""), (1001, ""), (9999, "")])) == 3
    check()
    held[5] = "w1 again"
    index.upsert(frame(spark, [(5, "w1 again")]))
    check()
    index.merge()
    check()
    index.delete(frame(spark, [(7, "")]))
    held.pop(7)
    check()


def test_names_as_ids(spark, texts, tmp_path):
    docs = frame(spark, [(f"n{i:03}", t) for i, t in texts], "string")
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    index = Postings(spark, f"file://{tmp_path}/index")
    index.upsert(docs)
    assert rows(index.search(queries, 5)) == rows(retrieval.bm25_top_k(docs, queries, 5))


def test_only_asked_buckets_and_promising_blocks_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "TEXTS", 16)
    docs = frame(spark, [(i, "rare common" if i < 3 else " ".join(["common"] * (1 + i % 7) + [f"x{i}"] * (i % 90))) for i in range(800)])
    index = Postings(spark, f"file://{tmp_path}/index")
    index.upsert(docs)
    queries = spark.createDataFrame([(1, "rare common")], "query_id long, query string")
    found = index.search(queries, 3)
    assert rows(found) == rows(retrieval.bm25_top_k(docs, queries, 3))
    assert index.read.count() < index.known.count() / 4
    asked = spark.sql("SELECT array_sort(collect_set(pmod(xxhash64(w), 64))) b FROM VALUES ('rare'), ('common') t(w)").first().b
    scan = index.search(queries, 3)._jdf.queryExecution().toString()
    assert "PartitionFilters" in scan and f"bucket#" in scan
    files = {f.split("bucket=")[1].split("/")[0] for f in spark.read.parquet(f"file://{tmp_path}/index/postings").where(F.col("bucket").isin(asked)).inputFiles()}
    assert set(map(str, asked)) <= files


def test_equal_texts_leave_a_block_k_at_a_time(spark, tmp_path):
    docs = spark.range(20_000).select(F.col("id").alias("chunk_id"), F.lit("the same text").alias("content"))
    queries = spark.createDataFrame([(1, "same"), (2, "text the")], "query_id long, query string")
    want = [(q, i + 1, i) for q in (1, 2) for i in range(5)]
    found = retrieval.bm25_top_k(docs, queries, 5)
    assert [x[:3] for x in rows(found)] == want
    index = Postings(spark, f"file://{tmp_path}/index")
    index.upsert(docs)
    assert [x[:3] for x in rows(index.search(queries, 5))] == want
    scores = retrieval.k_best(np.ones((2, 1000)), 5)
    assert scores[1].tolist() == [0, 1, 2, 3, 4] * 2
