"""Hard negatives against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SMALL, rows_of, rows_of_spark
from tidemark.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, n_pos=5, n_neg=5, scale=256):
    whole = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    ints = {(i, label, tuple(math.floor(scale * x) for x in np.float32(v).astype(float).tolist())) for i, v, label in rows if i is not None and label is not None and whole(v)}
    out = []
    for a, label, q in ints:
        if a % 100:
            continue
        score = lambda v: sum(x * y for x, y in zip(q, v))
        others = sorted(((-score(v), i, y) for i, y, v in ints if i != a), key=lambda x: x[:2])
        positives = [(-s, i) for s, i, y in others if y == label][:n_pos]
        for p, pid in positives:
            found = [(-s, i) for s, i, y in others if y != label and 80 * p <= -100 * s <= 100 * p][:n_neg]
            out += [(a, pid, n, i, p, s) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("id", "vector", "block", "group", "asks", "low", "high", "spot", "score", "rank"):
        df = df.withColumn(c, F.lit("x"))
    return negatives.hard_negatives(df, df.where("vec_id % 100 = 0"), **more)


def vectors(n, dim=8, centres=6, seed=1):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dim))
    x = c[r.integers(0, centres, n)] + 0.4 * r.normal(size=(n, dim))
    return [(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x / np.linalg.norm(x, axis=1)[:, None], r.integers(0, 4, n)))]


def test_tree_and_windows_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 8)
    monkeypatch.setattr(negatives, "BLOCK", 300)
    rows = vectors(1500)
    rows += [(2000 + i, rows[7][1], i % 3) for i in range(40)]  # ties
    rows += [(3000, None, 1), (None, rows[0][1], 1), (3100, [0.5, None] * 4, 1), (3200, [math.nan] * 8, 2), (3300, [math.inf] * 8, 2), (3400, rows[5][1], None), (3500, [0.0] * 8, 1), (3600, [3.0] * 8, 2), rows[4], rows[100]]
    assert result(mined(spark, rows)) == brute(rows)


def test_tree_search_is_exact_and_leaves_out_subtrees(monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 16)
    r = np.random.default_rng(4)
    centres = r.integers(-2000, 2000, (40, 6))
    x = centres[r.integers(0, 40, 4000)] + r.integers(-20, 20, (4000, 6))
    ids, labels = r.permutation(4000).astype(np.int64), r.integers(0, 3, 4000)
    tree = negatives.HyperplaneTree(ids, labels, x)
    seen = []
    real = negatives.HyperplaneTree._leaf
    monkeypatch.setattr(negatives.HyperplaneTree, "_leaf", lambda self, node, who, *a: seen.append((node.hi - node.lo) * len(who)) or real(self, node, who, *a))
    who = np.arange(50)
    s = x[who] @ x.T
    high = np.sort(s, 1)[:, [-20, -200]]
    low = -(-high * 8 // 10)
    a, w, near, score = tree.search(ids[who], labels[who], x[who], low, high, False, 5)
    got = sorted(zip(a.tolist(), w.tolist(), (-score).tolist(), near.tolist()))
    want = []
    for i in who:
        for k in range(2):
            may = np.flatnonzero((labels != labels[i]) & (ids != ids[i]) & (s[i] >= low[i, k]) & (s[i] <= high[i, k]))
            want += sorted((int(i), k, int(-s[i, j]), int(ids[j])) for j in may)[:5]
    assert got == sorted(want)
    assert sum(seen) < 0.5 * 50 * 4000


def test_scores_beyond_doubles(spark):
    rows = [(0, [3e5, 1.0], 1), (1, [3e5, 2.0], 1), (2, [2.9e5, 3.0], 2), (3, [2.9e5, 3.004], 2)]
    assert result(mined(spark, rows)) == brute(rows)


def test_crowd_of_equal_vectors(spark):
    rows = [(i, [1.0, 0.0], i % 2) for i in range(3000)] + [(5000, [0.9, 0.1], 0)]
    assert result(mined(spark, rows)) == brute(rows)


def test_few_or_no_rows(spark):
    assert result(mined(spark, [(0, [1.0], 1)])) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [-1.0], 2)]).count() == 0
    df = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(df, df).count() == 0


def test_query_matches_its_sql(spark, duck):
    df = negatives.op12_hard_negatives(spark, SMALL)
    assert rows_of_spark(df) == rows_of(duck, negatives.OP12_SQL)
    assert df.count() > 0
