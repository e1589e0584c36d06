"""Hard negatives by a multiway hyperplane tree that keeps the distance ranges between siblings.

Vectors become integer vectors, and are lifted by one coordinate so that all have the largest length:
an anchor's inner product with a row then fixes their distance, and a window of scores is a ring of
distances around the anchor.  Rows are sorted by label and cut into blocks.  A block's tree splits
a node's rows among far-apart split points, each row to its nearest, and keeps for each split point
the nearest and farthest row of every sibling's subtree.  A subtree goes if those ranges put all of
its rows outside of the ring, which narrows as better rows are found.  Leaves are scored exactly.
Anchors stream past a block's tree in groups, so neither side is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import discard, table, working_tables, written
from .topk import _matrix, _wide

FANOUT, LEAF = 12, 192
BLOCK, LEAST_BLOCKS, ANCHOR_GROUP = 16384, 12, 1 << 16
_AT_ONCE = 1024  # anchors that go down a tree together
_EXACT = float(1 << 53)
NONE = np.iinfo(np.int64).min


class Node:
    """Rows lo .. hi - 1 of the tree's order; a leaf has no children."""

    __slots__ = ("lo", "hi", "labels", "points", "near", "far", "children")

    def __init__(self, lo: int, hi: int, labels: np.ndarray):
        self.lo, self.hi, self.labels = lo, hi, labels
        self.points = self.near = self.far = None
        self.children: list[Node] = []


class HyperplaneTree:
    """Rows (ids, labels, integer vectors) of one block."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        by = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.vectors = ids[by], labels[by], vectors[by]
        x = self.vectors.astype(np.float64)
        self.squares = (x * x).sum(1)
        self.top = self.squares.max(initial=0.0)
        self.x = np.column_stack([x, np.sqrt(np.maximum(0.0, self.top - self.squares))])
        self.largest = np.abs(x).max(initial=0.0)
        order = np.arange(len(ids))
        self.root = self._split(order, 0, len(ids))
        self.ids, self.labels, self.vectors, self.x = self.ids[order], self.labels[order], self.vectors[order], self.x[order]

    def _distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)))

    def _split(self, order: np.ndarray, lo: int, hi: int) -> Node:
        """Sorts order[lo:hi] by subtree."""
        rows = order[lo:hi]
        node = Node(lo, hi, np.unique(self.labels[rows]))
        if hi - lo <= LEAF:
            return node
        # Split points: of an even choice of rows, the next is always the one farthest from those taken.
        some = rows[np.linspace(0, len(rows) - 1, 4 * FANOUT).astype(np.int64)]
        apart = self._distances(self.x[some], self.x[some])
        taken, least = [0], apart[0].copy()
        while len(taken) < FANOUT and least.max() > 1e-6 * (1 + np.sqrt(self.top)):
            taken.append(int(least.argmax()))
            least = np.minimum(least, apart[taken[-1]])
        if len(taken) < 2:
            return node  # the chosen rows are equal: a long leaf
        points = self.x[some[taken]]
        d = self._distances(self.x[rows], points)
        owner = d.argmin(1)
        by = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[by], np.arange(len(taken) + 1))
        if np.diff(cuts).max() == len(rows):
            return node
        order[lo:hi] = rows[by]
        full = np.flatnonzero(np.diff(cuts))
        node.points = points
        node.near = np.stack([d[by[cuts[j] : cuts[j + 1]]].min(0) for j in full], 1)  # split point x subtree
        node.far = np.stack([d[by[cuts[j] : cuts[j + 1]]].max(0) for j in full], 1)
        node.children = [self._split(order, lo + cuts[j], lo + cuts[j + 1]) for j in full]
        return node

    def search(self, own: np.ndarray, labels: np.ndarray, anchors: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        """(anchor's row, window, id, score): for each anchor and window the k best rows of the block.

        low and high: anchors x windows, the least and largest score.  Rows have the anchor's label if
        same, else another; a row with the anchor's id (own) never counts.  Ties go to smaller ids.
        """
        q = anchors.astype(np.float64)
        squares = (q * q).sum(1)
        held = _Best(low.shape, k)
        exact = max(1.0, self.largest) * max(1.0, np.abs(q).max(initial=0.0)) * q.shape[1] < _EXACT
        lifted = np.column_stack([q, np.zeros(len(q))])
        slack = 1e-6 * (1 + np.sqrt(self.top + squares.max(initial=0.0)))
        low, high = low.copy(), high.copy()

        def ring(who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Distances of the union of an anchor's windows, as they are by now."""
            a = squares[who] + self.top
            lo, hi = low[who].min(1).astype(np.float64), high[who].max(1).astype(np.float64)
            return np.sqrt(np.maximum(0.0, a - 2 * hi)) - slack, np.sqrt(np.maximum(0.0, a - 2 * lo)) + slack

        def fits(node: Node, who: np.ndarray) -> np.ndarray:
            if same:
                return who[np.isin(labels[who], node.labels)]
            return who[labels[who] != node.labels[0]] if len(node.labels) == 1 else who

        def visit(node: Node, who: np.ndarray) -> None:
            who = fits(node, who)
            if not len(who):
                return
            if not node.children:
                self._leaf(node, who, own, labels, anchors, q, low, high, same, exact, held)
                return
            d = self._distances(lifted[who], node.points)
            # A row of subtree j is between these distances from the anchor.
            least = np.max(np.maximum(d[:, :, None] - node.far, node.near - d[:, :, None]), 1)
            most = np.min(d[:, :, None] + node.far, 1)
            first = np.argsort(least.sum(0), kind="stable")
            for j in first:
                inner, outer = ring(who)
                visit(node.children[j], who[(least[:, j] <= outer) & (most[:, j] >= inner)])

        visit(self.root, np.arange(len(q)))
        return held.rows()

    def _leaf(self, node, who, own, labels, anchors, q, low, high, same, exact, held) -> None:
        rows = slice(node.lo, node.hi)
        if exact:
            scores = (q[who] @ self.vectors[rows].astype(np.float64).T).astype(np.int64)
        else:
            scores = anchors[who] @ self.vectors[rows].T
        alike = labels[who][:, None] == self.labels[rows]
        may = (alike if same else ~alike) & (own[who][:, None] != self.ids[rows])
        for w in range(low.shape[1]):
            a, r = np.nonzero(may & (scores >= low[who, w][:, None]) & (scores <= high[who, w][:, None]))
            if len(a):
                bars = held.add(who[a], w, self.ids[rows][r], scores[a, r])
                low[who, w] = np.maximum(low[who, w], bars[who])


class _Best:
    """The k best (score, id) of each anchor and window, so far."""

    def __init__(self, shape: tuple[int, int], k: int):
        self.k = k
        self.count = np.zeros(shape, np.int64)
        self.ids = np.full((*shape, k), np.iinfo(np.int64).max)
        self.scores = np.full((*shape, k), NONE)

    def add(self, who: np.ndarray, w: int, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Takes in rows (who ascending), and gives for each anchor the score that a row needs at least."""
        some = np.unique(who)
        have = np.arange(self.k) < self.count[some, w][:, None]
        at = np.repeat(some, have.sum(1))
        who, ids, scores = np.concatenate([at, who]), np.concatenate([self.ids[some, w][have], ids]), np.concatenate([self.scores[some, w][have], scores])
        by = np.lexsort((ids, -scores, who))
        who, ids, scores = who[by], ids[by], scores[by]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        keep = rank < self.k
        who, rank = who[keep], rank[keep]
        self.ids[who, w, rank], self.scores[who, w, rank] = ids[keep], scores[keep]
        self.count[some, w] = np.searchsorted(who, some, "right") - np.searchsorted(who, some)
        return np.where(self.count[:, w] == self.k, self.scores[:, w, -1], NONE)

    def rows(self):
        a, w, r = np.nonzero(np.arange(self.k) < self.count[:, :, None])
        return a, w, self.ids[a, w, r], self.scores[a, w, r]


def _lists(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _searcher(same: bool, k: int):
    """Over partitions sorted by block and group, each block's rows before its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tree = None, [], None
        for b in batches:
            block, group, asks = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            ids, labels, vectors = b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False), _matrix(b.column(5))
            edges = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (group[1:] != group[:-1]) | (asks[1:] != asks[:-1])])) if len(block) else []
            for lo, hi in zip(edges, [*edges[1:], len(block)], strict=True):
                if (block[lo], group[lo]) != key:
                    key, held, tree = (block[lo], group[lo]), [], None
                if not asks[lo]:
                    held.append((ids[lo:hi], labels[lo:hi], vectors[lo:hi]))
                    continue
                if not held:
                    continue
                if tree is None:
                    width = max(x.shape[1] for _, _, x in held)
                    tree = HyperplaneTree(np.concatenate([i for i, _, _ in held]), np.concatenate([i for _, i, _ in held]), np.concatenate([_wide(x, width) for _, _, x in held]))
                    held = held[:1]
                low, high = _lists(b.column(6).slice(lo, hi - lo)), _lists(b.column(7).slice(lo, hi - lo))
                asked = _wide(vectors[lo:hi], max(vectors.shape[1], tree.vectors.shape[1]))[:, : tree.vectors.shape[1]]
                for at in range(0, hi - lo, _AT_ONCE):
                    part = slice(at, at + _AT_ONCE)
                    a, w, near, scores = tree.search(ids[lo:hi][part], labels[lo:hi][part], asked[part], low[part], high[part], same, k)
                    if len(a):
                        window = high[part][a, w]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[lo:hi][part][a], window, near, scores)], names=["anchor_id", "high", "vec_id", "score"])

    return run


def _ranked(blocks: DataFrame, n_blocks: int, posed: DataFrame, n_anchors: int, same: bool, k: int) -> DataFrame:
    """anchor_id, high, rank, vec_id, score: the k best rows of each window (low, high) of each anchor in posed."""
    n_groups = max(1, -(-n_anchors // ANCHOR_GROUP))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None).cast("array<long>")
    held = blocks.select("block", numbers(n_groups).alias("group"), F.lit(0).alias("asks"), "id", "label", "vector", none.alias("low"), none.alias("high"))
    group = F.pmod(F.xxhash64("id"), F.lit(n_groups)).cast("int").alias("group")
    if same:  # only to the blocks that have the label
        where = blocks.select("label", "block").distinct()
        asked = posed.join(where, "label")
    else:
        asked = posed.withColumn("block", numbers(n_blocks))
    asked = asked.select("block", group, F.lit(1).alias("asks"), "id", "label", "vector", "low", "high")
    tiles = held.unionByName(asked).repartition(n_blocks * n_groups, "block", "group").sortWithinPartitions("block", "group", "asks")
    found = tiles.mapInArrow(_searcher(same, k), "anchor_id long, high long, vec_id long, score long")
    order = Window.partitionBy("anchor_id", "high").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 5, share: int = 80, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x becomes floor(scale * x), x as double; a score is the inner product with the
    anchor, exact as long as it fits in 63 bits.  An anchor's positives are the n_positives best other
    rows of its label.  The hard negatives of anchor and positive are the n_negatives best rows of
    other labels whose score is between share percent of the positive's and all of it.  Ties go to
    the smaller id, fewer rows are all returned, and a positive with a negative score has no negatives.
    Rows whose id, label or vector is null, or whose vector holds a null or a number that is not
    finite, take no part, neither as anchors; shorter vectors count as padded with zeros; rows that
    repeat id, label and vector count once, and other rows of the anchor's id are never its
    positives or negatives.  Ids and labels must be whole numbers.  Other columns are ignored.
    """

    def whole(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        fit = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        integers = F.transform(v, lambda x: F.floor(x * F.lit(scale)).cast("long"))
        return df.where(F.coalesce(fit, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), integers.alias("vector")).distinct()

    spark = vectors.sparkSession
    with working_tables(spark) as kept:
        rows, asked = written(whole(vectors), "labelled"), written(whole(anchors), "anchors")
        n_blocks, n_anchors = max(LEAST_BLOCKS, -(-rows.count() // BLOCK)), asked.count()
        # Ranges of (label, hash): about equally many rows each, however many have one label or one vector.
        spread = rows.withColumn("spot", F.xxhash64("id")).repartitionByRange(n_blocks, "label", "spot")
        blocks = written(spread.select(F.spark_partition_id().alias("block"), "id", "label", "vector"), "blocks")
        discard(rows)
        n_blocks = 1 + (blocks.agg(F.max("block")).first()[0] or 0)
        any_score = asked.withColumn("low", F.array(F.lit(int(NONE)).cast("long"))).withColumn("high", F.array(F.lit(2**63 - 1).cast("long")))
        positives = _ranked(blocks, n_blocks, any_score, n_anchors, True, n_positives)
        positives = written(positives.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        # A window for each score that a positive has, in arrays of one length: what is left over is empty.
        high = F.sort_array(F.collect_set("positive_score"), asc=False)
        windows = positives.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("id")).agg(high.alias("high"))
        full = F.transform(F.sequence(F.lit(0), F.lit(n_positives - 1)), lambda i: F.coalesce(F.get("high", i), F.lit(-1).cast("long")))
        windows = windows.select("id", full.alias("high"))
        # The least whole number that is not below the share; out of reach where the window is empty.
        low = F.transform("high", lambda s: F.when(s < 0, F.lit(2**62).cast("long")).otherwise(F.lit(-1).cast("long") * F.floor(F.lit(-share).cast("decimal(20,0)") * s / F.lit(100)).cast("long")))
        posed = asked.join(windows, "id").withColumn("low", low)
        negatives = _ranked(blocks, n_blocks, posed, n_anchors, False, n_negatives).withColumnRenamed("high", "positive_score")
        out = positives.join(negatives, ["anchor_id", "positive_score"])
        out = written(out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "hard_negatives")
        kept.append(out)
    return out


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row; labels of ids divisible by 7 are changed to the next of ten, anchors are ids divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives(vectors, vectors.where("vec_id % 100 = 0"))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
p AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, CAST(list_sum(list_transform(range(1, len(q.vector) + 1), lambda i: q.vector[i] * c.vector[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, p.vec_id AS negative_id, positive_score, p.score AS negative_score
FROM pos JOIN p USING (anchor_id)
WHERE NOT p.same AND 80 * positive_score <= 100 * p.score AND 100 * p.score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY p.score DESC, p.vec_id) QUALIFY row_number() OVER w <= 5
"""
