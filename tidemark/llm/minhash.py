"""Near-duplicate classes by min-max hashing.

Every shingle hash is multiplied by one odd constant per permutation, and both the smallest
and the largest product are kept, so ``bands * rows`` signature values cost half as many
multiplications.  Bands of ``rows`` values propose pairs; each proposed link is confirmed on
the full shingle sets.

* Copies (equal shingle sets) collapse to one class before anything is paired.
* In a bucket every member is first tested against the bucket's smallest class, its centre.  What
  is then one component needs no more tests.  Around a centre (the members of its buckets of three
  and more) those outside the largest component are tested against all, in tiles of bounded size,
  without a row per pair.  Chains of colliding documents are never followed: the work grows with
  the collisions of single documents, however far these hang together.
* Links are reduced to components by joins (components.py).

The chance of missing a link at Jaccard exactly 0.8 is (1 - 0.8**6)**46, under 1e-6; it falls
steeply above.  Shingle hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .components import connected_components
from .shared import discard, table, written
from .words import mix, split

BANDS, ROWS = 46, 6
#: Documents around a centre that are tested together.
TILE = 512


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each slice of the batch: the sorted distinct shingle hashes of its rows, and where each row's begin."""
    for w in split(texts):
        at, g = w.grams(words)
        doc = w.doc[at]
        count = np.diff(w.offset)
        few = np.flatnonzero((count > 0) & (count < words))
        if len(few):
            doc = np.concatenate([doc, few])
            g = np.concatenate([g, w.spans(w.offset[few], w.offset[few + 1])])
        order = np.lexsort((g, doc))
        doc, g = doc[order], g[order]
        if len(g):
            new = np.ones(len(g), dtype=bool)
            new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
            doc, g = doc[new], g[new]
        yield g, np.searchsorted(doc, np.arange(w.n_docs + 1))


def _signatures(g: np.ndarray, offset: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """bands x documents (those with shingles) keys."""
    full = np.flatnonzero(np.diff(offset))
    starts = offset[full]
    values = np.empty((bands * rows, len(full)), dtype=np.uint64)
    for i, a in enumerate(_multipliers(bands * rows // 2)):
        h = g * a
        values[2 * i] = np.minimum.reduceat(h, starts)
        values[2 * i + 1] = np.maximum.reduceat(h, starts)
    # A band takes values of different permutations: the lowest and highest of one are not independent.
    order = np.concatenate([np.arange(0, bands * rows, 2), np.arange(1, bands * rows, 2)])
    values = mix(values[order]).reshape(bands, rows, len(full))
    keys = np.zeros((bands, len(full)), dtype=np.uint64)
    for r in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, r])
    return keys


def _sketcher(words: int, bands: int, rows: int):
    """id, text, hash of the text -> with the set's size, its two hashes and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for g, offset in shingle_sets(b.column(1), words):
                n = np.diff(offset)
                full = np.flatnonzero(n)
                ids, hashes = b.column(0).slice(at, len(n)), b.column(2).slice(at, len(n))
                at += len(n)
                keys = np.zeros((len(n), bands), dtype=np.int64)
                h1, h2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                if len(full):
                    keys[full] = _signatures(g, offset, bands, rows).T.view(np.int64)
                    h1[full] = np.add.reduceat(mix(g ^ np.uint64(0x51ED2701)), offset[full])
                    h2[full] = np.bitwise_xor.reduceat(mix(g + np.uint64(0x2545F491)), offset[full])
                bounds = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys[full].ravel()))
                yield pa.RecordBatch.from_arrays([ids, hashes, pa.array(n.astype(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists], names=["doc_id", "text_hash", "n_shingles", "h1", "h2", "bands"])

    return run


def _set_maker(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for g, offset in shingle_sets(b.column(1), words):
                n = len(offset) - 1
                sets = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((offset * 8).astype(np.int64)), pa.py_buffer(g.tobytes())])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), sets.cast(pa.binary())], names=["id", "shingles"])
                at += n

    return run


def _confirmer(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                same = int(np.count_nonzero(q[np.minimum(at, len(q) - 1)] == p)) if len(q) else 0
                good.append(100 * same >= percent * (len(p) + len(q) - same))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _tile_links(rows: list[tuple[bool, int, int, np.ndarray]], percent: int) -> Iterator[tuple[int, int]]:
    """For each asking row one link into each component that it is similar to; rows: (asks, id, component, shingles)."""
    members, queries = [r for r in rows if not r[0]], [r for r in rows if r[0]]
    if not members or not queries:
        return
    sizes = np.array([len(r[3]) for r in members])
    ids, own = np.array([r[1] for r in members]), np.array([r[2] for r in members])
    shingles = np.concatenate([r[3] for r in members])
    order = np.argsort(shingles, kind="stable")
    shingles, holder = shingles[order], np.repeat(np.arange(len(members)), sizes)[order]
    for _, i, component, wanted in queries:
        lo, hi = np.searchsorted(shingles, wanted, "left"), np.searchsorted(shingles, wanted, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        same = np.bincount(holder[at], minlength=len(members))
        good = np.flatnonzero((100 * same >= percent * (sizes + len(wanted) - same)) & (own != component))
        for j in good[np.unique(own[good], return_index=True)[1]]:
            yield i, int(ids[j])


def _tile_tester(percent: int):
    """Over partitions sorted by tile; a tile's rows follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def tested() -> pa.RecordBatch:
            found = list(_tile_links(rows, percent))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        for b in batches:
            columns = [c.to_pylist() for c in b.columns[:6]]
            for *tile, asks, i, own, shingles in zip(*columns, b.column(6), strict=True):
                if tile != key:
                    yield tested()
                    key, rows = tile, []
                rows.append((asks, i, own, np.frombuffer(shingles.as_py(), np.uint64)))
        yield tested()

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Two documents are linked if their sets of distinct ``words``-word shingles (A-Z lower-cased;
    a shorter text is one shingle) have 100 * intersection >= percent * union.  component_id is
    the smallest id reachable over links; kept says that it is the row's own id.  Ids keep their
    type, which needs an order.  Null, empty or
    blank text: no shingles, linked with nothing.  Rows with one id are one document: they get
    one component and are kept together.  A null id keeps its row, has a null component and
    links nothing.  Other columns of docs, whatever their names, are ignored.
    """
    text, kind = F.col(text_col).cast("string"), dict(docs.dtypes)[id_col]
    docs = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    sketch = written(docs.mapInArrow(_sketcher(words, bands, rows), f"doc_id {kind}, text_hash long, n_shingles long, h1 long, h2 long, bands array<long>"), "sketch")
    named = sketch.where("doc_id IS NOT NULL AND n_shingles > 0")
    same = ["h1", "h2", "n_shingles"]
    # A class has a number of its own: an id may have several texts, and so be the smallest of several classes.
    classes = written(named.groupBy(*same).agg(F.min("doc_id").alias("least_id")).withColumn("class", F.monotonically_increasing_id()), "classes")
    reps = classes.join(named.withColumnRenamed("doc_id", "least_id"), ["least_id", *same]).dropDuplicates(["least_id", *same])
    reps = written(reps.select("class", "least_id", "text_hash", "n_shingles", "bands"), "reps")
    members = reps.select("class", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "key"))
    buckets = members.groupBy("band", "key").agg(F.min("class").alias("first"), F.max("class").alias("last"), (F.count("*") > 2).alias("several")).where("first < last").drop("last")
    buckets = written(buckets, "buckets")  # a side of its own: Spark can then split a crowded bucket's rows
    crowd = members.join(buckets, ["band", "key"]).groupBy("first", "class", "n").agg(F.max("several").alias("several"))
    crowd = written(crowd, "crowd")  # each class once for each centre that it meets
    sizes = reps.select(F.col("class").alias("first"), F.col("n_shingles").alias("n_first"))
    stars = crowd.where("class > first").join(sizes, "first").where(f"100 * least(n, n_first) >= {percent} * greatest(n, n_first)").select(F.col("first").alias("a"), F.col("class").alias("b"))
    stars = written(stars, "stars")
    wanted = reps.select("class", F.col("least_id").alias("doc_id"), "text_hash").join(crowd.select("class").distinct(), "class")
    sets = written(docs.join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("class", "text").mapInArrow(_set_maker(words), "id long, shingles binary"), "sets")
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    links = written(stars.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_confirmer(percent), "a long, b long"), "links")
    found = connected_components(links.select(F.lit(0).alias("graph"), "a", "b"))
    # Around a centre with members of several components, what lies outside the largest is tested against all there.
    around = crowd.where("several").select("first", F.col("class").alias("id"))
    placed = written(around.join(found.select(F.col("node").alias("id"), F.col("component").alias("own")), "id", "left").withColumn("own", F.coalesce("own", "id")), "placed")
    shares = placed.groupBy("first", "own").agg(F.count("*").alias("n"))
    mixed = shares.groupBy("first").agg(F.sum("n").alias("n_all"), F.max("n").alias("n_main"), F.max_by("own", "n").alias("main")).where("n_all > n_main AND n_all > 2")
    mixed = mixed.select("first", "main", F.ceil(F.col("n_all") / TILE).alias("m_tiles"), F.ceil((F.col("n_all") - F.col("n_main")) / TILE).alias("q_tiles"))
    apart = written(placed.join(written(mixed, "mixed"), "first"), "apart")
    spot = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    as_members = apart.select("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_tiles") - 1)).alias("q"), (spot % F.col("m_tiles")).alias("m"), F.lit(False).alias("asks"), "id", "own")
    as_queries = apart.where("own <> main").select("first", (spot % F.col("q_tiles")).alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("m_tiles") - 1)).alias("m"), F.lit(True).alias("asks"), "id", "own")
    tiles = as_members.unionByName(as_queries).join(sets, "id").select("first", "q", "m", "asks", "id", "own", "shingles")
    more = written(tiles.repartition("first", "q", "m").sortWithinPartitions("first", "q", "m").mapInArrow(_tile_tester(percent), "a long, b long").distinct(), "more")
    discard(buckets, crowd, stars, sets, placed, apart)
    if not more.isEmpty():
        found = connected_components(links.unionByName(more).select(F.lit(0).alias("graph"), "a", "b"))
    # Rows with one id but different texts are one document: their classes are linked by it.
    twice = sketch.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("doc_id")
    twice = written(twice, "twice")
    several = not twice.isEmpty()
    if several:
        own = written(named.select("doc_id", *same).join(twice, "doc_id").join(classes, same).select("doc_id", "class").distinct(), "own")
        one = written(own.groupBy("doc_id").agg(F.min("class").alias("class")), "one")
        tied = own.join(one.withColumnRenamed("class", "a"), "doc_id").select("a", F.col("class").alias("b"))
        found = connected_components(links.unionByName(more).unionByName(tied).select(F.lit(0).alias("graph"), "a", "b"))
    # Components are numbered by classes so far; each takes the smallest id of its classes.
    placed = found.withColumnRenamed("node", "class").join(classes.select("class", "least_id"), "class")
    lowest = written(placed.groupBy("component").agg(F.min("least_id").alias("component_id")), "lowest")  # a side of its own, as above
    lowest = written(found.join(lowest, "component").select(F.col("node").alias("class"), "component_id"), "components")
    whole = written(classes.join(lowest, "class", "left").select(*same, "class", F.coalesce("component_id", "least_id").alias("class_id")), "whole")
    discard(reps, classes, links, more)
    out = sketch.select("doc_id", "n_shingles", "h1", "h2").join(whole.drop("class"), same, "left")
    if several:
        # A row without shingles goes with its id's other texts.
        bare = F.col("doc_id").isNotNull() & (F.col("n_shingles") == 0)
        by_id = one.join(whole.select("class", "class_id"), "class").select("doc_id", "class_id")
        out = out.where(~bare).unionByName(out.where(bare).drop("class_id").join(by_id, "doc_id", "left"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns, whatever their names."""
    gone = near_duplicates(docs, id_col, **how).where("NOT kept").select(F.col("doc_id").alias("id")).distinct()
    return docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id")).join(gone, "id", "left_anti").select("row.*")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


OP2_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS shingles FROM w),
e AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n_both >= 80 * (len(x.shingles) + len(y.shingles) - n_both)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  WITH RECURSIVE r(node, seen) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.node, sides.b FROM r JOIN sides ON sides.a = r.seen)
  SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN reach ON node = doc_id
"""
