"""A kept BM25 index: postings in Parquet, by term bucket, with a bound for each block of texts.

Layout of an index folder; every table is written once and never changed:

  commits/version=V     the segments that are live from version V on
  texts/segment=S       a row per block of about ``TEXTS`` texts, fewer if they are long: block, ids (ascending), lens, n, total
  postings/segment=S/bucket=B
                        a row per term and block: term, block, max_tf, min_len, n, ords, tfs
  gone/version=V        segment, block, ords: texts that version V replaced or deleted, with their lengths

A segment's texts lie in blocks with texts of about their length, so that a block's bound (its largest
count at its least length) is near to its best score: a text's score grows with the count and falls with the
length, whatever the mean length is by then.  A commit is the last thing that a change writes; a
change that fails leaves files that no reader sees, and is simply run again.  There is one writer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions.text import tokens
from tidemark.operators.retrieval import K1, B, k_best, ranked
from tidemark.session import checkpointed, dropped, saved

BUCKETS, TEXTS, GROUP = 64, 4096, 256
#: Postings of a block, about: what a task holds at once, however many long texts there are.
POSTINGS = 1 << 20
#: Words that are sorted at once.
WORDS = 1 << 19
#: Blocks with the best bounds, which a query reads first to learn what its k-th score is at least.
FIRST = 2
#: Asked terms that go to the scan as a filter; more of them are joined.
LISTED = 1000
_MARGIN = 2e-6  # scores are rounded to six decimals


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder) else None


_COUNTED = "len int, terms array<long>, tfs array<int>"


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def _per_text(text: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """terms and tfs of texts 0 .. n - 1, sums where a text's term repeats, terms ascending."""
    by = np.lexsort((term, text))
    text, term, tf = text[by], term[by], tf[by]
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (term[1:] != term[:-1])])) if len(text) else np.empty(0, np.int64)
    bounds = np.searchsorted(text[first], np.arange(n + 1))
    return _lists(term[first], bounds, pa.int64()), _lists(np.add.reduceat(tf, first) if len(first) else tf, bounds, pa.int32())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk_id and words' hashes -> chunk_id and _COUNTED."""
    for b in batches:
        ends = np.cumsum(pa.compute.list_value_length(b.column(1)).to_numpy())
        lo = 0
        while lo < b.num_rows:  # some texts at a time: sorting takes several times their words' room
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + WORDS, "right")))
            words = b.column(1).slice(lo, hi - lo)
            size, term = pa.compute.list_value_length(words).to_numpy(), words.flatten().to_numpy()
            terms, tfs = _per_text(np.repeat(np.arange(len(size)), size), term, np.ones(len(term), np.int32), len(size))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(size, pa.int32()), terms, tfs], names=["chunk_id", "len", "terms", "tfs"])
            lo = hi


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The rows of each run of equal first columns, as one batch."""
    held, name = [], None
    for b in batches:
        if not b.num_rows:
            continue
        at = np.stack([b.column(i).to_numpy() for i in range(keys)])
        edges = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            own = tuple(at[:, lo].tolist())
            if held and own != name:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            name = own
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, chunk_id, len, terms, tfs, by block and id -> a row of the block's texts, and one for each of its terms."""
    for b in _grouped(batches, 1):
        n, lens = b.num_rows, b.column("len").to_numpy()
        ord_ = np.repeat(np.arange(n), pa.compute.list_value_length(b.column("terms")).to_numpy())
        term, tf = b.column("terms").flatten().to_numpy(), b.column("tfs").flatten().to_numpy()
        by = np.argsort(term, kind="stable")
        term, tf, ord_ = term[by], tf[by], ord_[by]
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.empty(0, np.int64)
        bounds = np.append(first, len(term))
        m = len(first)
        whole = lambda values, kind: pa.array([None, *values], kind)
        ends = np.concatenate([[0, 0], bounds[1:]]) if m else np.array([0, 0])
        some = lambda column: pa.ListArray.from_arrays(pa.array([0, len(column)] + [len(column)] * m, pa.int32()), column)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(m + 1, b.column("block")[0].as_py())),
                whole(term[first].tolist(), pa.int64()),
                whole(np.maximum.reduceat(tf, first).tolist() if m else [], pa.int32()),
                whole(np.minimum.reduceat(lens[ord_], first).tolist() if m else [], pa.int32()),
                pa.array([n, *np.diff(bounds).tolist()], pa.int64()),
                pa.array([int(lens.sum()), *[0] * m], pa.int64()),
                _lists(ord_, ends, pa.int32()),
                _lists(tf, ends, pa.int32()),
                some(b.column("chunk_id")),
                some(b.column("len")),
            ],
            names=["block", "term", "max_tf", "min_len", "n", "total", "ords", "tfs", "ids", "lens"],
        )


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """segment, block, term, ords, tfs, ids, lens, lost, the block's own row first -> chunk_id and _COUNTED of its live texts."""
    for b in _grouped(batches, 2):
        ids, lens = b.column("ids")[0].values, b.column("lens")[0].values
        lost = b.column("lost")[0].values
        alive = np.ones(len(ids), bool)
        if lost is not None:
            alive[lost.to_numpy()] = False
        size = pa.compute.fill_null(pa.compute.list_value_length(b.column("ords")), 0).to_numpy()
        term = np.repeat(b.column("term").fill_null(0).to_numpy(), size)
        ords, tfs = b.column("ords").flatten().to_numpy(), b.column("tfs").flatten().to_numpy()
        keep = alive[ords]
        number = np.cumsum(alive) - 1
        terms, counts = _per_text(number[ords[keep]], term[keep], tfs[keep], int(alive.sum()))
        at = pa.array(np.flatnonzero(alive))
        yield pa.RecordBatch.from_arrays([ids.take(at), lens.take(at), terms, counts], names=["chunk_id", "len", "terms", "tfs"])


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


class Postings:
    """The index in a folder.

    After a search, known has (query_id, segment, block, bound) of all blocks that hold a term of the
    query, and read those that were scored.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # Versions

    def _version(self) -> tuple[int, list[int]]:
        commits = _read(self.spark, f"{self.folder}/commits")
        last = commits.orderBy(F.desc("version")).select("version", "segments").first() if commits is not None else None
        return (last.version, list(last.segments)) if last else (0, [])

    def _commit(self, version: int, segments: list[int]) -> None:
        rows = self.spark.createDataFrame([(segments,)], "segments array<int>").coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.folder}/commits/version={version}")

    def _texts(self, segments: list[int]) -> DataFrame | None:
        found = _read(self.spark, f"{self.folder}/texts")
        return found.where(F.col("segment").isin(segments)) if found is not None and segments else None

    def _gone(self, version: int, segments: list[int]) -> DataFrame | None:
        """segment, block, ords, n, total of the texts that don't count any more; None if all do."""
        found = _read(self.spark, f"{self.folder}/gone")
        if found is None:
            return None
        found = found.where((F.col("version") <= version) & F.col("segment").isin(segments))
        lists = found.groupBy("segment", "block").agg(F.flatten(F.collect_list("ords")).alias("ords"), F.sum("n").alias("n"), F.sum("total").alias("total"))
        return None if found.isEmpty() else lists  # no more than a block's texts

    # Changes

    def upsert(self, rows: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> int:
        """Index rows, in place of texts that have their ids; gives the version.

        Rows without an id are left out; of rows with one id that with the most words counts, and a null
        text has no words.
        """
        version, segments = self._version()
        hashed = F.transform(tokens(F.col(text_col)), lambda w: F.xxhash64(w))
        # As the one row of an explode the words are made once; a projection would be made again wherever it is used.
        words = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("chunk_id"), F.explode(F.array(hashed)).alias("words"))
        counted = saved(words.mapInArrow(_counted, f"chunk_id {dict(words.dtypes)['chunk_id']}, {_COUNTED}"), "counted")
        twice = saved(counted.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select("chunk_id"), "twice")
        unique = counted
        if not twice.isEmpty():
            one = counted.join(twice, "chunk_id").groupBy("chunk_id").agg(F.max(F.struct("len", "terms", "tfs")).alias("x"))
            unique = counted.join(twice, "chunk_id", "left_anti").unionByName(one.select("chunk_id", "x.*"))
        self._write(version + 1, unique, counted)
        dropped(twice)
        self._bury(version, segments, self._texts([version + 1]).select(F.explode("ids").alias("chunk_id")))
        self._commit(version + 1, [*segments, version + 1])
        return version + 1

    def delete(self, ids: DataFrame, id_col: str = "chunk_id") -> int:
        """Take texts out; ids that the index lacks do no harm."""
        version, segments = self._version()
        self._bury(version, segments, ids.select(F.col(id_col).alias("chunk_id")))
        self._commit(version + 1, segments)
        return version + 1

    def merge(self) -> int:
        """One segment of all live texts, from the postings alone; readers of older versions are not disturbed."""
        version, segments = self._version()
        texts = self._texts(segments)
        if texts is None:
            return version
        posted = self.spark.read.parquet(f"{self.folder}/postings").where(F.col("segment").isin(segments))
        held, kind = self._blocks(texts, self._gone(version, segments)), dict(texts.dtypes)["ids"]
        rows = held.unionByName(posted.select("segment", "block", "term", "ords", "tfs"), allowMissingColumns=True)
        dealt = rows.repartition("segment", "block").sortWithinPartitions("segment", "block", F.col("term").asc_nulls_first())
        back = dealt.select("segment", "block", "term", "ords", "tfs", "ids", "lens", "lost")
        counted = saved(back.mapInArrow(_restored, f"chunk_id {kind[6:-1]}, {_COUNTED}"), "counted")
        self._write(version + 1, counted, counted)
        self._commit(version + 1, [version + 1])
        return version + 1

    def _blocks(self, texts: DataFrame, gone: DataFrame | None) -> DataFrame:
        """segment, block, ids, lens, lost: what belongs to a block itself."""
        held = texts.select("segment", "block", "ids", "lens")
        if gone is None:
            return held.withColumn("lost", F.lit(None).cast("array<int>"))
        return held.join(gone.select("segment", "block", F.col("ords").alias("lost")), ["segment", "block"], "left")

    def _alive(self, texts: DataFrame, version: int, segments: list[int]) -> DataFrame:
        """segment, block, ord, chunk_id, len of the texts that count."""
        rows = texts.select("segment", "block", F.posexplode(F.arrays_zip("ids", "lens")).alias("ord", "x")).select("segment", "block", "ord", F.col("x.ids").alias("chunk_id"), F.col("x.lens").alias("len"))
        gone = self._gone(version, segments)
        return rows if gone is None else rows.join(gone.select("segment", "block", F.explode("ords").alias("ord")), ["segment", "block", "ord"], "left_anti")

    def _bury(self, version: int, segments: list[int], ids: DataFrame) -> None:
        texts = self._texts(segments)
        if texts is None:
            return
        hit = self._alive(texts, version, segments).join(ids.where("chunk_id IS NOT NULL").distinct(), "chunk_id", "left_semi")
        found = hit.groupBy("segment", "block").agg(F.collect_list("ord").alias("ords"), F.count("*").alias("n"), F.sum("len").alias("total"))
        found.write.mode("overwrite").parquet(f"{self.folder}/gone/version={version + 1}")

    def _write(self, segment: int, counted: DataFrame, source: DataFrame) -> None:
        """counted: chunk_id, len, terms (ascending), tfs; a row per text.  Its source, a saved table, is dropped."""
        # Texts of about one length (a class of lengths, 256 at most) are dealt by hash to blocks of about TEXTS, and of POSTINGS at most.
        level = F.floor(F.log2(F.col("len") + 1) * 4).cast("int")
        sizes = counted.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("postings")).collect()
        blocks = {r.level: max(-(-r.n // TEXTS), -(-r.postings // POSTINGS)) for r in sizes}
        number = F.lit(1)
        if blocks:
            number = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(blocks.items()) for x in pair]), level)
        block = level.cast("long") * 2**32 + F.pmod(F.xxhash64("chunk_id"), number)
        kind = dict(counted.dtypes)["chunk_id"]
        # Tasks grow with the blocks: about four blocks each, whatever the session's number of partitions is.
        tasks = -(-sum(blocks.values()) // 4) or 1
        dealt = counted.select(block.alias("block"), "*").repartition(tasks, "block").sortWithinPartitions("block", "chunk_id")
        built = saved(dealt.mapInArrow(_built, f"block long, term long, max_tf int, min_len int, n long, total long, ords array<int>, tfs array<int>, ids array<{kind}>, lens array<int>"), "built")
        dropped(source)
        own = built.where("term IS NULL").select("block", "ids", "lens", "n", "total")
        own.write.mode("overwrite").parquet(f"{self.folder}/texts/segment={segment}")
        posted = built.where("term IS NOT NULL").select("term", "block", "max_tf", "min_len", "n", "ords", "tfs", F.pmod("term", F.lit(BUCKETS)).cast("int").alias("bucket"))
        # A bucket's blocks are dealt to as many files as they need.
        spread = max(1, tasks // 16)
        posted.repartition(spread * BUCKETS // 4, "bucket", F.pmod(F.xxhash64("block"), F.lit(spread))).sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/postings/segment={segment}")
        dropped(built)

    # Search

    def search(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """query_id, chunk_id, score, rank: the k best texts of each query(query_id, query), as ``bm25_top_k`` gives them.

        Only the buckets of the queries' terms are read.  Each block of texts has a bound for each query;
        the blocks with the best bounds are scored first, and then those whose bound reaches the k-th
        score found there: no other can hold one of the k best.
        """
        version, segments = self._version()
        texts = self._texts(segments)
        asked = checkpointed(queries.select("query_id", F.explode(F.array_distinct(_hashed(tokens(F.col("query"))))).alias("term")).distinct())
        terms = asked.select("term").distinct()
        listed = [r.term for r in terms.limit(LISTED + 1).collect()]
        posted = _read(self.spark, f"{self.folder}/postings") if texts is not None else None
        if posted is None or not listed:
            kind = dict(texts.select(F.explode("ids").alias("i")).dtypes)["i"] if texts is not None else "long"
            return queries.select("query_id", F.lit(None).cast(kind).alias("chunk_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank")).limit(0)
        buckets = [r.b for r in terms.select(F.pmod("term", F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()]  # at most BUCKETS
        posted = posted.where(F.col("segment").isin(segments) & F.col("bucket").isin(buckets))
        posted = posted.where(F.col("term").isin(listed)) if len(listed) <= LISTED else posted.join(terms, "term", "left_semi")
        gone = self._gone(version, segments)
        heads = posted.select("segment", "block", "term", "max_tf", "min_len", "n")
        sizes = texts.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
        n_docs, total = sizes.n or 0, sizes.total or 0
        if gone is not None:
            gone = checkpointed(gone)
            less = gone.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
            n_docs, total = n_docs - less.n, total - less.total
            still = posted.select("segment", "block", "term", "max_tf", "min_len", "n", "ords").join(gone.select("segment", "block", F.col("ords").alias("lost")), ["segment", "block"], "left")
            heads = still.select("segment", "block", "term", "max_tf", "min_len", (F.col("n") - F.when(F.col("lost").isNull(), 0).otherwise(F.size(F.array_intersect("ords", "lost")))).alias("n")).where("n > 0")
        heads = checkpointed(heads)
        mean = total / n_docs if total else 1.0
        df = heads.groupBy("term").agg(F.sum("n").alias("df"))
        weights = checkpointed(asked.join(df, "term").select("query_id", "term", F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")))
        part = F.col("max_tf") / (F.col("max_tf") + K1 * (1 - B + B * F.col("min_len") / mean))
        bounds = checkpointed(weights.join(heads, "term").groupBy("query_id", "segment", "block").agg(F.sum(F.col("idf") * part).alias("bound")))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block"))
        first = bounds.withColumn("place", place).where(F.col("place") <= FIRST).select("query_id", "segment", "block")
        near = checkpointed(self._scored(first, weights, posted, texts, gone, mean, k))
        least = ranked(near, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        rest = bounds.join(first, ["query_id", "segment", "block"], "left_anti").join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - _MARGIN))
        self.known, self.read = bounds, first.unionByName(rest.select(*first.columns))
        return ranked(near.unionByName(self._scored(rest.select("query_id", "segment", "block"), weights, posted, texts, gone, mean, k)), k)

    def _scored(self, wanted: DataFrame, weights: DataFrame, posted: DataFrame, texts: DataFrame, gone: DataFrame | None, mean: float, k: int) -> DataFrame:
        """query_id, chunk_id, score: the k best texts of each wanted (query_id, segment, block).

        A block meets at most ``GROUP`` queries at once: groups are numbered by a running count of
        each block's queries, so that neither side of a task grows with the data.
        """
        spot = ["segment", "block", "part"]
        share = F.pmod(F.xxhash64("query_id"), F.greatest(F.lit(1), F.ceil(F.col("asked") / GROUP)))
        asked = wanted.groupBy("segment", "block").agg(F.count("*").alias("asked"))
        dealt = wanted.join(asked, ["segment", "block"]).select("query_id", "segment", "block", share.alias("part"))
        sides = dealt.join(weights, "query_id")
        here = checkpointed(dealt.select(*spot).distinct())
        lists = posted.select("segment", "block", "term", "ords", "tfs").join(here, ["segment", "block"])
        held = self._blocks(texts, gone).join(here, ["segment", "block"])
        # One table for the block's own row, which has its ids, and its terms' rows.
        empty = lambda c, kind: F.lit(None).cast(kind).alias(c)
        kind = dict(held.dtypes)["ids"]
        rows = held.select(*spot, F.lit(True).alias("own"), F.lit(0).cast("long").alias("term"), empty("ords", "array<int>"), empty("tfs", "array<int>"), "ids", "lens", "lost")
        rows = rows.unionByName(lists.select(*spot, F.lit(False).alias("own"), "term", "ords", "tfs", empty("ids", kind), empty("lens", "array<int>"), empty("lost", "array<int>")))

        def score(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({"query_id": asks["query_id"][:0], "chunk_id": [], "score": []})
            block = rows[rows["own"]]
            if not len(block) or not len(asks):
                return none
            ids, lens = np.asarray(block["ids"].iloc[0]), np.asarray(block["lens"].iloc[0], float)
            query, number = np.unique(asks["query_id"].to_numpy(), return_inverse=True)
            by = np.argsort(asks["term"].to_numpy(), kind="stable")
            term, number, idf = asks["term"].to_numpy()[by], number[by], asks["idf"].to_numpy(float)[by]
            sums, norm = np.zeros((len(query), len(ids))), K1 * (1 - B + B * lens / mean)
            lists = rows[~rows["own"]].sort_values("term")
            for t, ords, tfs in zip(lists["term"], lists["ords"], lists["tfs"], strict=True):
                a, z = np.searchsorted(term, [t, t + 1]) if t < 2**63 - 1 else (np.searchsorted(term, t), len(term))
                if a < z:
                    ords, tfs = np.asarray(ords), np.asarray(tfs, float)
                    sums[number[a:z, None], ords] += idf[a:z, None] * (tfs / (tfs + norm[ords]))
            lost = block["lost"].iloc[0]
            if lost is not None and len(lost):
                sums[:, np.asarray(lost)] = 0
            scores = np.round(sums, 6)
            q, d = k_best(np.where(sums > 0, scores, -1.0), k)
            good = sums[q, d] > 0
            q, d = q[good], d[good]
            return pd.DataFrame({"query_id": query[q], "chunk_id": ids[d], "score": scores[q, d]})

        kinds = f"query_id {dict(weights.dtypes)['query_id']}, chunk_id {kind[6:-1]}, score double"
        return rows.groupBy(*spot).cogroup(sides.groupBy(*spot)).applyInPandas(score, kinds)

