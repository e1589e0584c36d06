"""Remove repeated passages, found by backward search in compressed FM-indexes.

A window is ``length`` consecutive words.  Every window has one anchor, its smallest hashed
``gram``-word run (the leftmost of equal ones), so equal windows have equal anchors.  The windows
of a document that share an anchor position form a segment.

1. Segments are read off every whole text; anchors that occur in one document alone are dropped,
   and equal segments collapse to one, known by the smallest and the largest document that hold it.
2. The distinct segments are dealt by anchor to shards.  A shard's segments are laid end to end and
   indexed: suffix array, Burrows-Wheeler transform, and a wavelet matrix of packed bits for its
   ranks.  Each segment is streamed backward through the index, once on behalf of its smallest
   document and, if it has others, once on behalf of these; its matching statistics, the longest
   match in a smaller document that ends at a word, tell the windows to remove.  A suffix range
   counts only while it holds a smaller document.
3. An anchor with very many distinct segments is cut into tiles of references and queries, so that
   a shard is bounded; nothing is left out.

Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .shared import discard, table, written
from .words import Words, split

LENGTH, GRAM = 50, 16
#: What a segment is in a shard.
REFERENCE, ASKS, ASKS_FOR_OTHERS = 1, 2, 4
#: Segments in a shard, about; and of one anchor in a shard, at most.
SHARD, CROWD = 1024, 8192


def segments(w: Words, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, row, first word and number of windows of each segment of a slice."""
    n = len(w.hash)
    none = np.empty(0, np.int64)
    if n < length:
        return none.view(np.uint64), none, none, none
    _, g = w.grams(gram, np.arange(n - gram + 1))  # runs across texts lie in no window
    at = np.flatnonzero(w.doc[: n - length + 1] == w.doc[length - 1 :])
    if not len(at):
        return none.view(np.uint64), none, none, none
    # Leftmost smallest hash in each stretch of `width` runs, by doubling.
    width = length - gram + 1
    low, span = np.arange(len(g)), 1
    while span * 2 <= width:
        a, b = low[: len(low) - span], low[span:]
        low = np.where(g[b] < g[a], b, a)
        span *= 2
    a, b = low[at], low[at + width - span]
    anchor = np.where(g[b] < g[a], b, a)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(at) != 1) | (w.doc[at[1:]] != w.doc[at[:-1]])])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(at)]]))
    return g[anchor[first]], w.doc[at[first]], at[first], count


def _named(w: Words, start: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    return w.spans(start, start + count + length - 1)


def _segmenter(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for w in split(b.column(2), lower=False):
                anchor, row, start, count = segments(w, length, gram)
                name = _named(w, start, count, length)
                # A segment that a text repeats is one row with all its places.
                order = np.lexsort((start, name, row))
                new = np.concatenate([[True], (name[order][1:] != name[order][:-1]) | (row[order][1:] != row[order][:-1])])[: len(order)]
                first = order[new]
                bounds = np.append(np.flatnonzero(new), len(order)).astype(np.int32)
                starts = pa.ListArray.from_arrays(pa.array(bounds), pa.array((start - w.offset[row])[order].astype(np.int32)))
                rows = pa.array(row[first] + at)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), pa.array(anchor[first].view(np.int64)), pa.array(name[first].view(np.int64)), starts, pa.array(count[first].astype(np.int32))],
                    names=["doc", "t", "anchor", "segment", "starts", "n"],
                )
                at += w.n_docs

    return run


def _extractor(length: int, gram: int):
    """doc, text and the segments wanted of it -> the word hashes of these, with what was told of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, ids = 0, b.column(0)
            told = b.column(2).flatten()
            wanted, parts, asks, last = (told.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            bounds = b.column(2).offsets.to_numpy() - b.column(2).offsets[0].as_py()
            for w in split(b.column(1), lower=False):
                anchor, row, start, count = segments(w, length, gram)
                name = _named(w, start, count, length).view(np.int64)
                lo, hi = bounds[at], bounds[at + w.n_docs]
                owner = np.repeat(np.arange(w.n_docs), np.diff(bounds[at : at + w.n_docs + 1]))
                # Match (row, segment), each once.
                by = np.lexsort((name, row))
                by = by[np.concatenate([[True], (name[by][1:] != name[by][:-1]) | (row[by][1:] != row[by][:-1])])] if len(by) else by
                both = np.concatenate([owner, row[by]])
                names = np.concatenate([wanted[lo:hi], name[by]])
                order = np.lexsort((np.arange(len(both)) >= hi - lo, names, both))
                pair = np.flatnonzero((both[order][1:] == both[order][:-1]) & (names[order][1:] == names[order][:-1]))
                ask, keep = order[pair] + lo, by[order[pair + 1] - (hi - lo)] if len(pair) else np.empty(0, np.int64)
                size = count[keep] + length - 1
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
                words = w.hash[np.repeat(start[keep] - ends[:-1], size) + np.arange(ends[-1])]
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(keep), [None, pa.py_buffer(ends * 8), pa.py_buffer(words.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row[keep] + at)), pa.array(anchor[keep].view(np.int64)), pa.array(name[keep]), pa.array(count[keep].astype(np.int32)), packed, pa.array(parts[ask]), pa.array(asks[ask]), pa.array(last[ask])],
                    names=["doc", "anchor", "segment", "n", "words", "parts", "asks", "last_holder"],
                )
                at += w.n_docs

    return run


class WaveletMatrix:
    """Ranks over a sequence of small numbers, one packed bit array per binary digit."""

    def __init__(self, values: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        n = len(values)
        self.words, self.counts, self.zeros = [], [], []
        v = values
        for level in range(self.bits - 1, -1, -1):
            bit = ((v >> level) & 1).astype(bool)
            padded = np.zeros(-(-(n + 1) // 64) * 64, dtype=bool)
            padded[:n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1].astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            v = np.concatenate([v[~bit], v[bit]])
        self.start = self._starts(v, size)

    @staticmethod
    def _starts(v: np.ndarray, size: int) -> np.ndarray:
        """Where each number's run begins in the last order (runs are whole, not sorted)."""
        out = np.zeros(size, np.int64)
        edge = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        out[v[edge]] = edge
        return out

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each c occurs before position i."""
        i = i.astype(np.int64)
        for k in range(self.bits):
            block = i >> 6
            ones = self.counts[k][block] + np.bitwise_count(self.words[k][block] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            bit = ((c >> (self.bits - 1 - k)) & 1).astype(bool)
            i = np.where(bit, self.zeros[k] + ones, i - ones)
        return i - self.start[c]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; the text's suffixes must differ, as separators of their own make them."""
    n = len(text)
    rank, k = text.astype(np.int64), 1
    while True:
        key = rank * (n + 2)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank, k = new, 2 * k
        if rank[order[-1]] == n - 1 or k >= n:
            return order


class FMIndex:
    """Word sequences of documents, for backward search that keeps to smaller documents."""

    def __init__(self, sequences: np.ndarray, sizes: np.ndarray, docs: np.ndarray):
        """sequences: word hashes laid end to end; docs: the document of each sequence."""
        self.vocabulary, ids = np.unique(sequences, return_inverse=True)
        m = len(sizes)
        ends = np.cumsum(sizes)
        text = np.empty(len(sequences) + m, np.int64)
        marks = ends + np.arange(m)
        is_mark = np.zeros(len(text), dtype=bool)
        is_mark[marks] = True
        text[marks], text[~is_mark] = np.arange(m), ids + m
        order = suffix_array(text)
        self.marks, n = m, len(text)
        transform = text[order - 1]
        size = m + len(self.vocabulary)
        # Separators are never searched for: they share the number 0 in the wavelet matrix.
        self.wavelet = WaveletMatrix(np.maximum(transform - m + 1, 0), len(self.vocabulary) + 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])[m:-1]
        own = np.repeat(docs, sizes + 1)[order]
        self.least = [own]
        k = 1
        while 2 * k <= n:
            a = self.least[-1]
            self.least.append(np.minimum(a[:-k], a[k:]))
            k *= 2
        self.n = n

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 if unknown."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), max(0, len(self.vocabulary) - 1))
        return np.where(self.vocabulary[at] == hashes, at, -1) if len(self.vocabulary) else np.full(len(hashes), -1)

    def smallest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Smallest document in each suffix range (not empty)."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.least[k][lo[at]], self.least[k][hi[at] - (1 << k)])
        return out

    def match_starts(self, text: np.ndarray, base: np.ndarray, end: np.ndarray, below: np.ndarray) -> np.ndarray:
        """For each query: the least s such that the words text[base + s : base + end] occur in a document smaller than below."""
        s = end.copy()
        live = np.arange(len(end))
        lo, hi = np.zeros(len(end), np.int64), np.full(len(end), self.n, np.int64)
        while len(live):
            c = text[base[live] + s[live] - 1]
            known = c >= 0
            live, c = live[known], c[known]
            a = self.first[c] + self.wavelet.rank(c + 1, lo[live])
            b = self.first[c] + self.wavelet.rank(c + 1, hi[live])
            some = b > a
            live, a, b = live[some], a[some], b[some]
            good = self.smallest(a, b) < below[live]
            live, a, b = live[good], a[good], b[good]
            lo[live], hi[live] = a, b
            s[live] -= 1
            live = live[s[live] > 0]
        return s


def repeated_windows(index: FMIndex, text: np.ndarray, base: np.ndarray, n: np.ndarray, below: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (query, first window, last window) of the windows that occur in a document smaller than the query's.

    Query i has n[i] windows over the words from base[i] on.  Where a match starts never moves left
    as its end moves right, so the ends between two that start alike are known, and stretches of
    ends without a possible window are left out; the others are halved.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    q = np.arange(len(n))
    high = n - 1  # windows are named by their first word; window x ends at x + length
    s_high = index.match_starts(text, base, high + length, below)
    whole = s_high <= 0
    out.append((q[whole], np.zeros(whole.sum(), np.int64), high[whole]))
    q, high, s_high = q[~whole], high[~whole], s_high[~whole]
    low = np.zeros(len(q), np.int64)
    s_low = index.match_starts(text, base[q], low + length, below[q])
    hit = s_low <= low
    out.append((q[hit], low[hit], low[hit]))
    while len(q):
        # Windows above low, up to high; s rises from s_low to s_high.
        same = s_low == s_high
        first = np.maximum(s_high[same], low[same] + 1)
        run = first <= high[same]
        out.append((q[same][run], first[run], high[same][run]))
        left = ~same & (s_low <= high)
        q, low, high, s_low, s_high = q[left], low[left], high[left], s_low[left], s_high[left]
        near = high - low <= 1
        hit = near & (s_high <= high)
        out.append((q[hit], high[hit], high[hit]))
        q, low, high, s_low, s_high = q[~near], low[~near], high[~near], s_low[~near], s_high[~near]
        if not len(q):
            break
        middle = (low + high) // 2
        s = index.match_starts(text, base[q], middle + length, below[q])
        q, low, high, s_low, s_high = np.concatenate([q, q]), np.concatenate([low, middle]), np.concatenate([middle, high]), np.concatenate([s_low, s]), np.concatenate([s, s_high])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _searcher(length: int):
    """Over partitions sorted by shard: a shard's rows are indexed and searched together."""

    def searched(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        role, doc, anchor, name, n, last_holder = (t.column(c).to_numpy() for c in ("role", "doc", "anchor", "segment", "n", "last_holder"))
        sizes = n.astype(np.int64) + length - 1
        hashes = np.frombuffer(b"".join(t.column("words").to_pylist()), np.uint64)
        starts = np.cumsum(sizes) - sizes
        pick = lambda at: hashes[np.repeat(starts[at] - (np.cumsum(sizes[at]) - sizes[at]), sizes[at]) + np.arange(sizes[at].sum())]
        refs = np.flatnonzero(role & REFERENCE)
        own, others = np.flatnonzero(role & ASKS), np.flatnonzero(role & ASKS_FOR_OTHERS)
        asks, below = np.concatenate([own, others]), np.concatenate([doc[own], last_holder[others]])
        empty = np.empty(0, np.int64)
        q = first = last = empty
        if len(refs) and len(asks):
            index = FMIndex(pick(refs), sizes[refs], doc[refs])
            text = index.words(pick(asks))
            q, first, last = repeated_windows(index, text, np.cumsum(sizes[asks]) - sizes[asks], n[asks].astype(np.int64), below, length)
        at = asks[q]
        return pa.RecordBatch.from_arrays([pa.array(anchor[at]), pa.array(name[at]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(q >= len(own))], names=["anchor", "segment", "first", "last", "for_others"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            edges = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))
            for lo, hi in zip(edges, [*edges[1:], b.num_rows], strict=True):
                here = tuple(c[lo] for c in columns)
                if here != key and held:
                    yield searched(held)
                    held = []
                key = here
                held.append(b.slice(lo, hi - lo))
        if held:
            yield searched(held)

    return run


def _covered(n_words: int, spans: list[tuple[int, int]]) -> np.ndarray:
    change = np.zeros(n_words + 1, np.int64)
    for lo, hi in spans:
        change[lo] += 1
        change[hi] -= 1
    return np.cumsum(change[:-1]) > 0


def _remover(with_text: bool):
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for w in split(b.column(1), lower=False):
                n_words, out = np.diff(w.offset), []
                raw = w.raw.tobytes()
                spans = zip(b.column(2).slice(at, w.n_docs).to_pylist(), b.column(3).slice(at, w.n_docs).to_pylist(), strict=True)
                for i, (lo, hi) in enumerate(spans):
                    gone = _covered(int(n_words[i]), list(zip(lo, hi, strict=True))) if lo else np.zeros(n_words[i], dtype=bool)
                    keep = np.flatnonzero(~gone) + w.offset[i]
                    kept = b" ".join([raw[s:e] for s, e in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True)])
                    out.append((int(n_words[i]), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, w.n_docs), *columns], names=["row", "n_words", "n_removed", "kept_sha256", "kept_text"])
                at += w.n_docs

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, t, lo, hi): the words lo[i] .. hi[i] - 1 of a text are to be removed; t is a hash of the text.  Spans may overlap."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    # Read off twice rather than kept: the segments of all texts take more room than the texts.
    found = rows.select("doc", F.hash("text").alias("t"), "text").mapInArrow(_segmenter(length, gram), "doc long, t int, anchor long, segment long, starts array<int>, n int")
    shared = found.groupBy("anchor").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc")).where("first_doc < last_doc").select("anchor", "first_doc")
    shared = written(shared, "shared")  # a side of its own: Spark can then split a hot anchor's rows in the join
    met = written(found.join(shared, "anchor"), "met")
    # Distinct segments, and the smallest and the largest document of each.
    distinct = met.groupBy("anchor", "segment").agg(F.min("doc").alias("doc"), F.max("doc").alias("last_holder"), F.min("first_doc").alias("first_doc"))
    distinct = written(distinct, "distinct")
    crowds = distinct.groupBy("anchor").agg(F.ceil(F.count("*") / CROWD).alias("parts"))
    cut = written(distinct.join(written(crowds, "crowds"), "anchor"), "cut")
    n_shards = max(1, -(-cut.count() // SHARD))
    asks = F.col("doc") > F.col("first_doc")  # the anchor's first document has nothing before it
    wanted = cut.groupBy("doc").agg(F.collect_list(F.struct("segment", "parts", asks.alias("asks"), "last_holder")).alias("wanted"))  # at most a text's segments
    taken = rows.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(_extractor(length, gram), "doc long, anchor long, segment long, n int, words binary, parts long, asks boolean, last_holder long")

    def tile(shard, i, j, role) -> Column:
        return F.struct(shard.alias("shard"), i.alias("i"), j.alias("j"), role.alias("role"))

    none = F.lit(0).cast("long")
    part = F.pmod(F.xxhash64("segment"), F.col("parts"))
    own, others = F.when(F.col("asks"), ASKS).otherwise(0), F.when(F.col("last_holder") > F.col("doc"), ASKS_FOR_OTHERS).otherwise(0)
    one = F.array(tile(F.pmod(F.xxhash64("anchor"), F.lit(n_shards)).cast("long"), none, none, F.lit(REFERENCE) + own + others))
    refs = F.transform(F.sequence(none, F.col("parts") - 1), lambda k: tile(F.col("anchor"), k, part + 1, F.lit(REFERENCE)))
    # For others it asks where its own reference is.
    queries = F.transform(F.sequence(none, F.col("parts") - 1), lambda k: tile(F.col("anchor"), part, k + 1, own + F.when(k == part, others).otherwise(0)))
    tiles = F.when(F.col("parts") == 1, one).otherwise(F.concat(refs, F.filter(queries, lambda x: x["role"] > 0)))
    dealt = taken.withColumn("tile", F.explode(tiles)).select("tile.shard", "tile.i", "tile.j", "tile.role", "doc", "anchor", "segment", "n", "words", "last_holder")
    shards = dealt.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j")
    runs = written(shards.mapInArrow(_searcher(length), "anchor long, segment long, first int, last int, for_others boolean"), "runs")
    runs = runs.join(cut.select("anchor", "segment", F.col("doc").alias("first_holder")), ["anchor", "segment"])
    runs = written(runs, "runs_by_segment")  # a side of its own, as above
    discard(shared, distinct)
    holders = met.join(runs, ["anchor", "segment"]).where(F.when(F.col("for_others"), F.col("doc") > F.col("first_holder")).otherwise(F.col("doc") == F.col("first_holder")))
    ends = lambda more: F.transform("starts", lambda x: x + more).cast("array<int>")
    return holders.select("doc", "t", ends(F.col("first")).alias("lo"), ends(F.col("last") + length).alias("hi"))


def _removed(docs: DataFrame, with_text: bool, id_col: str, text_col: str, length: int, gram: int) -> DataFrame:
    spans = repeated_spans(docs, id_col, text_col, length, gram)
    spans = written(spans.groupBy("doc", "t").agg(F.flatten(F.collect_list("lo")).alias("lo"), F.flatten(F.collect_list("hi")).alias("hi")), "spans")  # at most a text's segments
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.hash(text).alias("t"), text.alias("text"), F.struct("*").alias("row")).join(spans, ["doc", "t"], "left")
    fields = [("row", docs.schema), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()), ("kept_text", T.StringType())]
    return rows.select("row", "text", "lo", "hi").mapInArrow(_remover(with_text), T.StructType([T.StructField(*f) for f in fields]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, kept_text.

    A word is removed if a window that covers it also starts in a document with a smaller id; what
    is kept is joined by single spaces.  A null text has no words.  A row with a null id loses
    nothing and takes nothing from others.  Rows of one id take nothing from each other; ids must be
    whole numbers.  Texts
    shorter than a window are kept whole.  Other columns are ignored.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _removed(named, True, "doc_id", "text", length, gram).select("row.doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")


def keep_first_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with repeats cut out of their texts.

    Texts that lose nothing stay as they are; texts that lose all their words are dropped.
    """
    done = _removed(docs, True, id_col, text_col, length, gram).where("n_removed < n_words OR n_words = 0")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(f"row.{text_col}"))
    return done.select(*[text.alias(c) if c == text_col else F.col(f"row.{c}").alias(c) for c in docs.columns])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _removed(docs, False, "doc_id", "text", LENGTH, GRAM).select("row.doc_id", "n_words", "n_removed", "kept_sha256")


OP4_SQL = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS pos FROM w WHERE len(words) >= 50),
h AS (SELECT doc_id, pos, md5(array_to_string(words[pos:pos + 49], ' ')) AS window_key FROM p),
f AS (SELECT window_key, min(doc_id) AS first_doc FROM h GROUP BY window_key),
g AS (SELECT h.doc_id, list(pos) AS starts FROM h JOIN f USING (window_key) WHERE f.first_doc < h.doc_id GROUP BY h.doc_id),
c AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda s: range(s, s + 50)))) AS gone FROM g),
k AS (SELECT w.doc_id, words, gone, list_filter(words, lambda x, i: NOT coalesce(list_contains(gone, i), false)) AS kept FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
