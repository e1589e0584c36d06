"""Align the tokens of two tokenizers on the bytes of each text.

Both tokenizers' tokens are intervals of the same bytes, given by their ascending ends.  The ends
that both lists hold cut a text into groups: the shorter list looks its ends up in the longer by
galloping (steps that double, then a binary search in the last step), for all texts of a slice
together and in rounds of halved strides, so that each look-up starts at its left neighbour's place.
The ranks found tell which ends are common, and their differences which tokens overlap.

Id pairs are counted slice by slice and then by Spark; a slice gets back the counts of its own distinct
pairs, so what is shuffled is distinct pairs, not links, and no pair can be hot.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .pieces import _spread
from .shared import discard, table, working_tables, written

BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The pre-tokenizer's pattern of byte-level models of this kind (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SLICE = 1 << 20  # characters of texts that are aligned at once
_LINKS = 1 << 20  # links in one row of the slices' table
_PLAIN = 1 << 18  # longer texts go to the model file's own tokenizer, whose stack does not grow with them


class ByteTokens:
    """The byte-level model: ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        vocabulary = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if all(c in letters for c in token)}
        specials = {t["id"] for t in model["added_tokens"] if t["special"]}
        self.bytes = dict(zip(vocabulary.values(), vocabulary.keys(), strict=True))
        ranks = {b: i for b, i in vocabulary.items() if i not in specials}
        self.quick = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def slow(self):
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(self.path)
        slow.encode_special_tokens = True
        return slow

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.quick.encode_ordinary(t) if len(t) <= _PLAIN else self.slow.encode_batch_fast([t], add_special_tokens=False)[0].ids for t in texts]


class PieceTokens:
    """The SentencePiece model, likewise; it puts the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())]
        self.bytes = {i: bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Vocabulary:
    """Bytes of the ids, one after the other."""

    def __init__(self, tokens: dict[int, bytes]):
        n = max(tokens, default=-1) + 1
        self.size = np.array([len(tokens.get(i, b"")) for i in range(n)], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(n)), np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        return self.raw[_spread(self.at[ids], self.size[ids])]


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each number of short its place in long: how many of long are smaller.  Both ascend strictly.

    Stride by stride, halved each time: a number starts where its left neighbour of the coarser stride
    has ended, doubles its steps while it meets smaller numbers, and halves the last step.
    """
    n, m = len(short), len(long)
    place = np.zeros(n, np.int64)
    if not n or not m:
        return place
    stride = 1 << (n - 1).bit_length()
    while stride:
        who = np.arange(0, n, stride) if stride >= n else np.arange(stride, n, 2 * stride)
        want = short[who]
        low = place[who - stride] if stride < n else np.zeros(1, np.int64)  # long[low - 1] < want
        high = np.full(len(who), m)
        live, step = np.arange(len(who)), 1
        while len(live):
            probe = low[live] + step - 1
            inside = probe < m
            smaller = np.zeros(len(live), bool)
            smaller[inside] = long[probe[inside]] < want[live[inside]]
            stop = inside & ~smaller
            high[live[stop]] = probe[stop]
            low[live[smaller]] = probe[smaller] + 1
            live, step = live[smaller], step * 2
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) >> 1
            smaller = long[middle] < want[live]
            low[live[smaller]] = middle[smaller] + 1
            high[live[~smaller]] = middle[~smaller]
            live = live[low[live] < high[live]]
        place[who] = low
        stride >>= 1
    return place


def ranks(a: np.ndarray, b: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of b are below each of a, and whether b has it.

    a and b hold the lists of many texts, end to end and ascending throughout; a_first and b_first
    are the texts' bounds.  In each text the shorter list gallops through the longer.
    """
    short = np.diff(a_first) <= np.diff(b_first)
    below = np.empty(len(a), np.int64)
    common = np.zeros(len(a), bool)
    n_a, n_b = np.diff(a_first), np.diff(b_first)
    mine = _spread(a_first[:-1][short], n_a[short])
    theirs = _spread(b_first[:-1][short], n_b[short])
    place = gallop(a[mine], b[theirs])
    hit = np.zeros(len(mine), bool)
    real = place < len(theirs)
    hit[real] = b[theirs[place[real]]] == a[mine[real]]
    # Places count within the chosen texts: add those of the texts between.
    below[mine] = place + np.repeat(b_first[:-1][short] - (np.cumsum(n_b[short]) - n_b[short]), n_a[short])
    common[mine] = hit
    mine = _spread(a_first[:-1][~short], n_a[~short])
    theirs = _spread(b_first[:-1][~short], n_b[~short])
    place = gallop(b[theirs], a[mine])
    real = place < len(mine)
    hit = np.zeros(len(theirs), bool)
    hit[real] = a[mine[place[real]]] == b[theirs[real]]
    # The ends of b fall before, or on, the ends of a: their running number is a's rank.
    met = np.bincount(place, minlength=len(mine) + 1)[: len(mine)]
    same = np.zeros(len(mine), bool)
    same[place[hit]] = True
    below[mine] = np.cumsum(met) - same + np.repeat(b_first[:-1][~short] - (np.cumsum(n_b[~short]) - n_b[~short]), n_a[~short])
    common[mine] = same
    return below, common


def _digits(ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The decimal ids, each followed by its sign, as bytes, and how many bytes each takes."""
    width = max(1, len(str(int(ids.max(initial=0)))))
    out = np.empty((len(ids), width + 1), np.uint8)
    out[:, width] = after
    rest = ids.copy()
    for k in range(width - 1, -1, -1):
        out[:, k] = 48 + rest % 10
        rest //= 10
    size = np.ones(len(ids), np.int64)
    for k in range(1, width):
        size += ids >= 10**k
    keep = np.arange(width + 1) >= (width - size)[:, None]
    return out[keep], size + 1


class Slice:
    """The alignment of some texts (bytes, each with the space before it; empty: no text)."""

    def __init__(self, texts: list[bytes], a_ids: list[list[int]], b_ids: list[list[int]], a_words: Vocabulary, b_words: Vocabulary):
        self.texts = len(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        good = sizes > 0
        sides = []
        for ids, words in ((a_ids, a_words), (b_ids, b_words)):
            count = np.array([len(x) for x in ids], np.int64)
            flat = np.fromiter((i for x in ids for i in x), np.int64, int(count.sum()))
            size = words.size[flat]
            first = np.cumsum(count) - count
            total = np.concatenate([[0], np.cumsum(size)])
            begin, end = total[first], total[first + count]
            good &= end - begin == sizes
            good &= np.bincount(np.repeat(np.arange(len(texts)), count)[size == 0], minlength=len(texts)) == 0
            sides.append([flat, count, words.join(flat), begin, end])
        raw = np.frombuffer(b"".join(texts), np.uint8)
        at = np.cumsum(sizes) - sizes
        for _, _, joined, begin, _ in sides:
            some = np.flatnonzero(good)
            differ = raw[_spread(at[some], sizes[some])] != joined[_spread(begin[some], sizes[some])]
            bounds = np.concatenate([[0], np.cumsum(sizes[some])])
            wrong = np.concatenate([[0], np.cumsum(differ)])
            good[some[wrong[bounds[1:]] > wrong[bounds[:-1]]]] = False
        (self.a, self.n_a), (self.b, self.n_b) = ((flat[np.repeat(good, count)], np.where(good, count, 0)) for flat, count, *_ in sides)
        self.a_first, self.b_first = (np.concatenate([[0], np.cumsum(n)]) for n in (self.n_a, self.n_b))
        # Ends throughout the slice: the texts' bytes follow each other.
        a_end, b_end = np.cumsum(a_words.size[self.a]), np.cumsum(b_words.size[self.b])
        self.below, self.common = ranks(a_end, b_end, self.a_first, self.b_first)
        # A token's first overlapping token comes after the ends that are not beyond its start.
        self.start = np.concatenate([[0], (self.below + self.common)[:-1]])[: len(self.a)]
        self.n_each = self.below - self.start + 1
        self.n_groups = self._sums(self.common.astype(np.int64))
        self.n_links = self._sums(self.n_each)

    def _sums(self, of_a: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of_a)])
        return total[self.a_first[1:]] - total[self.a_first[:-1]]

    def links(self) -> np.ndarray:
        """The id pairs a * 2**32 + b of all links, in the order of the texts."""
        return (np.repeat(self.a, self.n_each) << 32) | self.b[_spread(self.start, self.n_each)]

    def digests(self) -> list[str]:
        """Of each text's groups; "" without tokens."""
        group_a = np.cumsum(self.common) - self.common
        last_b = np.zeros(len(self.b), bool)
        last_b[self.below[self.common]] = True
        group_b = np.cumsum(last_b) - last_b
        # Of each group first the a, then the b.
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        ids = np.concatenate([self.a, self.b])[order]
        sign = np.concatenate([np.where(self.common, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))]).astype(np.uint8)[order]
        raw, size = _digits(ids, sign)
        end = np.concatenate([[0], np.cumsum(size)])
        first = self.a_first + self.b_first
        raw = raw.tobytes()
        return [hashlib.sha256(raw[end[i] : end[j] - 1]).hexdigest() if j > i else "" for i, j in zip(first[:-1], first[1:], strict=True)]


def _align(texts: list[str | None], models: tuple) -> Slice:
    a_model, b_model, a_words, b_words = models
    full = [i for i, t in enumerate(texts) if t]
    spaced = [" " + texts[i] for i in full]
    a_ids, b_ids, raw = [[]] * len(texts), [[]] * len(texts), [b""] * len(texts)
    for i, t, x, y in zip(full, spaced, a_model.encode(spaced), b_model.encode([texts[i] for i in full]), strict=True):
        raw[i], a_ids[i], b_ids[i] = t.encode(), x, y
    return Slice(raw, a_ids, b_ids, a_words, b_words)


def _slices(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[tuple[list, Slice]]:
    """Ids and alignment of some texts at a time; the batches' columns are id and text."""
    a_model, b_model = ByteTokens(a_path), PieceTokens(b_path)
    models = (a_model, b_model, Vocabulary(a_model.bytes), Vocabulary(b_model.bytes))
    ids, texts, weight = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if texts and weight + len(t or "") > _SLICE:
                yield ids, _align(texts, models)
                ids, texts, weight = [], [], 0
            ids.append(i)
            texts.append(t)
            weight += len(t or "")
    if texts:
        yield ids, _align(texts, models)


def _arrays(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))


def align_tokens(docs: DataFrame, a_path: str = BYTE_MODEL, b_path: str = PIECE_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a_ids, b_ids, first, last, common: both tokenizers' ids of each text, and how they lie.

    Token i of a overlaps the tokens first[i] .. last[i] of b; where common[i], both lists have a
    token that ends where it ends, and a group of tokens that belong together is closed.  A null or
    empty text, and one whose tokens are not the bytes of a space and the text, has no tokens.  Rows
    stay as they are, whatever their ids; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, s in _slices(batches, a_path, b_path):
            base = np.repeat(s.b_first[:-1], s.n_a)
            columns = [_arrays(x, s.a_first, pa.int32()) for x in (s.a, s.start - base, s.below - base)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), columns[0], _arrays(s.b, s.b_first, pa.int32()), *columns[1:], _arrays(s.common, s.a_first, pa.bool_())], names=["doc_id", "a_ids", "b_ids", "first", "last", "common"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    name = dict(rows.dtypes)["doc_id"]
    kind = to_arrow_type(rows.schema["doc_id"].dataType)
    return rows.mapInArrow(run, f"doc_id {name}, a_ids array<int>, b_ids array<int>, first array<int>, last array<int>, common array<boolean>")


def _pack(numbers: np.ndarray) -> bytes:
    """Small numbers by byte planes, compressed."""
    return pa.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _unpack(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(n)


_FACT = "row: long, doc_id: {}, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string"
_TABLE = "slice long, facts array<struct<{}>>, rows array<long>, bounds array<int>, links binary, pairs array<long>, counts array<long>"


def _tabled(a_path: str, b_path: str, kind: pa.DataType):
    """One row for each slice of texts: facts of the texts, the links as numbers of the slice's distinct id pairs, and these."""
    fact = pa.struct([("row", pa.int64()), ("doc_id", kind), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = number = TaskContext.get().partitionId() << 40
        for ids, s in _slices(batches, a_path, b_path):
            names = np.arange(row, row + len(ids))
            row += len(ids)
            columns = [pa.array(names), pa.array(ids, kind), *[pa.array(x) for x in (s.n_a, s.n_b, s.n_groups, s.n_links)], pa.array(s.digests(), pa.string())]
            facts = pa.StructArray.from_arrays(columns, fields=list(fact))
            links, bounds = s.links(), np.concatenate([[0], np.cumsum(s.n_links)])
            for lo in range(0, max(1, len(links)), _LINKS):  # a very long text's links take several rows
                hi = min(len(links), lo + _LINKS)
                pairs, which, counts = np.unique(links[lo:hi], return_inverse=True, return_counts=True)
                by = np.argsort(-counts, kind="stable")  # frequent pairs get small numbers
                small = np.empty(len(by), np.int64)
                small[by] = np.arange(len(by))
                some = np.flatnonzero((bounds[1:] > lo) & (bounds[:-1] < hi) & (s.n_links > 0))
                cuts = np.append(np.maximum(bounds[some], lo), hi) - lo
                one = lambda x, k: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, k))
                told = facts if lo == 0 else facts[:0]
                values = [
                    pa.array([number]),
                    pa.ListArray.from_arrays(pa.array([0, len(told)], pa.int32()), told),
                    one(names[some], pa.int64()),
                    one(cuts, pa.int32()),
                    pa.array([_pack(small[which.reshape(-1)])], pa.binary()),
                    one(pairs[by], pa.int64()),
                    one(counts[by], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(values, names=["slice", "facts", "rows", "bounds", "links", "pairs", "counts"])
                number += 1

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, n_best, count_sum of a slice's texts: pos and code give the counts of its pairs, twice, plus one where it is the best."""
    for b in batches:
        for i in range(b.num_rows):
            rows, bounds, pos, code = (b.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (0, 1, 3, 4))
            links = _unpack(b.column(2)[i].as_py(), int(bounds[-1]))
            codes = np.empty(len(pos), np.int64)
            codes[pos] = code
            of = codes[links]
            best, total = np.concatenate([[0], np.cumsum(of & 1)]), np.concatenate([[0], np.cumsum(of >> 1)])
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(best[bounds[1:]] - best[bounds[:-1]]), pa.array(total[bounds[1:]] - total[bounds[:-1]])], names=["row", "n_best", "count_sum"])


def pair_counts(slices: DataFrame) -> DataFrame:
    """pair (a * 2**32 + b), count, best: how many links hold the pair, and whether no other pair of its b has more."""
    one = slices.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("count"))
    # The pairs of one b are no more than a's vocabulary.
    b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    return one.select("pair", "count", (F.col("count") == F.max("count").over(b)).alias("best"))


def alignment_facts(docs: DataFrame, a_path: str = BYTE_MODEL, b_path: str = PIECE_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of docs.

    n_links are the overlapping tokens of a and b.  A pair of ids counts as often as it is linked
    anywhere in docs; count_sum adds these counts up over a text's links, n_best is how many of its
    links have the highest count of their b.  groups_sha256 is of ``a1,a2|b1;a3|b2,b3``.  Texts
    without tokens (see ``align_tokens``) have zeros and "".  Rows that repeat count each for itself.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    fact = _FACT.format(dict(texts.dtypes)["doc_id"])
    kind = to_arrow_type(texts.schema["doc_id"].dataType)
    with working_tables(spark) as kept:
        slices = written(texts.mapInArrow(_tabled(a_path, b_path, kind), _TABLE.format(fact)), "slices")
        counts = written(pair_counts(slices).select("pair", (F.col("count") * 2 + F.col("best").cast("long")).alias("code")), "pair_counts")
        asked = slices.select("slice", F.posexplode("pairs").alias("pos", "pair"))
        told = asked.join(counts, "pair").groupBy("slice").agg(F.collect_list(F.struct("pos", "code")).alias("told"))  # no more than a slice's distinct pairs
        told = written(told.select("slice", "told.pos", "told.code"), "told")
        discard(counts)
        sums = slices.where(F.size("rows") > 0).select("slice", "rows", "bounds", "links").join(told, "slice").select("rows", "bounds", "links", "pos", "code")
        sums = written(sums.mapInArrow(_totals, "row long, n_best long, count_sum long"), "totals")
        facts = slices.select(F.explode("facts").alias("f")).select("f.*")
        out = facts.join(sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")), "row", "left")
        out = written(out.drop("row").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")}), "alignment")
        kept.append(out)
    return out


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_facts(table(spark, sf_dir, "documents"))
