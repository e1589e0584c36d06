"""N-best SentencePiece segmentation, and decoding.

A text is segmented so that the sum of its pieces' scores is largest.  No piece holds a space mark
after another character, so the lattice falls apart before every run of spaces; the parts are
units.  Forward Viterbi scores are computed for all distinct units of a slice at once, in numpy.
They are exact heuristics: an A-star search from a unit's end back to its start (``n_best``)
meets complete segmentations in the order of their scores.  The N best of a text differ from its
best only in the N - 1 units whose second best segmentation loses least, so only those are searched.

A byte-pair model's file has ranks for scores, which are no log-probabilities: their sum favours
many frequent scraps over one word.  Ranks are therefore turned into log-probabilities by the
Zipf-Mandelbrot law (``fitting_scores``), which needs no training.  Scores are whole multiples of
2**-20, so that sums are exact and ties are ties.

Spaces become the space mark, with one more before the text; a character without a piece (and a
literal space mark) becomes its UTF-8 byte pieces, at a score below every character's.  Decoding
gives back the text exactly.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import table
from .words import _BASE, _BASE_INV, _powers, mix

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_CHUNK = 200_000  # characters of distinct units whose lattice is held at once
_SLICE = 1 << 20  # characters of texts that are worked on at once
N_BEST = 3
#: The offset of the Zipf-Mandelbrot law.
OFFSET = 50.0
_GRID = float(1 << 20)
_FEW, _SHORT = 16, 64  # longer parts than that, if few, are segmented one by one


def read_model(path: str = MODEL_PATH) -> list[tuple[str, float, str]]:
    """Piece, score and kind (plain, byte or none) of each id of a SentencePiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if sp.is_byte(i) else "none" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "plain"
    return [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]


def fitting_scores(model: list[tuple[str, float, str]]) -> list[tuple[str, float, str]]:
    """The model with log-probabilities for scores, on the grid.

    Whole numbers are ranks, as byte-pair models have them: rank r gets the share 1 / (r + OFFSET)
    of the sum of these.  Other scores are a unigram model's log-probabilities, and stay.
    """
    plain = [s for _, s, k in model if k == "plain"]
    if plain and all(s == round(s) for s in plain):
        total = math.log(sum(1 / (OFFSET - s) for s in plain))
        model = [(p, -math.log(OFFSET - s) - total if k == "plain" else s, k) for p, s, k in model]
    return [(p, round(s * _GRID) / _GRID, k) for p, s, k in model]


class Pieces:
    """The pieces, for single units (n_best) and for many at once (segment)."""

    def __init__(self, model: list[tuple[str, float, str]]):
        model = fitting_scores(model)
        self.plain = {p.replace(MARK, " "): (i, s) for i, (p, s, k) in enumerate(model) if k == "plain" and p != ""}
        if any(" " in p.lstrip(" ") for p in self.plain):
            raise ValueError("a piece spans words")
        self.byte_ids = np.zeros(256, np.int32)
        for i, (p, _, k) in enumerate(model):
            if k == "byte":
                self.byte_ids[int(p[1:-1], 16)] = i
        self.longest = max(map(len, self.plain), default=1)
        self.missing = min((s for p, (_, s) in self.plain.items() if p.strip(" ")), default=0.0) - 10.0
        # Bytes that each id stands for, one after the other.
        out = [bytes([int(p[1:-1], 16)]) if k == "byte" else p.replace(MARK, " ").encode() if k == "plain" else b"" for p, _, k in model]
        self.out_bytes = np.frombuffer(b"".join(out), np.uint8)
        self.out_size = np.array([len(x) for x in out], np.int64)
        self.out_at = np.cumsum(self.out_size) - self.out_size
        # Hash tables by length in characters.
        self.tables = {}
        for length in sorted({len(p) for p in self.plain}):
            items = [(p, *v) for p, v in self.plain.items() if len(p) == length]
            cps = np.frombuffer("".join(p for p, _, _ in items).encode("utf-32-le"), np.uint32).reshape(-1, length)
            h = mix(((cps.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, length)).sum(1, dtype=np.uint64))
            by = np.argsort(h)
            self.tables[length] = (h[by], np.array([i for _, i, _ in items], np.int32)[by], np.array([s for _, _, s in items])[by])
        self.filter = np.zeros(1 << 20, dtype=bool)
        for h, _, _ in self.tables.values():
            self.filter[(h >> np.uint64(44)).astype(np.int64)] = True

    # One unit

    def edges(self, unit: str) -> list[list[tuple[int, int, float]]]:
        """For each end position: (start, id or -1, score) of the pieces that end there."""
        found: list[list[tuple[int, int, float]]] = [[] for _ in range(len(unit) + 1)]
        for end in range(1, len(unit) + 1):
            for start in range(max(0, end - self.longest), end):
                if hit := self.plain.get(unit[start:end]):
                    found[end].append((start, *hit))
            if not any(s == end - 1 for s, _, _ in found[end]):
                found[end].append((end - 1, -1, self.missing))
        return found

    def n_best(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations (score, ids); of equal scores those with the longer last pieces first.

        A path is a chain of (id, start, end, what follows), shared by all paths that end alike.
        """
        edges = self.edges(unit)
        best = [0.0] + [-np.inf] * len(unit)
        for end in range(1, len(unit) + 1):
            best[end] = max(best[s] + score for s, _, score in edges[end])
        heap: list[tuple] = [(-best[len(unit)], 0, len(unit), 0.0, None)]
        done: list[tuple[float, tuple[int, ...]]] = []
        pushed = 0
        while heap and len(done) < n:
            _, _, at, behind, path = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while path:
                    i, start, end, path = path
                    ids += [i] if i >= 0 else [int(self.byte_ids[b]) for b in unit[start:end].encode()]
                done.append((behind, tuple(ids)))
                continue
            for start, i, score in reversed(edges[at]):  # of equal entries the latest is taken first, so none waits beside a finished one
                pushed -= 1
                heapq.heappush(heap, (-(best[start] + score + behind), pushed, start, score + behind, (i, start, at, path)))
        return done

    # Many units

    def _lattice(self, cps: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and id of the piece of each length (row) that starts at each character; left: characters to the unit's end."""
        n = len(cps)
        scores, ids = np.full((self.longest, n), -np.inf), np.full((self.longest, n), -1, np.int32)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((cps.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), dtype=np.uint64)])
        inverse = _powers(_BASE_INV, n)
        for length, (hashes, which, score) in self.tables.items():
            at = np.flatnonzero(left >= length)
            if not len(at):
                continue
            h = mix((sums[at + length] - sums[at]) * inverse[at])
            may = self.filter[(h >> np.uint64(44)).astype(np.int64)]
            at, h = at[may], h[may]
            spot = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[spot] == h
            scores[length - 1, at[hit]], ids[length - 1, at[hit]] = score[spot[hit]], which[spot[hit]]
        none = ids[0] < 0
        scores[0, none] = self.missing
        return scores, ids

    def segment(self, cps: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best score, loss of the second best (inf: none), number of pieces, and the pieces' ids, for units laid end to end."""
        out = []
        ends = np.cumsum(size)
        i = 0
        while i < len(size):
            base = ends[i] - size[i]
            j = max(i + 1, int(np.searchsorted(ends, base + _CHUNK, "right")))
            out.append(self._segment(cps[base : ends[j - 1]], size[i:j]))
            i = j
        if not out:
            return np.empty(0), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int32)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _segment(self, cps, size):
        n, units = len(cps), len(size)
        start = np.cumsum(size) - size
        left = np.repeat(start + size, size) - np.arange(n)
        scores, ids = self._lattice(cps, left)
        # A unit falls apart where no piece reaches across: its parts are independent.
        reach = np.arange(1, n + 1)
        for k in range(2, self.longest + 1):
            at = np.flatnonzero(ids[k - 1] >= 0)
            reach[at] = at + k
        cut = np.concatenate([[0], np.flatnonzero(np.maximum.accumulate(reach)[:-1] == np.arange(1, n)) + 1])
        parts = np.searchsorted(cut, start)  # each unit's first part
        total, loss, count, pieces = self._parts(cps, np.diff(np.append(cut, n)), scores, ids)
        return np.add.reduceat(total, parts), np.minimum.reduceat(loss, parts), np.add.reduceat(count, parts), pieces

    def _long(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best score before, last piece, and best score behind each node of one part; scores: length x start."""
        n = scores.shape[1]
        starts, sizes = np.nonzero(np.isfinite(scores.T))
        value = scores[sizes, starts].tolist()
        starts, ends = starts.tolist(), (starts + sizes + 1).tolist()
        ahead, taken, behind = [-math.inf] * (n + 1), [0] * (n + 1), [-math.inf] * (n + 1)
        ahead[0] = behind[n] = 0.0
        for i, j, s in zip(starts, ends, value, strict=True):
            if ahead[i] + s > ahead[j]:  # the longest piece comes first
                ahead[j], taken[j] = ahead[i] + s, j - i
        for i, j, s in zip(reversed(starts), reversed(ends), reversed(value), strict=True):
            if behind[j] + s > behind[i]:
                behind[i] = behind[j] + s
        return np.array(ahead), np.array(taken), np.array(behind)

    def _parts(self, cps, size, scores, ids):
        n, units = len(cps), len(size)
        start = np.cumsum(size) - size
        unit = np.repeat(np.arange(units), size)
        # Node k of a part lies at start + part number + k: a part has one node more than characters.
        first = start + np.arange(units)
        ahead = np.full(n + units, -np.inf)
        ahead[first] = 0
        taken = np.zeros(n + units, np.int64)
        behind = np.full(n + units, -np.inf)
        behind[first + size] = 0
        by = np.argsort(-size, kind="stable")
        few = max(_SHORT, int(size[by[min(_FEW, units) - 1]])) if units else 0
        alone = size > few
        for u in np.flatnonzero(alone):
            nodes = slice(first[u], first[u] + size[u] + 1)
            ahead[nodes], taken[nodes], behind[nodes] = self._long(scores[:, start[u] : start[u] + size[u]])
        by = by[alone.sum() :]
        longest_first = size[by]
        for t in range(1, int(longest_first.max(initial=0)) + 1):
            live = by[: np.searchsorted(-longest_first, -t, "right")]
            best, how = np.full(len(live), -np.inf), np.zeros(len(live), np.int64)
            for k in range(1, min(t, self.longest) + 1):
                s = ahead[first[live] + t - k] + scores[k - 1, start[live] + t - k]
                better = s >= best  # of equal scores the longer last piece
                best[better], how[better] = s[better], k
            ahead[first[live] + t], taken[first[live] + t] = best, how
        for t in range(1, int(longest_first.max(initial=0)) + 1):
            live = by[: np.searchsorted(-longest_first, -t, "right")]
            at = size[live] - t
            best = np.full(len(live), -np.inf)
            for k in range(1, min(t, self.longest) + 1):
                best = np.maximum(best, behind[first[live] + at + k] + scores[k - 1, start[live] + at])
            behind[first[live] + at] = best
        total = ahead[first + size]
        # Back along the best paths.
        begins = np.zeros(n, np.int64)  # length of the best path's piece that begins here
        for u in np.flatnonzero(alone):
            hop, at, found = taken[first[u] : first[u] + size[u] + 1].tolist(), int(size[u]), []
            while at:
                at -= hop[at]
                found.append(at)
            here = np.array(found) + start[u]
            begins[here] = np.diff(np.append(here[::-1], start[u] + size[u]))[::-1]
        live = by
        at = size[live]
        while len(live):
            k = taken[first[live] + at]
            at = at - k
            begins[start[live] + at] = k
            live, at = live[at > 0], at[at > 0]
        second = np.full(units, -np.inf)
        node = np.arange(n) + unit
        for k in range(1, self.longest + 1):
            may = np.flatnonzero(np.isfinite(scores[k - 1]) & (begins != k))
            np.maximum.at(second, unit[may], ahead[node[may]] + scores[k - 1, may] + behind[node[may] + k])
        at = np.flatnonzero(begins)
        chosen = ids[begins[at] - 1, at]
        pieces, owner = chosen, unit[at]
        if (chosen < 0).any():
            many = np.where(chosen < 0, _utf8_size(cps[at]), 1)
            pieces = np.repeat(chosen, many)
            raw = "".join(map(chr, cps[at[chosen < 0]])).encode()
            pieces[pieces < 0] = self.byte_ids[np.frombuffer(raw, np.uint8)]
            owner = np.repeat(owner, many)
        return total, total - second, np.bincount(owner, minlength=units), pieces

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts with pieces bounds[i] .. bounds[i + 1], laid end to end, and where each begins."""
        size = self.out_size[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        raw = self.out_bytes[np.repeat(self.out_at[ids] - total[:-1], size) + np.arange(total[-1])]
        begin = total[bounds]
        some = np.diff(begin) > 0  # the first space is no part of the text
        keep = np.ones(len(raw), dtype=bool)
        keep[begin[:-1][some]] = False
        return raw[keep], begin - np.concatenate([[0], np.cumsum(some)])


def _utf8_size(cps: np.ndarray) -> np.ndarray:
    return 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (sizes[i] numbers) for each i."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _alternatives(lists: list[tuple[int, list[tuple[float, tuple[int, ...]]]]], n: int) -> list[tuple[float, list[tuple[int, int]]]]:
    """The n best sums of one choice from each list: loss and (list, choice) of what is not a first choice; the first is no change."""
    start = (0,) * len(lists)
    heap, seen, out = [(0.0, start)], {start}, []
    while heap and len(out) < n:
        loss, pick = heapq.heappop(heap)
        out.append((loss, [(k, c) for k, c in enumerate(pick) if c]))
        for k, (_, options) in enumerate(lists):
            if pick[k] + 1 < len(options):
                new = (*pick[:k], pick[k] + 1, *pick[k + 1 :])
                if new not in seen:
                    seen.add(new)
                    heapq.heappush(heap, (loss + options[pick[k]][0] - options[pick[k] + 1][0], new))
    return out


EDIT = pa.struct([("piece", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])
ALTERNATIVE = pa.struct([("score", pa.float64()), ("edits", pa.list_(EDIT))])
SCHEMA = "n_pieces long, score double, ids array<int>, round_trip boolean, alternatives array<struct<score: double, edits: array<struct<piece: int, drop: int, ids: array<int>>>>>"


def encode_slice(pieces: Pieces, texts: list[str], n: int, search) -> list[pa.Array]:
    """The columns of SCHEMA for some texts.  search(unit, n): n_best, kept for units that return."""
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    cps = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le"), np.uint32)
    doc_at = np.cumsum(sizes) - sizes
    space = cps == 32
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[doc_at[sizes > 0]] = True
    start = np.flatnonzero(cut)
    size = np.diff(np.concatenate([start, [len(cps)]]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((cps.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(cps)), dtype=np.uint64)])
    h = mix((sums[start + size] - sums[start]) * _powers(_BASE_INV, max(1, len(cps)))[start] + size.astype(np.uint64)) if len(start) else np.empty(0, np.uint64)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    score, loss, count, ids = pieces.segment(cps[_spread(start[first], size[first])], size[first])
    ids_at = np.cumsum(count) - count
    doc = np.searchsorted(doc_at, start, "right") - 1 if len(start) else np.empty(0, np.int64)
    n_pieces = np.bincount(doc, count[which], len(texts)).astype(np.int64)
    all_ids = ids[_spread(ids_at[which], count[which])].astype(np.int32)
    bounds = np.concatenate([[0], np.cumsum(n_pieces)])
    total = np.bincount(doc, score[which], len(texts))
    raw, begin = pieces.decode(all_ids, bounds)
    wanted = np.frombuffer("".join(texts).encode(), np.uint8)
    lengths = np.array([len(t.encode()) for t in texts], np.int64)
    good = np.diff(begin) == lengths
    if good.all():
        wrong = np.concatenate([[0], np.cumsum(raw != wanted)])
        good &= wrong[begin[1:]] == wrong[begin[:-1]]
    more: list[list[dict]] = [[] for _ in texts]
    if n > 1 and len(start):
        lost = loss[which]
        order = np.lexsort((start, lost, doc))
        rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
        near = np.sort(order[(rank < n - 1) & np.isfinite(lost[order])])
        before = np.cumsum(count[which]) - count[which]
        for d, lo, hi in zip(*_runs(doc[near]), strict=True):
            lists = [(int(u), search("".join(map(chr, cps[start[u] : start[u] + size[u]])), n)) for u in near[lo:hi]]
            for less, changes in _alternatives(lists, n)[1:]:
                edits = [{"piece": int(before[lists[k][0]] - bounds[d]), "drop": int(count[which[lists[k][0]]]), "ids": list(lists[k][1][c][1])} for k, c in changes]
                more[d].append({"score": float(total[d] - less), "edits": edits})
    return [pa.array(n_pieces), pa.array(total), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(all_ids)), pa.array(good), pa.array(more, pa.list_(ALTERNATIVE))]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
    return x[edge], edge, np.concatenate([edge[1:], [len(x)]]) if len(x) else edge


def _encoder(model, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model.value)
        kept = lru_cache(maxsize=100_000)(pieces.n_best)
        search = lambda unit, n: kept(unit, n) if len(unit) <= _SHORT else pieces.n_best(unit, n)
        for b in batches:
            texts, at = b.column(0).to_pylist(), 0
            while at < len(texts):
                to, held = at, 0
                while to < len(texts) and (to == at or held + len(texts[to] or "") <= _SLICE):
                    held += len(texts[to] or "")
                    to += 1
                columns = encode_slice(pieces, [t or "" for t in texts[at:to]], n, search)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(at, to - at), *columns], names=["id", "n_pieces", "score", "ids", "round_trip", "alternatives"])
                at = to

    return run


def encode(docs: DataFrame, n_best: int = N_BEST, model_path: str = MODEL_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, score, ids, round_trip, alternatives: a row per row of docs.

    ids is the best segmentation of the whole text; round_trip says that it decodes to the text.
    alternatives has the next n_best - 1 (fewer if there are no more) in the order of their scores:
    each is the best one with, for each edit, ``drop`` pieces from number ``piece`` on replaced by
    ``ids``.  Equal scores may come in either order.  Null and empty texts have no pieces, score 0
    and no alternatives.  Ids may be null or repeat; other columns are ignored.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(read_model(model_path))  # a vocabulary file: its size is fixed
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id")).mapInArrow(_encoder(model, n_best), f"id {kind}, {SCHEMA}").withColumnRenamed("id", "doc_id")


def decode(encoded: DataFrame, model_path: str = MODEL_PATH, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text for each row of encoded; null ids decode to an empty text.  Bytes that are no UTF-8 are replaced."""
    model = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model.value)
        for b in batches:
            lists = [np.array(x or [], np.int64) for x in b.column(0).to_pylist()]
            raw, begin = pieces.decode(np.concatenate([np.empty(0, np.int64), *lists]), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64))
            texts = [raw[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(texts, pa.string())], names=["id", "text"])

    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(F.col(ids_col).alias("ids"), F.col(id_col).alias("id")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", "doc_id")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
