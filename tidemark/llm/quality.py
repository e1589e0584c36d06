"""Document quality by attention-based multiple-instance learning (Ilse, Tomczak and Welling, 2018).

A document is a bag of passages of ``PASSAGE`` words.  Every passage of the whole text is encoded
from its words and characters; gated attention weighs the passages, and the weighted sum is
scored.  Only documents have labels; which passages spoil a document is learned by the attention.
The model is fitted in numpy on at most ``LABELLED`` labelled documents with at most ``PASSAGES``
passages in all, taken by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .lm import held_out
from .shared import table, written
from .words import Words, split

PASSAGE = 64
#: Labelled documents that the model is fitted on, at most.
LABELLED = 8000
#: Passages of these that are gathered, at most (632 bytes each).
PASSAGES = 120_000
_WORD_BINS, _TAIL_BINS = 96, 48
_PLAIN = 14
FEATURES = _PLAIN + _WORD_BINS + _TAIL_BINS

_kinds = np.zeros((5, 256), dtype=bool)
_kinds[0, ord("A") : ord("Z") + 1] = True
_kinds[1, ord("0") : ord("9") + 1] = True
_kinds[2, [b for b in range(33, 127) if not chr(b).isalnum()]] = True
_kinds[3, 128:] = True
_kinds[4, 10] = True


def passages(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage (float32), and where each row's passages begin; a row without words is one empty passage."""
    n_words = np.diff(w.offset)
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    begin = np.concatenate([[0], np.cumsum(n_passages)])
    total = int(begin[-1])
    x = np.zeros((total, FEATURES), dtype=np.float32)
    if not len(w.hash):
        x[:, 0] = 1
        return x, begin
    place = begin[w.doc] + (np.arange(len(w.hash)) - w.offset[w.doc]) // PASSAGE
    count = np.bincount(place, minlength=total)
    some = np.maximum(count, 1)
    per = lambda v: np.bincount(place, v, total) / some
    size = (w.end - w.start).astype(np.float64)
    mean = per(size)
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    which = place[starts]
    lo, hi = w.start[starts], w.end[np.concatenate([starts[1:], [len(place)]]) - 1]
    x[:, 0] = count == 0
    x[:, 1] = np.log1p(count) / 4
    x[:, 2], x[:, 3] = mean / 8, np.sqrt(np.maximum(per(size * size) - mean * mean, 0)) / 8
    for i, kind in enumerate(_kinds):
        sums = np.concatenate([[0], np.cumsum(kind[w.raw], dtype=np.int64)])
        x[which, 4 + i] = (sums[hi] - sums[lo]) / (hi - lo)
    x[:, 9] = np.minimum(mean / 8, 4) ** 2
    x[:, 10] = per(size <= 2)
    order = np.lexsort((w.hash, place))
    again = np.zeros(len(order))
    again[1:] = (w.hash[order][1:] == w.hash[order][:-1]) & (place[order][1:] == place[order][:-1])
    x[:, 11] = np.bincount(place[order], again, total) / some
    at, g = w.grams(4)
    if len(at):
        order = np.lexsort((g, w.doc[at]))
        twin = (g[order][1:] == g[order][:-1]) & (w.doc[at][order][1:] == w.doc[at][order][:-1])
        again = np.zeros(len(order))
        again[1:] += twin
        again[:-1] = np.maximum(again[:-1], twin)
        x[:, 12] = np.bincount(place[at[order]], again, total) / some
    x[:, 13] = np.repeat(np.log1p(n_words) / 8, n_passages)
    words = np.bincount(place * _WORD_BINS + (w.hash % np.uint64(_WORD_BINS)).astype(np.int64), minlength=total * _WORD_BINS)
    x[:, _PLAIN : _PLAIN + _WORD_BINS] = np.sqrt(words.reshape(total, _WORD_BINS) / some[:, None])
    last = w.raw[w.end - 1].astype(np.int64) * 257 + np.where(size > 1, w.raw[w.end - 2], 0)
    tails = np.bincount(place * _TAIL_BINS + last % _TAIL_BINS, minlength=total * _TAIL_BINS)
    x[:, _PLAIN + _WORD_BINS :] = np.sqrt(tails.reshape(total, _TAIL_BINS) / some[:, None])
    return x, begin


class AttentionModel:
    """Encoder, gated attention and score, with gradients written out."""

    CODE, GATE = 24, 12

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.normal(0, 1 / np.sqrt(s[0]), s)).astype(np.float32)
        self.p = {"W": f(FEATURES, self.CODE), "b": np.zeros(self.CODE, np.float32), "V": f(self.CODE, self.GATE), "U": f(self.CODE, self.GATE), "a": f(self.GATE), "u": f(self.CODE), "c": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        self.known = False

    def forward(self, x: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
        p, starts = self.p, begin[:-1]
        z = np.tanh(((x - self.mean) / self.scale) @ p["W"] + p["b"])
        t, s = np.tanh(z @ p["V"]), 1 / (1 + np.exp(-(z @ p["U"])))
        e = (t * s) @ p["a"]
        n = np.diff(begin)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), n))
        share = e / np.repeat(np.add.reduceat(e, starts), n)
        bag = np.add.reduceat(share[:, None] * z, starts, axis=0)
        return {"z": z, "t": t, "s": s, "share": share, "bag": bag, "n": n, "score": 1 / (1 + np.exp(-np.clip(bag @ p["u"] + p["c"], -30, 30)))}

    def fit(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray, epochs: int = 16, batch: int = 128, rate: float = 0.004, decay: float = 1e-4, seed: int = 5) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 0.05
        rng = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(q) for k, q in self.p.items()}, {k: np.zeros_like(q) for k, q in self.p.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                rows = np.sort(order[i : i + batch])
                n = begin[rows + 1] - begin[rows]
                own = np.concatenate([[0], np.cumsum(n)])
                xs = x[np.repeat(begin[rows] - own[:-1], n) + np.arange(own[-1])]
                step += 1
                for k, g in self._gradients(xs, own, y[rows]).items():
                    g = g + decay * self.p[k] * (k not in "bc")
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= (rate * (1 - 0.9 * epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        self.known = True

    def _gradients(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, o = self.p, self.forward(x, begin)
        z, t, s, share, n = o["z"], o["t"], o["s"], o["share"], o["n"]
        d = ((o["score"] - y) / len(y)).astype(np.float32)
        d_bag = np.repeat(d[:, None] * p["u"], n, axis=0)
        d_share = (d_bag * z).sum(1)
        d_e = share * (d_share - np.repeat(np.add.reduceat(share * d_share, begin[:-1]), n))
        d_t, d_s = d_e[:, None] * s * p["a"] * (1 - t * t), d_e[:, None] * t * p["a"] * s * (1 - s)
        d_z = (share[:, None] * d_bag + d_t @ p["V"].T + d_s @ p["U"].T) * (1 - z * z)
        return {"W": ((x - self.mean) / self.scale).T @ d_z, "b": d_z.sum(0), "V": z.T @ d_t, "U": z.T @ d_s, "a": (t * s).T @ d_e, "u": o["bag"].T @ d, "c": np.array([d.sum()])}

    def scores(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return self.forward(x, begin)["score"].astype(np.float64) if self.known else np.full(len(begin) - 1, 0.5)


def _featurizer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, label -> label, number of passages, their features as bytes."""
    for b in batches:
        at = 0
        for w in split(b.column(0), lower=False):
            x, begin = passages(w)
            rows = [x[i:j].tobytes() for i, j in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1).slice(at, w.n_docs), pa.array(np.diff(begin)), pa.array(rows, pa.binary())], names=["label", "n", "x"])
            at += w.n_docs


def _scorer(model: AttentionModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts = 0, b.column(0)
            for w in split(texts, lower=False):
                score = model.scores(*passages(w))
                rest = [c.slice(at, w.n_docs) for c in b.columns[1:]]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(score)], names=[*b.schema.names[1:], "score"])
                at += w.n_docs

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = LABELLED, passage_limit: int = PASSAGES, modulus: int = 3, rest: int = 1) -> AttentionModel:
    """A model of the labels (0 or 1) of documents that are not held out.

    Of an id that is labelled more than once the mean label counts, rounded half up; null labels
    and ids are skipped.  The sample is ``limit`` labelled ids, and of their distinct texts, in the
    order of a hash, ``limit`` at most, leaving out a text that would bring the passages above
    ``passage_limit``.  Without labelled documents the model scores 0.5.
    """
    told = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    told = told.where(~held_out(F.col("_id"), modulus, rest)).orderBy(F.xxhash64("_id"), "_id").limit(limit)
    sample = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(told), "_id")  # limit rows at most
    sample = written(sample.select(F.xxhash64("_id", "text").alias("key"), "text", "label"), "sample")
    n_words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    sized = sample.select("key", F.greatest(F.lit(1), F.ceil(n_words / PASSAGE)).alias("n")).distinct().orderBy("key").limit(limit).toPandas()
    held, taken = 0, []
    for key, n in zip(sized["key"].tolist(), sized["n"].tolist(), strict=True):
        if held + n <= passage_limit:
            held += n
            taken.append((key,))
    chosen = docs.sparkSession.createDataFrame(taken, "key long")
    sample = sample.join(F.broadcast(chosen), "key").dropDuplicates(["key"]).select("text", "label")  # limit rows at most
    got = sample.mapInArrow(_featurizer, "label int, n long, x binary").toPandas()
    model = AttentionModel()
    if len(got):
        got["at"] = [hash_of(x) for x in got["x"]]
        got = got.sort_values(["at", "label"], kind="stable")  # the same model, whatever order the rows come in
        x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, FEATURES)
        model.fit(x, np.concatenate([[0], np.cumsum(got["n"])]), got["label"].to_numpy(np.float32))
    return model


def hash_of(x: bytes) -> int:
    import zlib

    return zlib.crc32(x)


def score_quality(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text", modulus: int = 3, rest: int = 1) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted for each row of docs, whatever else it holds.

    Texts are scored whole; null, empty and blank texts are one empty passage.  Equal texts have
    equal scores.
    """
    kind = dict(docs.dtypes)[id_col]
    scored = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("doc_id")).mapInArrow(_scorer(model), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, rest).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: AttentionModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that score at least ``least``, with all their columns."""
    names = docs.columns
    columns = [F.col(text_col).cast("string").alias("_text"), F.struct(*[F.col(c) for c in names]).alias("_row")]
    scored = docs.select(*columns).mapInArrow(_scorer(model), T.StructType([T.StructField("_row", docs.schema), T.StructField("score", T.DoubleType())]))
    return scored.where(F.col("score") >= least).select("_row.*")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
