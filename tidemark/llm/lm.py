"""Log-bilinear language model, trained in numpy with noise-contrastive estimation.

The ``OWN`` most frequent words have vectors of their own; all others share ``TAIL`` classes by their
last two bytes.  Own words are laid in groups of ``GROUP`` by frequency.  From the words before, one
vector for each, weighted elementwise by position (the vector log-bilinear model of Mnih and
Kavukcuoglu, 2013), two heads predict: one the group or tail class, the other the word among the own
ones.  Both are trained by noise-contrastive estimation.  Batched matrix products normalise the
first over all groups and tail classes, and the second inside the word's group, so a text's score is
the log of a probability; inside a tail class a word has its add-one share, with one place for
unseen words.

Counts cover all training texts.  The first parameters come from one task over about
``WARM_TOKENS`` tokens in the order of a hash; then training passes over all training texts once, in
``ROUNDS`` disjoint shares: in a round each partition starts from the same parameters, and Spark
averages what the partitions learned, weighted by their tokens.  The same files in the same splits
give the same scores but for rounding; other splits give slightly other parameters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import table, written
from .words import Words, mix, split

OWN, GROUP, TAIL, DIM, CONTEXT = 8192, 64, 128, 32, 3
ROUNDS, NOISE, BATCH, RATE = 2, 32, 2048, 0.1
#: Tokens, about, from which one task makes the first parameters; all texts follow.
WARM_TOKENS = 1_500_000
#: Words, at most, whose counts are broadcast (16 bytes each); the others' are joined.
KNOWN = 1 << 18
_END = np.uint64(0x6A09E667F3BCC909)
_BLOCK = 1024  # tokens that are normalised at once
_PART = 2048  # parameters in a row that Spark adds up


def held_out(doc_id: Column, modulus: int = 7, rest: int = 2) -> Column:
    """Whether crc32 of the id as text has the given rest; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == rest


def _tokens(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, tail class and row of every token: each row's words, then its end."""
    n = len(w.hash) + w.n_docs
    ends = w.offset[1:] + np.arange(w.n_docs)
    is_end = np.zeros(n, dtype=bool)
    is_end[ends] = True
    h, tail, row = np.empty(n, np.uint64), np.zeros(n, np.int64), np.empty(n, np.int64)
    h[ends], h[~is_end] = _END, w.hash
    row[ends], row[~is_end] = np.arange(w.n_docs), w.doc
    last = w.bytes[w.end - 1].astype(np.uint64) if len(w.hash) else np.empty(0, np.uint64)
    before = np.where(w.end - w.start > 1, w.bytes[w.end - 2], 0).astype(np.uint64) if len(w.hash) else np.empty(0, np.uint64)
    tail[~is_end] = (mix(last * np.uint64(256) + before) % np.uint64(TAIL)).astype(np.int64)
    return h, tail, row


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of a partition; given out whenever many words are held."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, tail, n = (np.concatenate(x) for x in zip(*held, strict=True))
        words, first, back = np.unique(h, return_index=True, return_inverse=True)
        return words, tail[first], np.bincount(back, weights=n).astype(np.int64)

    def out(h: np.ndarray, tail: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(tail.astype(np.int32)), pa.array(n)], names=["word", "tail", "n"])

    for b in batches:
        for w in split(b.column(0)):
            h, tail, _ = _tokens(w)
            words, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((words, tail[first], n))
            if sum(len(x[0]) for x in held) > 4_000_000:
                held[:] = [merged()]
                if len(held[0][0]) > 2_000_000:
                    yield out(*held.pop())
    if held:
        yield out(*merged())


class Model:
    """Parameters, and the number of a word: own words by frequency, then the tail classes."""

    NAMES = ("context", "position", "group", "group_bias", "word", "word_bias")

    def __init__(self, own: np.ndarray, share: np.ndarray, seed: int = 7):
        """own: hashes of the words with vectors of their own, by frequency; share: unigram share of each, then of each tail class."""
        rng = np.random.default_rng(seed)
        self.order = np.argsort(own)
        self.own = own[self.order]
        n = len(share)
        self.groups = -(-len(own) // GROUP)
        self.word_noise = share[: len(own)] / share[: len(own)].sum()
        self.group_noise = np.bincount(self.group_of(np.arange(n)), share / share.sum())
        self.context = rng.normal(0, 0.3, (n + 1, DIM)).astype(np.float32)  # the last: before the text
        self.position = np.full((CONTEXT, DIM), 1.0 / CONTEXT, np.float32)
        self.group = rng.normal(0, 0.1, (self.groups + TAIL, DIM)).astype(np.float32)
        self.word = rng.normal(0, 0.1, (len(own), DIM)).astype(np.float32)
        self.group_bias, self.word_bias = np.log(self.group_noise).astype(np.float32), np.log(self.word_noise).astype(np.float32)
        self.squares = {k: np.full_like(getattr(self, k), 1e-6) for k in self.NAMES}  # Adagrad's sums

    def _tables(self, squares: bool) -> list[np.ndarray]:
        return [getattr(self, k) for k in self.NAMES] + [self.squares[k] for k in self.NAMES] * squares

    def flat(self, squares: bool) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self._tables(squares)])

    def load(self, flat: np.ndarray, squares: bool) -> None:
        at = 0
        for x in self._tables(squares):
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size

    def numbers(self, h: np.ndarray, tail: np.ndarray) -> np.ndarray:
        if not len(self.own):
            return tail
        at = np.minimum(np.searchsorted(self.own, h), len(self.own) - 1)
        return np.where(self.own[at] == h, self.order[at], len(self.own) + tail)

    def group_of(self, numbers: np.ndarray) -> np.ndarray:
        return np.where(numbers < len(self.own), numbers // GROUP, numbers - len(self.own) + self.groups)

    def before(self, numbers: np.ndarray, row: np.ndarray) -> np.ndarray:
        """CONTEXT x tokens: what stands before each token, nothing across texts."""
        n, none = len(numbers), len(self.context) - 1
        found = np.full((CONTEXT, n), none, dtype=np.int64)
        for p in range(1, CONTEXT + 1):
            same = row[p:] == row[:-p] if n > p else np.empty(0, bool)
            found[p - 1, p:][same] = numbers[:-p][same] if n > p else []
        return found

    def _step(self, name: str, index: np.ndarray, rows: np.ndarray) -> None:
        """Adagrad on the rows of a table that a batch touches; an index may repeat."""
        order = np.argsort(index.astype(np.uint16), kind="stable")
        index = index[order]
        starts = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
        step, at = np.add.reduceat(rows[order], starts, axis=0), index[starts]
        square = self.squares[name][at] + step * step
        self.squares[name][at] = square
        getattr(self, name)[at] += RATE * step / np.sqrt(square)

    def _head(self, name: str, q: np.ndarray, right: np.ndarray, noise: np.ndarray, drawn: np.ndarray) -> np.ndarray:
        """Noise-contrastive step of one head for one batch, whose tokens share the drawn noise; gives the gradient for q."""
        targets, bias = getattr(self, name), getattr(self, name + "_bias")
        log_kq = np.log(len(drawn) * noise).astype(np.float32)
        t, wrong = targets.take(right, 0), targets[drawn]
        g = 1.0 / (1.0 + np.exp((q * t).sum(1) + (bias - log_kq)[right]))
        f = q @ wrong.T
        f += (bias - log_kq)[drawn]
        np.negative(f, out=f)
        np.exp(f, out=f)
        f += 1.0
        np.divide(-1.0, f, out=f)
        dq = g[:, None] * t
        dq += f @ wrong
        index = np.concatenate([right, drawn])
        self._step(name, index, np.concatenate([g[:, None] * q, f.T @ q]))
        self._step(name + "_bias", index, np.concatenate([g, f.sum(0)]))
        return dq

    def train(self, numbers: np.ndarray, before: np.ndarray, rng: np.random.Generator) -> None:
        """One pass over the tokens, in batches."""
        sums = {k: np.cumsum(noise) for k, noise in (("group", self.group_noise), ("word", self.word_noise)) if len(noise)}
        groups, own = self.group_of(numbers), numbers < len(self.own)
        for i in range(0, len(numbers), BATCH):
            c = before[:, i : i + BATCH]
            seen = self.context.take(c, 0)
            q = (seen * self.position[:, None]).sum(0)
            drawn = {k: np.minimum(np.searchsorted(x, rng.random(NOISE)), len(x) - 1) for k, x in sums.items()}
            dq = self._head("group", q, groups[i : i + BATCH], self.group_noise, drawn["group"])
            rows = np.flatnonzero(own[i : i + BATCH])
            if len(rows):
                dq[rows] += self._head("word", q[rows], numbers[i + rows], self.word_noise, drawn["word"])
            self._step("context", c.ravel(), (dq[None] * self.position[:, None]).reshape(-1, DIM))
            step = (dq[None] * seen).sum(1) / len(dq) * 32
            self.squares["position"] += step * step
            self.position += 0.02 * step / np.sqrt(self.squares["position"])

    def log_shares(self, numbers: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Normalised natural log-probability of each token's own word or tail class."""
        weighed = self.context[None] * self.position[:, None]
        q = weighed[0].take(before[0], 0)
        for p in range(1, CONTEXT):
            q += weighed[p].take(before[p], 0)
        g = self.group_of(numbers)
        out = _log_softmax(q, self.group, self.group_bias, g)
        # Tokens of a group stand together: its words are normalised for all of them at once.
        order = np.argsort(g.astype(np.uint16), kind="stable")
        edges = np.searchsorted(g[order], np.arange(self.groups + 1))
        for k in np.flatnonzero(np.diff(edges)):
            at, words = order[edges[k] : edges[k + 1]], slice(k * GROUP, min((k + 1) * GROUP, len(self.own)))
            out[at] += _log_softmax(q[at], self.word[words], self.word_bias[words], numbers[at] - k * GROUP)
        return out


def _log_softmax(q: np.ndarray, targets: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log of each row's share of target at[row], over all targets."""
    out = np.empty(len(q), np.float64)
    across, ones = np.ascontiguousarray(targets.T), np.ones(len(targets), np.float32)
    for i in range(0, len(q), _BLOCK):
        logits = q[i : i + _BLOCK] @ across
        logits += bias
        own = np.take_along_axis(logits, at[i : i + _BLOCK, None], 1)[:, 0].astype(np.float64)
        top = max(float(logits.max(initial=0)) - 60.0, 0.0)  # float32 holds e**88
        if top:
            logits -= np.float32(top)
        np.exp(logits, out=logits)
        out[i : i + _BLOCK] = own - (top + np.log(np.maximum(logits @ ones, np.float32(1e-38)).astype(np.float64)))
    return out


def _trainer(model: Model, seed: int, squares: bool):
    """texts -> the parameters learned from a partition, times its tokens, in rows that can be added up; part -1 has the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, n = None, 0
        for b in batches:
            for w in split(b.column(0)):
                h, tail, row = _tokens(w)
                if not len(h):
                    continue
                rng = rng or np.random.default_rng([seed, int(h[0])])
                numbers = model.numbers(h, tail)
                # Texts in turn, not one after the other: a batch then holds pieces of many.
                before, by = model.before(numbers, row), rng.permutation(len(numbers))
                model.train(numbers[by], before[:, by], rng)
                n += len(numbers)
        if n:
            flat = (model.flat(squares).astype(np.float64) * n).astype(np.float32)
            rows = [flat[i : i + _PART].tobytes() for i in range(0, len(flat), _PART)]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(rows)), pa.int32()), pa.array([np.float32([n]).tobytes(), *rows], pa.binary())], names=["part", "x"])

    return run


def _adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of each part; a part's rows follow each other."""
    part, total = None, None
    for b in batches:
        for p, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            x = np.frombuffer(x.as_buffer(), np.float32)
            if p != part:
                if part is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "x"])
                part, total = p, np.zeros(len(x), np.float64)
            total += x
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "x"])


def _learn(model: Model, share: DataFrame, seed: int, squares: bool) -> None:
    """Train on each partition of share(text) from the model's parameters, and take the average."""
    learned = share.select("text").mapInArrow(_trainer(model, seed, squares), "part int, x binary")
    rows = learned.repartition("part").sortWithinPartitions("part").mapInArrow(_adder, "part int, x binary").collect()  # the parameters
    if rows:
        tokens, *parts = [np.frombuffer(r.x, np.float64) for r in sorted(rows, key=lambda r: r.part)]
        model.load(np.concatenate(parts) / tokens[0], squares)


def _scorer(model: Model, known, sizes: np.ndarray):
    """known: broadcast (hashes, counts); sizes: log10 of the places in each tail class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = known.value
        own = len(model.own)
        for b in batches:
            at = 0
            for w in split(b.column(1)):
                h, tail, row = _tokens(w)
                numbers = model.numbers(h, tail)
                logs = model.log_shares(numbers, model.before(numbers, row)) / np.log(10)
                if len(hashes):
                    spot = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    found = hashes[spot] == h
                    log_count = np.where(found, np.log10(counts[spot] + 1.0), 0.0)
                else:
                    found, log_count = np.zeros(len(h), bool), np.zeros(len(h))
                rare = numbers >= own
                logs += np.where(rare, log_count - sizes[tail], 0.0)
                per = lambda x: np.bincount(row, x, w.n_docs)
                far, far_row = h[~found], row[~found]
                bounds = np.searchsorted(far_row, np.arange(w.n_docs + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, w.n_docs), b.column(2).slice(at, w.n_docs), pa.array(np.bincount(row, minlength=w.n_docs)), pa.array(per(found).astype(np.int64)), pa.array(per(log_count)), pa.array(per(logs)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(far.view(np.int64)))],
                    names=["doc_id", "row", "n_tokens", "n_known", "log_counts", "log_model", "far"],
                )
                at += w.n_docs

    return run


def _frequent(counts: DataFrame, most: int):
    """The most frequent words (word, n), at most ``most``, as a pandas frame.

    Words are cut off at a count, not sorted: a histogram of the counts' logarithms tells where.  If
    more words than that have the largest count, none are taken; the others are joined anyway.
    """
    level = F.floor(F.log2("n") * 64)
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).toPandas().sort_values("level", ascending=False)
    fit = levels[levels["words"].cumsum() <= most]
    if not len(fit):
        return counts.limit(0).toPandas()
    return counts.where(level >= int(fit["level"].min())).toPandas()


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, rest: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Learns from the rows that are not held out (see held_out).  A null, empty or blank text is its
    end alone.  Repeated rows count, and are scored, each time.  Without any training text all
    words are unseen and the model is uniform over its classes.  Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    training = docs.where(~held_out(F.col("doc_id"), modulus, rest))
    counts = training.select("text").mapInArrow(_counter, "word long, tail int, n long")
    counts = written(counts.groupBy("word", "tail").agg(F.sum("n").alias("n")), "counts")
    n_all, v_all = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    known = _frequent(counts, KNOWN)
    head = counts.orderBy(F.desc("n"), "word").limit(OWN).toPandas()
    tails = counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    n_tail, v_tail = np.zeros(TAIL), np.zeros(TAIL)
    n_tail[tails["tail"]], v_tail[tails["tail"]] = tails["n"], tails["v"]
    np.subtract.at(n_tail, head["tail"].to_numpy(np.int64), head["n"].to_numpy(np.float64))
    np.subtract.at(v_tail, head["tail"].to_numpy(np.int64), 1)
    model = Model(head["word"].to_numpy(np.int64).view(np.uint64), np.concatenate([head["n"].to_numpy(np.float64) + 1, n_tail + 1]))
    # The first parameters: one task over a bounded, hashed part of the texts.  Averaging needs starts that agree.
    share = lambda n, i, name: training.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(name)), F.lit(n)) == i)
    warm = share(max(1, -(-int(n_all) // WARM_TOKENS)), 0, "warm").repartition(1).sortWithinPartitions(F.xxhash64("doc_id", "text"), "doc_id")
    _learn(model, warm, 0, True)
    for i in range(ROUNDS):
        _learn(model, share(ROUNDS, i, "share"), i + 1, False)
    hashes = known["word"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(hashes)
    sent = spark.sparkContext.broadcast((hashes[by], known["n"].to_numpy(np.int64)[by]))
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    scored = rows.mapInArrow(_scorer(model, sent, np.log10(n_tail + v_tail + 1)), "doc_id " + dict(docs.dtypes)["doc_id"] + ", row long, n_tokens long, n_known long, log_counts double, log_model double, far array<long>")
    scored = written(scored, "scored")
    far = scored.select("row", F.explode("far").alias("word")).groupBy("word", "row").agg(F.count("*").alias("times"))
    far = far.join(counts.select("word", "n"), "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("far_logs"), F.sum("times").alias("far_known"))
    out = scored.drop("far").join(far, "row", "left")
    places = F.log10(F.lit(float(n_all + v_all + 1)))
    far_logs = F.coalesce("far_logs", F.lit(0.0))
    return out.select(
        "doc_id",
        held_out(F.col("doc_id"), modulus, rest).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("log_counts") + far_logs - F.col("n_tokens") * places).alias("base_score"),
        (F.col("log_model") + far_logs).alias("score"),
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))
