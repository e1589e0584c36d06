"""The ten operators against brute force on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import base64
import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL, rows_of, rows_of_spark
from tidemark.llm import licenses, lm, minhash, mixing, pieces, quality, registry, simhash, substrings, topk, warc, words

#: Column names that the operators make or use themselves.
CLASHING = "n long, row string, lo string, hi string, rate string, copy_no string, bands string, score string, kept string"


def table(spark, rows, clash=True):
    """doc_id, text, source and columns whose names clash."""
    full = [(*r, "src") if len(r) == 2 else r for r in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, source string")
    if clash:
        for c in CLASHING.split(", "):
            name, kind = c.split()
            df = df.withColumn(name, F.lit("x") if kind == "string" else F.lit(1).cast("long"))
    return df


@pytest.fixture(scope="module")
def texts():
    """Ids and texts with copies, near copies, shared passages, nulls, blanks, repeats and one very long text."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeXY") for _ in range(r.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base = [text(r.randint(1, 160)) for _ in range(40)]
    shared = text(75)
    for i in range(12):
        w = base[i].split()
        for _ in range(max(1, len(w) // 40)):
            w[r.randrange(len(w))] = "edit"
        base.append(" ".join(w))
        base.append(text(20) + "\n" + shared + "\t" + text(r.randint(0, 15)))
    base += [base[3], base[3].upper(), "", "   ", None, "one", "one two", "x" * 3000, text(5000), " ".join([shared, shared])]
    rows = list(enumerate(base))
    r.shuffle(rows)
    return rows + [(None, base[3]), (7, base[7])]


def split(text):
    return (text or "").encode().split()


# Words


def test_words_match_python(texts):
    t = [x for _, x in texts] + ["\x0b\x0ca\x1cb \xa0c", "Ünïcode WORDS", ""]
    got = []
    for w in words.split(pa.array(t, pa.string())):
        for i in range(w.n_docs):
            got.append([bytes(w.bytes[s:e]) for s, e in zip(w.start[w.offset[i] : w.offset[i + 1]], w.end[w.offset[i] : w.offset[i + 1]])])
    assert got == [(x or "").encode().lower().split() for x in t]


def test_words_hash_alike_in_pieces(texts, monkeypatch):
    t = pa.array([x for _, x in texts], pa.string())
    whole = [h for w in words.split(t) for h in w.hash.tolist()]
    monkeypatch.setattr(words, "SLICE_BYTES", 50)  # shorter than most texts, and than one word
    assert [h for w in words.split(t) for h in w.hash.tolist()] == whole


def test_long_and_short_grams_agree_on_equality():
    (w,) = words.split(pa.array(["a b c d e f g h i j"] * 2))
    for k in (2, 4, 8):
        at, g = w.grams(k)
        assert len(set(g.tolist())) == 11 - k and len(at) == 2 * (11 - k)


# 1 LM scoring


def test_lm_base_score_and_counts(spark, texts):
    rows = lm.language_model_scores(table(spark, texts)).collect()
    train = Counter()
    out = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    for i, t in texts:
        if not out(i):
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    want = sorted((str(i), out(i), len(tokens(t)), sum(train[w] > 0 for w in tokens(t)), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in texts)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)


def test_lm_probabilities_sum_to_one():
    r = np.random.default_rng(1)
    for own in (5, lm.GROUP, 3 * lm.GROUP + 7, 0):
        m = lm.Model(r.integers(1, 2**63, own).astype(np.uint64), r.random(own + lm.TAIL) + 0.1)
        k = own + lm.TAIL
        before = np.repeat(r.integers(0, k + 1, (lm.CONTEXT, 4)), k, axis=1)
        assert np.allclose(np.exp(m.log_shares(np.tile(np.arange(k), 4), before)).reshape(4, k).sum(1), 1, atol=1e-5)


def test_lm_learns_what_follows():
    """After word i comes word i + 1: the learned share of the follower is far above its unigram share."""
    r = np.random.default_rng(2)
    m = lm.Model(r.integers(1, 2**63, 100).astype(np.uint64), np.ones(100 + lm.TAIL))
    numbers = (np.arange(60_000) * 1) % 100
    before = m.before(numbers, np.arange(60_000) // 50)
    for _ in range(4):
        by = r.permutation(len(numbers))
        m.train(numbers[by], before[:, by], r)
    inner = before[0] < 100
    assert np.exp(m.log_shares(numbers, before)[inner]).mean() > 0.5


def test_lm_without_a_count_that_parts_the_words(spark, monkeypatch):
    """All words are equally frequent: none is broadcast, and still the words have vectors of their own and the right counts."""
    monkeypatch.setattr(lm, "KNOWN", 3)
    rows = [(i, f"w{i} v{i}") for i in range(40)]
    seen = []
    real = lm.Model
    monkeypatch.setattr(lm, "Model", lambda own, share: seen.append(len(own)) or real(own, share))
    got = lm.language_model_scores(table(spark, rows)).collect()
    train = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2]
    assert seen == [2 * len(train) + 1] and all(r.n_known == (3 if r.doc_id in train else 1) for r in got)


def test_lm_beats_its_base_on_held_out_texts(spark):
    rows = [r for r in lm.op1_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_lm_without_training_text(spark):
    assert lm.language_model_scores(table(spark, []).limit(0)).count() == 0


# 2 MinHash


def brute_components(rows, words_, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + words_]) for j in range(len(w) - words_ + 1)} if len(w) >= words_ else {tuple(w)} if w else set())
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, _), (j, _), a, b in ((rows[p], rows[q], sets[p], sets[q]) for p, q in itertools.combinations(range(len(rows)), 2)):
        if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return sorted((str(i), len(s), str(None if i is None else find(i)), i is None or find(i) == i) for (i, _), s in zip(rows, sets))


@pytest.mark.parametrize("words_,percent", [(4, 80), (5, 80), (2, 60)])
def test_near_duplicates(spark, texts, words_, percent):
    got = minhash.near_duplicates(table(spark, texts), words=words_, percent=percent)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got.collect()) == brute_components(texts, words_, percent)


def test_crowded_circle_goes_through_tiles(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 7)
    r = random.Random(2)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        w = list(base)
        for _ in range(r.randint(1, 14)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = minhash.near_duplicates(table(spark, rows), words=4, percent=80)
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id), x.kept) for x in got.collect()) == brute_components(rows, 4, 80)


def test_string_ids(spark):
    rows = [("b", "a b c d e f"), ("a", "A b c d e f"), ("c", "x y"), (None, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert {tuple(r)[::2] for r in minhash.near_duplicates(docs, words=4).collect()} == {("b", "a"), ("a", "a"), ("c", "c"), (None, None)}


def chain(n, size=120, step=40):
    """Each text shares two thirds of its words with the next one: they collide in bands and are no near copies."""
    r = random.Random(9)
    w = [f"w{r.randrange(10**9)}" for _ in range(n * step + size)]
    return [(i, " ".join(w[i * step : i * step + size])) for i in range(n)]


def test_chains_of_collisions_are_not_followed(spark, monkeypatch):
    """Twice as long a chain sends at most about twice as many rows through the tiles."""
    rows, sent = {}, {}
    real = minhash.written
    for n in (60, 120):
        sent[n] = 0

        def counted(df, name, n=n):
            out = real(df, name)
            if name == "apart":
                sent[n] = out.select(F.sum(F.expr("m_tiles + q_tiles"))).first()[0] or 0
            return out

        monkeypatch.setattr(minhash, "written", counted)
        monkeypatch.setattr(minhash, "TILE", 8)
        rows[n] = chain(n)
        got = minhash.near_duplicates(table(spark, rows[n]), words=4, bands=60, rows=2)
        assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id), x.kept) for x in got.collect()) == brute_components(rows[n], 4, 80)
    assert 0 < sent[120] < 3 * sent[60]


def test_one_id_with_two_texts(spark):
    rows = [(5, "a b c d e f"), (5, "g h i j k l"), (2, "g h i j k l"), (9, "A b c d e f")]
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(table(spark, rows), words=4).collect()}
    assert got == {(5, 2), (2, 2), (9, 2)}


@pytest.mark.parametrize("parts", [1, 5])
def test_one_id_with_near_copies_of_several_texts(spark, parts):
    r = random.Random(8)
    rows = []
    for k in range(0, 120, 10):
        a, b, c = ([f"w{r.randrange(10**6)}" for _ in range(60)] for _ in range(3))
        edit = lambda w, n: " ".join(w[:n] + ["edit"] + w[n + 1 :])
        a, b, c = (" ".join(a), a), (" ".join(b), b), (" ".join(c), c)
        rows += [(k + 5, a[0]), (k + 5, b[0]), (k + 2, edit(b[1], 0)), (k + 9, edit(a[1], 59))]  # two texts of one id, each with a near copy
        rows += [(k + 6, None), (k + 6, "  "), (k + 6, c[0]), (k + 1, edit(c[1], 0)), (k + 3, None)]  # blank rows beside a real text
        rows += [(k + 5, a[0]), (k + 5, a[0].upper())]  # repeated rows, and a text with the same shingles
    r.shuffle(rows)
    got = minhash.near_duplicates(table(spark, rows).repartition(parts), words=4)
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id), x.kept) for x in got.collect()) == brute_components(rows, 4, 80)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(table(spark, []).limit(0)).count() == 0
    kept = minhash.keep_one_of_each(table(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (None, None)]))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"] and "bands" in kept.columns


# 3 Quality


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op3_quality(spark, sf).collect()}
    held = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in held)
    assert sum(got[r.doc_id].predicted == r.quality for r in held) / len(held) > 0.95


def test_quality_edges(spark, texts):
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i, _ in texts if i is not None] + [(None, 1)], "doc_id long, quality int")
    docs = table(spark, texts)
    got = quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = defaultdict(set)
    for r, (i, t) in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(texts, key=lambda x: str(x[0]))):
        by[t].add(r.score)
    assert all(len(s) == 1 for s in by.values())
    untaught = quality.fit_quality(docs, labels.limit(0))
    assert {r.score for r in quality.score_quality(docs, untaught).collect()} == {0.5}
    assert quality.keep_good(docs, untaught).columns == docs.columns and quality.keep_good(docs.limit(0), untaught).count() == 0


def test_quality_sample_is_bounded(spark, monkeypatch):
    """Repeated ids with many texts, and long texts, stay within the budget of documents and passages."""
    rows = [(1, f"text {k} " + "word " * 100) for k in range(50)] + [(1, "text 0 " + "word " * 100)] * 30 + [(i, "some words " * i) for i in range(2, 40)] + [(50, "long " * 64_000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen = []
    real = quality.AttentionModel.fit
    monkeypatch.setattr(quality.AttentionModel, "fit", lambda self, x, begin, y: seen.append((len(x), len(y))) or real(self, x, begin, y))
    docs = table(spark, rows)
    for limit, most in [(8000, 120_000), (8000, 60), (10, 120_000)]:
        quality.fit_quality(docs, labels, limit=limit, passage_limit=most, modulus=10**9)
        assert seen[-1][0] <= most and seen[-1][1] <= limit
    assert seen[0][1] == 50 + 38 + 1  # each distinct text once
    assert quality.fit_quality(docs, labels, passage_limit=0, modulus=10**9).known is False


def test_attention_gradient():
    r = np.random.default_rng(0)
    m = quality.AttentionModel()
    x, begin, y = r.normal(size=(7, quality.FEATURES)).astype(np.float32), np.array([0, 3, 7]), np.array([1.0, 0.0])
    loss = lambda: -np.mean(np.log(np.where(y == 1, s := m.forward(x, begin)["score"], 1 - s)))  # noqa: E731, F841
    g = m._gradients(x, begin, y)
    for k in ("W", "V", "U", "a", "u"):
        at = tuple(d // 2 for d in m.p[k].shape)
        m.p[k] = m.p[k].astype(np.float64)
        m.p[k][at] += 1e-4
        up = loss()
        m.p[k][at] -= 2e-4
        assert np.isclose((up - loss()) / 2e-4, g[k][at], rtol=0.02, atol=1e-4)
        m.p[k][at] += 1e-4


# 4 Substrings


def brute_repeats(rows, length):
    first = {}
    for i, t in rows:
        w = split(t)
        if i is not None:
            for j in range(len(w) - length + 1):
                key = tuple(w[j : j + length])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = split(t)
        gone = set()
        if i is not None:
            for j in range(len(w) - length + 1):
                if first[tuple(w[j : j + length])] < i:
                    gone |= set(range(j, j + length))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("shard,length,gram", [(8192, 50, 16), (3, 50, 16), (8192, 12, 4), (5, 12, 4)])
def test_repeats(spark, texts, monkeypatch, shard, length, gram):
    monkeypatch.setattr(substrings, "SHARD", shard)
    monkeypatch.setattr(substrings, "CROWD", shard)  # crowded anchors are cut into tiles
    got = substrings.remove_repeats(table(spark, texts), length=length, gram=gram)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == brute_repeats(texts, length)


def test_repeats_of_nothing_and_columns(spark, texts):
    docs = table(spark, texts)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0
    kept = substrings.keep_first_passages(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_fm_index_matching_statistics():
    r = random.Random(4)
    seqs = [[r.randrange(4) for _ in range(r.randint(3, 30))] for _ in range(30)]
    docs = np.array([r.randrange(10) for _ in seqs])
    flat = np.array([x for s in seqs for x in s], np.uint64)
    index = substrings.FMIndex(flat, np.array([len(s) for s in seqs]), docs)
    for _ in range(60):
        q = [r.randrange(5) for _ in range(r.randint(1, 12))]
        below = r.randrange(11)
        text = index.words(np.array(q, np.uint64))
        (got,) = index.match_starts(text, np.array([0]), np.array([len(q)]), np.array([below]))
        occurs = lambda p: any(d < below and any(s[i : i + len(p)] == p for i in range(len(s) - len(p) + 1)) for s, d in zip(seqs, docs))  # noqa: B023, E731
        assert got == next(s for s in range(len(q) + 1) if s == len(q) or occurs(q[s:]))


# 5 Licenses


def test_license_matches(spark):
    mit = licenses.TEMPLATES["MIT-text"].split()
    edited = " ".join(mit[:20] + ["foo", "bar"] + mit[22:50] + mit[53:])
    rows = [(1, "xx Released under the MIT license. zz"), (2, ""), (3, None), (4, "q " * 50 + edited + " end"), (5, licenses.TEMPLATES["Apache-2.0-notice"]), (6, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."), (7, "Ünïcode released UNDER the\nMIT License"), (None, "All rights reserved."), (8, "nothing of the kind " * 400)]
    got = defaultdict(list)
    for r in licenses.scan_licenses(table(spark, rows)).collect():
        text = dict((a, b) for a, b in rows)[r.doc_id]
        got[r.doc_id].append((r.license, text[r.start_char : r.end_char]))
        assert r.coverage >= 0.8
    assert got[1] == [("MIT", "Released under the MIT license")] and got[7] == [("MIT", "released UNDER the\nMIT License")]
    assert got[4] == [("MIT-text", edited.rstrip("."))] and [x[0] for x in got[5]] == ["Apache-2.0-notice"]
    assert len(got[6]) == 2 and got[None] == [("All-rights-reserved", "All rights reserved")] and not set(got) & {2, 3, 8}
    assert licenses.scan_licenses(table(spark, []).limit(0)).count() == 0


def test_license_notices_with_as_many_edits_as_coverage_allows(spark):
    edited = ["Released under MIT License", "Released under an MIT License", "All rights are reserved"]
    want = {0: "MIT", 1: "MIT", 2: "All-rights-reserved"}
    for name in ("MIT", "Apache-2.0", "Unlicense", "CC-BY-4.0"):
        w = licenses.TEMPLATES[name].replace(".", " ").replace(",", " ").split()
        least = math.ceil(0.8 * len(w))
        for gone in itertools.combinations(range(len(w)), len(w) - least):
            numbers = [np.arange(len(w), dtype=np.uint64), np.array([99 if i in gone else i for i in range(len(w))], np.uint64)]
            if licenses.align(*numbers, 0)[0] >= least:  # else the best stretch is too short: an end is cut off by its edits
                want[len(edited)] = name
                edited.append(" ".join("edit" if i in gone else x for i, x in enumerate(w)))
    assert len(want) > 50
    got = licenses.scan_licenses(table(spark, [(i, f"some words {t} and more") for i, t in enumerate(edited)])).collect()
    assert {r.doc_id: r.license for r in got} == want and len(got) == len(want)


def test_license_lines_are_all_found(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    lines = ["Licensed under CC BY-NC 4.0.", "General Public License, version 3.", "Apache License, Version 2.0.", "Released under the MIT License.", "All rights reserved."]
    want = {r.doc_id for r in docs.collect() if any(x in (r.text or "") for x in lines)}
    assert {r.doc_id for r in licenses.scan_licenses(docs).collect()} == want


def best_stretch(template, text):
    """Local alignment over the whole text by the full table: most matched words, first and last matched word, of the best stretch (match 2, passed over 1)."""
    n = len(text)
    score, matched, first = np.zeros(n + 1, int), np.zeros(n + 1, int), np.zeros(n + 1, int)
    best = (0, 0, 0, 0)
    for i in range(len(template)):
        s, m, f = np.zeros(n + 1, int), np.zeros(n + 1, int), np.zeros(n + 1, int)
        for j in range(1, n + 1):
            options = [(score[j] - 1, matched[j], first[j]), (s[j - 1] - 1, m[j - 1], f[j - 1]), (score[j - 1] - 2, matched[j - 1], first[j - 1]), (0, 0, 0)]
            if template[i] == text[j - 1]:
                options.append((score[j - 1] + 2, matched[j - 1] + 1, first[j - 1]) if score[j - 1] > 0 else (2, 1, j - 1))
            s[j], m[j], f[j] = max(options)
            if s[j] > best[0]:
                best = (s[j], m[j], f[j], j)
        score, matched, first = s, m, f
    return best[1:]


def test_license_spans_on_the_table(spark):
    """Each reported span is as well covered as told, and each template that covers a text by the full table lies in a reported span."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars < 2500")
    noted = [(10_000 + i, f"some words before {' '.join(t.split()[: len(t.split()) // 2] + ['edited'] + t.split()[len(t.split()) // 2 + 1 :])} and after") for i, t in enumerate(licenses.TEMPLATES.values())]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + noted
    got = defaultdict(list)
    for r in licenses.scan_licenses(table(spark, rows)).collect():
        got[r.doc_id].append(r)
    kept = re.compile(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+")
    words_of = lambda t: [(m.group().lower() if m.group().isascii() else m.group(), m.start(), m.end()) for m in kept.finditer(t)]
    templates = {n: [w for w, _, _ in words_of(t)] for n, t in licenses.TEMPLATES.items()}
    checked = 0
    for i, t in rows:
        for r in got[i]:
            inside = [w for w, a, b in words_of(t) if a >= r.start_char and b <= r.end_char]
            n, _, _ = best_stretch(templates[r.license], inside)
            assert n == r.matched_words and math.isclose(r.coverage, n / len(templates[r.license])) and r.coverage >= 0.8
            assert t[r.start_char : r.end_char].strip() == t[r.start_char : r.end_char]
        words = words_of(t)
        known = {w for ws in templates.values() for w in ws}
        if sum(w in known for w, _, _ in words) < 3:
            continue
        for name, want in templates.items():
            if len(set(want) & {w for w, _, _ in words}) < 0.8 * len(set(want)):
                continue
            n, lo, hi = best_stretch(want, [w for w, _, _ in words])
            if n >= 0.8 * len(want):
                checked += 1
                assert any(r.start_char <= words[lo][1] and words[hi - 1][2] <= r.end_char for r in got[i]), (i, name)
    assert checked >= len(licenses.TEMPLATES)


def test_license_templates_as_a_table(spark):
    rows = spark.createDataFrame([("own", "this text may be used by all and sundry"), (None, "x y z"), ("none", None)], "license string, text string")
    got = licenses.scan_licenses(table(spark, [(1, "so this text may be used by all and sundry, they say")]), rows).collect()
    assert [(r.license, r.coverage) for r in got] == [("own", 1.0)]
    with pytest.raises(ValueError):
        licenses.templates_of(rows.union(rows))


def test_alignment_against_full_table():
    """The band is wide enough here, so the banded score must be the best over all pairs."""
    r = random.Random(8)
    for _ in range(40):
        t = np.array([r.randrange(6) for _ in range(r.randint(3, 9))], np.uint64)
        p = np.array([r.randrange(6) for _ in range(r.randint(0, 9))], np.uint64)
        n, lo, hi = licenses.align(t, p, 0)
        best = [[0] * (len(p) + 1) for _ in range(len(t) + 1)]
        top = 0
        for i in range(1, len(t) + 1):
            for j in range(1, len(p) + 1):
                s = max(best[i - 1][j] - 1, best[i][j - 1] - 1, best[i - 1][j - 1] - 2, 0)
                best[i][j] = max(s, best[i - 1][j - 1] + 2) if t[i - 1] == p[j - 1] else s
                top = max(top, best[i][j])
        assert (n > 0) == (top > 0) and 0 <= lo <= hi <= len(p) and n <= min(len(t), hi - lo if n else 0) and 2 * n >= top


# 6 SentencePiece


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces.read_model())


def all_segmentations(model, text):
    edges = model.edges(" " + text)
    done = {0: [(0.0, ())]}
    for end in range(1, len(text) + 2):
        done[end] = [(a + s, x + ((i,) if i >= 0 else tuple(int(model.byte_ids[b]) for b in (" " + text)[start:end].encode()))) for start, i, s in edges[end] for a, x in done[start]]
    return sorted(done[len(text) + 1], key=lambda x: -x[0])


def test_n_best_against_all_segmentations(model):
    r = random.Random(2)
    some = ["the of in", "abc  de", "wörld\n▁x", " hi", "  ", "x", "Ñ é", "日本 y", "a\tb"] + ["".join(r.choice("thein o▁é🙂") for _ in range(r.randint(1, 10))) for _ in range(60)]
    columns = [c.to_pylist() for c in pieces.encode_slice(model, [*some, ""], 4, model.n_best)]
    for text, n, score, ids, same, more in zip(some, *columns):
        every = all_segmentations(model, text)
        assert same and len(ids) == n and np.allclose([score] + [m["score"] for m in more], [x[0] for x in every[:4]])
        known, seen = {x[1]: x[0] for x in every}, {tuple(ids)}
        for m in more:
            new = list(ids)
            for e in sorted(m["edits"], key=lambda e: -e["piece"]):
                new[e["piece"] : e["piece"] + e["drop"]] = e["ids"]
            assert tuple(new) not in seen and np.isclose(known[tuple(new)], m["score"])
            seen.add(tuple(new))
    assert columns[0][-1] == 0 and columns[4][-1] == []


def test_long_units(model):
    """Long parts are segmented one by one: the same result as in a crowd of parts, and bounded memory."""
    import resource

    r = random.Random(6)
    long = ["".join(r.choice("abcdefghijkl") for _ in range(700)), "日本語の文章と漢字" * 90, "=" * 900, "aGVsbG8" * 100]
    one = pieces.encode_slice(model, long, 3, model.n_best)
    for i, t in enumerate(long):
        best = model.n_best(" " + t, 3)
        assert one[2][i].as_py() == list(best[0][1]) and one[1][i].as_py() == best[0][0] and one[3][i].as_py()
        assert [m["score"] for m in one[4][i].as_py()] == [b[0] for b in best[1:]]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    (huge,) = pieces.encode_slice(model, ["".join(r.choice("0123456789abcdefABCDEF+/") for _ in range(200_000))], 3, model.n_best)[4].to_pylist()
    assert len(huge) == 2 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000


def test_fitting_scores_agree_with_the_library(model):
    import sentencepiece

    words = Counter(w for r in pa.parquet.read_table(f"{SMALL}/documents.parquet", columns=["text"]).column(0).to_pylist() if r for w in r.split())
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH).encode(list(words))
    own = pieces.encode_slice(model, list(words), 1, model.n_best)[2].to_pylist()
    assert sum(n for n, a, b in zip(words.values(), own, lib) if a == b) / sum(words.values()) > 0.8
    assert pieces.fitting_scores([("a", -1.5, "plain"), ("b", -2.0, "plain")]) == [("a", -1.5, "plain"), ("b", -2.0, "plain")]


def test_encode_and_decode(spark, texts):
    docs = table(spark, texts)
    got = pieces.encode(docs)
    assert all(r.round_trip for r in got.collect()) and got.count() == len(texts)
    back = sorted((str(r.doc_id), r.text) for r in pieces.decode(got).collect())
    assert back == sorted((str(i), t or "") for i, t in texts)
    assert pieces.encode(docs.limit(0)).count() == 0


# 7 WARC


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, tmp_path, least):
    html = ["<p>a</p>" * 9, "b", None, "", "<p>é</p>" * 2000, "b"]
    rows = [(i, f"http://x/{i}?q=ü\n", html[i % 6]) for i in range(40)] + [(39, "http://again", html[39 % 6]), (None, None, "lonely payload")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    archives = warc.write_warc(df, f"file://{tmp_path}/w", least_payload=least, file_bytes=3000)
    assert archives.count() > 1
    best = defaultdict(lambda: -1)
    for i, _, h in rows:
        best[h or ""] = max(best[h or ""], -1 if i is None else i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = best[h or ""]
        again = len(b) >= least and first >= 0 and first != i
        want.append((str(i), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", str(first if again else None)))
    for size in (64, 1000, 8 << 20):
        found = warc.read_warc(archives, split_bytes=size).where("record_type <> 'warcinfo'").collect()
        assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in found) == sorted(want)
    assert warc.read_warc(warc.write_warc(df.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_warc_false_magic_and_cut_off_members(tmp_path):
    one = warc.member([("WARC-Type", "response")], b"\r\n\r\nx" * 50)
    other = zlib.compressobj(9, zlib.DEFLATED, 31)
    noise = warc.MAGIC + b"garbage" + other.compress(b"no archive") + other.flush()
    data = noise + one + noise + one + one[: len(one) // 2]
    (tmp_path / "f").write_bytes(data)
    at = [len(noise), 2 * len(noise) + len(one)]
    for size in (1, 7, 50, 10_000):
        with pa.OSFile(str(tmp_path / "f")) as f:
            got = [o for s in range(0, len(data), size) for o, *_ in warc.records(f, s, min(s + size, len(data)))]
        assert got == at


def test_warc_skipped_bytes_are_counted(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"text {i} " * 50) for i in range(30)], "page_id long, url string, html string").repartition(1)
    archives = warc.write_warc(df, f"file://{tmp_path}/w")
    (path,) = [r.path.removeprefix("file://") for r in archives.collect()]
    whole = open(path, "rb").read()
    assert {r.skipped for r in warc.skipped_bytes(archives, warc.read_warc(archives, 1000)).collect()} == {0}
    at = whole.index(warc.MAGIC, 1000)
    broken = whole[:at] + b"\0" * 20 + whole[at + 20 : -7]  # a broken start, and a last member that is cut off
    open(path, "wb").write(broken)
    told = archives.withColumn("bytes", F.lit(len(broken)).cast("long"))
    found = warc.read_warc(told, 1000)
    assert found.count() == 29 and warc.skipped_bytes(told, found).first().skipped > 40


def test_warc_long_urls_are_read_and_lost_records_told(spark, tmp_path):
    urls = ["http://x/" + "a" * 100_000, "http://x/" + "ü" * 11_000, "http://x/" + "".join(random.Random(1).choices("0123456789abcdef", k=700_000)), "http://x/short"]
    df = spark.createDataFrame([(i, u, "same" if i < 2 else f"{i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    archives = warc.write_warc(df, f"file://{tmp_path}/w")
    for size in (1000, 8 << 20):
        found = warc.read_warc(archives, split_bytes=size)
        got = {r.page_id: r for r in found.where("record_type <> 'warcinfo'").collect()}
        assert {i: unquote(r.target_uri) for i, r in got.items()} == dict(enumerate(urls))
        assert got[0].record_type == "revisit" and got[0].refers_to == 1
    assert warc.all_read(archives, found).count() == archives.agg(F.sum("records")).first()[0]
    with pytest.raises(ValueError, match="records were lost"):
        warc.all_read(archives, found.where("page_id <> 1"))


# 8 SimHash


def brute_edits(spark, texts):
    """(id, n_chars, sha of the edited text, print, edited print, nearness to it and to the next) of each row."""
    hashes = {t: h for t, h in ((r.t, r.h) for r in spark.createDataFrame([(t or "",) for _, t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect())}
    rows = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1] or ""]))
    edited = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited.append(t[: len(t) - len(t) // 4] + after[: len(t) // 4])
    every = [(j, t) for j, t in enumerate([t for _, t in rows] + edited)]
    prints = {r.doc_id: r.fingerprint & (2**64 - 1) for r in spark.createDataFrame(every, "doc_id long, text string").transform(simhash.fingerprints).collect()}
    like = lambda a, b: 1 - bin(a ^ b).count("1") / 64
    n = len(rows)
    return [(i, len(t or ""), hashlib.sha256(e.encode()).hexdigest(), prints[k], prints[n + k], like(prints[k], prints[n + k]), like(prints[k], prints[(k + 1) % n])) for k, ((i, t), e) in enumerate(zip(rows, edited))]


def edit_rows(df):
    return sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in df.collect())


@pytest.mark.parametrize("ids", ["plain", "outlying", "repeated"])
def test_edit_check(spark, texts, ids):
    rows = [r for r in texts if len(r[1] or "") < 3000]
    if ids == "outlying":
        rows = [(10**18 if k == 5 else None if k % 3 == 0 else i, t) for k, (i, t) in enumerate(rows)]
    if ids == "repeated":
        rows += rows[:6] * 3 + [(None, None)] * 4
    want = sorted((str(i), n, sha, f"{p:016x}", f"{e:016x}", a, b) for i, n, sha, p, e, a, b in brute_edits(spark, rows))
    assert edit_rows(simhash.edit_check(table(spark, rows), per_bin=5)) == want


def test_edit_check_of_little(spark):
    assert simhash.edit_check(table(spark, []).limit(0)).count() == 0
    (one,) = simhash.edit_check(table(spark, [(1, "abcdefgh")])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0


def test_op8_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars < 4000")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_edits(spark, rows)
    near = lambda p: sum(bin(p ^ q[3]).count("1") <= 3 for q in want)
    full = sorted((str(i), n, sha, f"{p:016x}", f"{e:016x}", a, b, near(p) if i % 50 == 0 else None) for i, n, sha, p, e, a, b in want)
    got = simhash.op8_simhash(spark, f"file://{tmp_path}")
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, r.n_within) for r in got.collect()) == full


def test_fingerprint_is_the_weighted_vote(spark):
    text = "alpha beta beta gamma " * 2000 + "the of in"
    got = simhash.fingerprints(table(spark, [(1, text), (2, ""), (3, None), (4, " \n")])).collect()
    w = Counter(text.lower().split())
    hashes = {r.w: r.h for r in spark.createDataFrame([(x,) for x in w], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    votes = [sum((1 if hashes[x] >> b & 1 else -1) * n * min(7, max(1, len(x) - 2)) for x, n in w.items()) for b in range(64)]
    want = sum(1 << b for b in range(64) if votes[b] > 0)
    assert {r.doc_id: r.fingerprint & (2**64 - 1) for r in got} == {1: want, 2: 0, 3: 0, 4: 0}


@pytest.mark.parametrize("radius,blocks", [(3, 6), (2, 3), (5, 7)])
def test_within_radius(spark, radius, blocks):
    r = random.Random(3)
    prints = [r.getrandbits(64) for _ in range(30)]
    prints += [p ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 7))) for p in prints for _ in range(4)]
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed + signed[:5] + [None]], "fingerprint long")
    got = {(x.query, x.fingerprint, x.distance) for x in simhash.within_radius(df, df, radius, blocks).collect()}
    dist = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    assert got == {(a, b, dist(a, b)) for a in signed for b in signed if dist(a, b) <= radius}


# 9 Top-k


def test_top_k(spark):
    r = np.random.default_rng(2)
    v = np.round(r.normal(size=(400, 8)), 2)
    v[50:120] = v[7]  # ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(500, None), (501, [1.0, None]), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (504, []), (505, [0.5]), (None, v[0].tolist()), (7, v[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = sorted(map(tuple, topk.exact_top_k(df, df.where("vec_id % 50 = 0 OR vec_id IN (7, 505)"), 10).collect()))
    whole = {i: np.array(([math.floor(1024 * c) for c in x] + [0] * 8)[:8], np.int64) for i, x in rows if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)}
    want = []
    for q in [i for i in whole if i % 50 == 0 or i in (7, 505)]:
        best = sorted((-int(whole[q] @ x), i) for i, x in whole.items() if i != q)[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.exact_top_k(df.limit(0), df.limit(0)).count() == 0


def test_impact_index_alone():
    r = np.random.default_rng(0)
    v = (r.normal(size=(700, 24)) * 150).astype(int)
    v[100:300] = v[5]
    v[:, 3] = 7
    index = topk.ImpactIndex(np.arange(700), v)
    for q in range(25):
        ids, scores = index.search(q, v[q], 10)
        want = [i for i in np.lexsort((np.arange(700), -(v @ v[q]))) if i != q][:10]
        assert ids.tolist() == want and scores.tolist() == (v @ v[q])[want].tolist()
    assert len(index.search(-1, np.zeros(24, np.int64), 3)[0]) == 3


# 10 Mixing


def test_mixing_meets_its_weights(spark):
    rows = [(i, "x" * (10 if i % 3 else 40), f"s{i % 3}") for i in range(6000)]
    got = mixing.mix_sources(table(spark, rows), {"s0": 1, "s1": 2, "s2": 1}).groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()
    total = sum(r.n for r in got)
    share = {r.source: r.n / total for r in got}
    assert all(abs(share[s] - w) < 0.03 for s, w in {"s0": 0.25, "s1": 0.5, "s2": 0.25}.items())


def test_mixing_counts_are_poisson(spark):
    rows = [(i, "abcde", "big" if i % 4 else "small") for i in range(8000)]
    out = mixing.mix_sources(table(spark, rows)).groupBy("doc_id").agg(F.max("n_copies").alias("n"), F.count("*").alias("m"), F.first("rate").alias("rate")).collect()
    assert all(r.n == r.m for r in out)
    counts = Counter(r.n for r in out if r.rate > 1)
    assert abs(sum(n * c for n, c in counts.items()) / 2000 - 2) < 0.15 and abs(counts[1] / 2000 - 2 * math.exp(-2)) < 0.04


def test_mixing_edges(spark, texts):
    rows = [(i, t, None if (i or 0) % 4 == 0 else f"s{(i or 0) % 4}") for i, t in texts]
    docs = table(spark, rows)
    out = mixing.mix_sources(docs, scale=3.0)
    assert set(docs.columns) <= set(out.columns) and len(out.columns) == len(set(out.columns))
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mix_sources(docs.repartition(7), scale=3.0).collect()))
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    only = mixing.mix_sources(docs, {"s1": 1.0}).select("source").distinct().collect()
    assert {r.source for r in only} == {"s1"}


def test_mixing_large_rates_are_poisson(spark):
    # A derived table, grouped afterwards: the plan once failed to resolve here.
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("aa").alias("text"), F.lit("x").alias("source"))
    got = [r.n for r in mixing.mix_sources(docs, scale=2000.0).groupBy("doc_id").agg(F.first("n_copies").alias("n")).collect()]
    assert len(got) == 500 and abs(np.mean(got) - 2000) < 8 and abs(np.var(got) / 2000 - 1) < 0.15
    u = lambda i, *p: int(hashlib.md5("|".join(["mix-1", str(i), *p]).encode()).hexdigest()[:13], 16) / 2**52
    cdf = [math.exp(-500.0)]
    p = cdf[0]
    for k in range(1, 500 + int(12 * 500**0.5) + 41):
        p *= 500.0 / k
        cdf.append(cdf[-1] + p)
    want = sorted(sum(sum(c <= u(i, *part) for c in cdf) for part in [(), ("part", "2"), ("part", "3"), ("part", "4")]) for i in range(60))
    assert sorted(r.n_copies for r in mixing.mix_sources(docs.where("doc_id < 60"), scale=2000.0).where("copy_no = 1").collect()) == want


# SQL, and the pipeline


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    assert rows_of_spark(registry.QUERIES[name](spark, SMALL)) == rows_of(duck, registry.ORACLES[name])


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality", "near_dedup", "substring_dedup", "mix", "sentencepiece"]
    stage = dict(cp.STAGES)
    good = stage["quality"](spark, docs, SMALL)
    told = {r.doc_id: r.predicted for r in quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, p in told.items() if p == 1}
    single = stage["near_dedup"](spark, good, SMALL)
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in single.collect()} == {int(i) for i, _, c, _ in brute_components(rows, 5, 80) if i == c}
    cut = stage["substring_dedup"](spark, single, SMALL)
    left = {i: (n, gone, sha) for i, n, gone, sha in brute_repeats([(r.doc_id, r.text) for r in single.collect()], 50)}
    for r in cut.collect():
        assert hashlib.sha256(b" ".join(split(r.text))).hexdigest() == left[str(r.doc_id)][2]
    assert cut.count() == sum(1 for n, gone, _ in left.values() if gone < n or not n)
    mixed = stage["mix"](spark, cut, SMALL)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in cut.collect()}
    coded = stage["sentencepiece"](spark, mixed, SMALL)
    assert coded.count() == mixed.count() and all(r.round_trip for r in coded.select("round_trip").collect())
    for df in (good, single, cut):
        assert df.columns == docs.columns


# Columns of the documents that are named like those that stages work with, empty templates, crowded texts


def test_stage_columns_may_have_any_names(spark):
    from tidemark.llm.minhash import keep_one_of_each
    from tidemark.llm.quality import fit_quality, keep_good
    from tidemark.llm.substrings import keep_first_passages

    names = ["_key", "_name", "_source", "_parts", "_cdf", "_mean", "_gone", "_row", "row", "id", "name", "of", "parts", "mean", "cdf", "u", "gone", "kept", "class", "score", "predicted", "label", "words", "segment", "chars", "weight"]
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(i, text if i < 3 else f"{text} {i} " * 2, "a" if i % 2 else "b") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(names)])
    plain = df.select("doc_id", "text", "source")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    model = fit_quality(plain, labels)
    for stage in (keep_one_of_each, keep_first_passages, lambda d: keep_good(d, model), lambda d: mixing.mix_sources(d).drop("rate", "n_copies", "copy_no", "shuffle_key")):
        got = stage(df)
        assert got.columns == df.columns
        assert sorted(map(str, got.select("doc_id", "text", "source").collect())) == sorted(map(str, stage(plain).collect()))
        assert all(r[c] == f"x{i}" for r in got.collect() for i, c in enumerate(names))


def test_license_no_templates_match_nothing(spark):
    docs = table(spark, [(1, next(iter(licenses.TEMPLATES.values())))])
    none = spark.createDataFrame([], "license string, text string")
    assert licenses.scan_licenses(docs, none).count() == 0 and licenses.scan_licenses(docs, {}).count() == 0
    assert licenses.scan_licenses(docs).count() > 0


def test_license_matches_inside_better_ones():
    r = random.Random(12)
    for _ in range(200):
        found = [(r.randint(1, 6), r.randint(0, 2), lo := r.randint(0, 30), lo + r.randint(1, 12)) for _ in range(r.randint(0, 25))]
        found = sorted(set(found), key=lambda x: (-x[0], x[2], x[1]))
        taken = []
        for x in found:
            if not any(y[2] <= x[2] and x[3] <= y[3] for y in taken):
                taken.append(x)
        assert licenses.outermost(found) == taken


def test_license_thousands_of_notices_in_one_text(spark):
    notice = "this notice of eleven words is found again and again here"
    text = "\n".join(f"{notice} {i}" for i in range(20_000))
    got = licenses.scan_licenses(table(spark, [(1, text)]), {"N": notice}).collect()
    assert len(got) == 20_000 and all(text[r.start_char : r.end_char] == notice for r in got)


def test_warc_query_matches_its_sql(spark, duck):
    from tidemark.llm.shared import own_dir

    assert rows_of_spark(warc.op7_warc(spark, SMALL)) == rows_of(duck, warc.OP7_SQL)
    folder = own_dir(spark).removeprefix("file://")
    assert any(name.startswith("warc-") for name in os.listdir(folder))
