"""Token alignment against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.llm import alignment

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.BYTE_MODEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_MODEL)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(x): x for x in plain} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in plain)}
    a_bytes = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return a, b, a_bytes, b_bytes


def brute(rows, models):
    """COLUMNS, and the links, of each row."""
    a_model, b_model, a_bytes, b_bytes = models
    found, counts = [], Counter()
    for i, t in rows:
        a, b = (a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t)) if t else ([], [])
        if t and not b"".join(map(a_bytes, a)) == b"".join(map(b_bytes, b)) == (" " + t).encode():
            a, b = [], []
        ends = [np.cumsum([0, *map(len, map(f, ids))]).tolist() for f, ids in ((a_bytes, a), (b_bytes, b))]
        links, j = [], 0
        for k in range(len(a)):
            while ends[1][j + 1] <= ends[0][k]:
                j += 1
            m = j
            while m < len(b) and ends[1][m] < ends[0][k + 1]:
                links.append((a[k], b[m], k, m))
                m += 1
        common = sorted(set(ends[0][1:]) & set(ends[1][1:]))
        groups, p, q = [], 0, 0
        for e in common:
            x, y = ends[0].index(e), ends[1].index(e)
            groups.append(",".join(map(str, a[p:x])) + "|" + ",".join(map(str, b[q:y])))
            p, q = x, y
        counts.update(x[:2] for x in links)
        found.append((i, a, b, common, links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [((i, len(a), len(b), len(c), len(ls), sum(counts[x[:2]] == best[x[1]] for x in ls), sum(counts[x[:2]] for x in ls), sha), a, b, ls) for i, a, b, c, ls, sha in found]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    vocabulary = ["the", "Haus", "Ünïcode", "naïve", "😀👨‍👩‍👧", "x" * 30, "don't", "1234567", "中文字", "don’t", "<|endoftext|>", "</s>", "<s>", "▁", "\t\t", "  ", "\n\n\n", "token", "ization", "ﬁ", "é", "​", "\x00", "\r\n", "<0x41>"]
    out = [(i, r.choice(["", " ", "\n"]).join(r.choice(vocabulary) for _ in range(r.randint(1, 60)))) for i in range(150)]
    out += [(200, None), (201, ""), (202, " "), (203, "    "), (204, "a"), (205, "word " * 30000), (None, "without an id"), (7, "again"), (7, "again"), (206, "é" * 5000)]
    return out


def clashing(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("row", "slice", "pair", "pairs", "links", "n_a", "facts", "code", "pos"):
        df = df.withColumn(c, F.lit("x"))
    return df


def result(df):
    return sorted(map(str, (tuple(r) for r in df.select(COLUMNS).collect())))


@pytest.mark.parametrize(("bytes_at_once", "links"), [(1 << 22, 1 << 21), (3000, 100)])
def test_alignment_matches_brute_force(spark, rows, models, monkeypatch, bytes_at_once, links):
    monkeypatch.setattr(alignment, "_SLICE", bytes_at_once)
    monkeypatch.setattr(alignment, "_LINKS", links)
    some = rows if links > 100 else [x for x in rows if len(x[1] or "") < 5000]
    assert result(alignment.alignment_facts(clashing(spark, some))) == sorted(str(x[0]) for x in brute(some, models))


def test_tokens_and_ranges(spark, rows, models):
    some = [x for x in rows if len(x[1] or "") < 5000]
    got = alignment.align_tokens(clashing(spark, some)).collect()
    links = lambda r: [(k, m) for k, (x, y) in enumerate(zip(r.first, r.last)) for m in range(x, y + 1)]
    key = lambda x: (str(x[0]), x[1], x[2], x[3])
    assert sorted(((r.doc_id, r.a_ids, r.b_ids, links(r), sum(r.common)) for r in got), key=key) == sorted(((x[0][0], x[1], x[2], [y[2:] for y in x[3]], x[0][3]) for x in brute(some, models)), key=key)


def test_gallop_finds_places():
    r = np.random.default_rng(2)
    for n, m in [(0, 5), (5, 0), (1, 1), (3, 1000), (64, 65), (100, 3), (777, 5000)]:
        short, long = (np.sort(r.choice(8000, k, replace=False)) for k in (n, m))
        assert alignment.gallop(short, long).tolist() == np.searchsorted(long, short).tolist()


def test_ranks_of_texts_with_either_list_shorter():
    r = np.random.default_rng(3)
    a, b, a_n, b_n, base = [], [], [], [], 0
    for _ in range(60):
        size = int(r.integers(1, 80))
        for out, count in ((a, a_n), (b, b_n)):
            ends = np.append(np.sort(r.choice(np.arange(1, size), int(r.integers(0, size)), replace=False)), size) if size > 1 else np.array([1])
            out.extend((base + ends).tolist())
            count.append(len(ends))
        base += size
        a_n.append(0), b_n.append(0)  # a text without tokens
    bounds = [np.concatenate([[0], np.cumsum(n)]) for n in (a_n, b_n)]
    below, common = alignment.ranks(np.array(a), np.array(b), *bounds)
    assert below.tolist() == np.searchsorted(b, a).tolist() and common.tolist() == np.isin(a, b).tolist()


def test_the_quick_tokenizer_gives_the_files_ids():
    m = alignment.ByteTokens(alignment.BYTE_MODEL)
    r = random.Random(6)
    vocabulary = [b.decode("utf-8", "ignore") for b in m.bytes.values()]
    pools = ["abcdefgh ", "etaoinshrdlu ETAOIN", "äöüßéñ abc", " \t\n\r\x0b\x85\xa0 a", "0123456789 ", "'sdmtlvre' ", "中文字漢あい", "😀👨‍👩‍👧‍﻿\x00\x1c", "!?.,;:-_()[]{}<>|"]
    texts = [" " + "".join(r.choice(vocabulary) for _ in range(r.randint(1, 30))) for _ in range(5000)] + [" " + "".join(r.choice(r.choice(pools)) for _ in range(r.randint(1, 60))) for _ in range(5000)] + [" " + "".join(r.choice(p) for _ in range(60)) for p in pools for _ in range(300)]
    assert [m.quick.encode_ordinary(t) for t in texts] == [e.ids for e in m.slow.encode_batch_fast(texts, add_special_tokens=False)]


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment_facts(empty).count() == 0 and alignment.align_tokens(empty).count() == 0


def test_query_on_all_documents(spark, models):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = result(alignment.op11_token_alignment(spark, SMALL))
    assert got == sorted(str(x[0]) for x in brute(texts, models))
