"""Line dedup against brute force."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tests.conftest import SMALL, rows_of, rows_of_spark
from tidemark.llm import lines

SPACES = " \t\n\x0b\x0c\r"
#: Names that the operator's own columns have.
CLASHING = ["document", "t", "at", "h", "key", "lost", "row", "n_lines", "n_dropped", "line", "n", "first", "z", "k"]


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, min_chars=10, min_docs=2):
    """A null id is one document after all others."""
    order = lambda i: (i is None, i or 0)
    where = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            where[ascii_lower(x.strip(SPACES))].add(order(i))
    out = []
    for i, t in rows:
        parts, kept = (t or "").split("\n"), []
        for x in parts:
            k = ascii_lower(x.strip(SPACES))
            if not (len(k) >= min_chars and len(where[k]) >= min_docs and min(where[k]) != order(i)):
                kept.append(x)
        out.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return out


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit(n).alias(c) for n, c in enumerate(CLASHING)])


def result(df):
    return sorted(map(str, df.select("row.doc_id", "n_lines", "n_dropped", "text").collect()))


def expected(rows, **more):
    from pyspark.sql import Row

    return sorted(str(Row(doc_id=i, n_lines=n, n_dropped=d, text=t)) for i, n, d, t in brute(rows, **more))


def test_lines_match_brute_force(spark):
    r = random.Random(3)
    pool = ["a footer that returns", "A Footer THAT returns  ", "\tÄrger mit Ümlauten", "ärger mit Ümlauten", "short", "exactly 10", "exactly10", "", "\x1cno white space", " nor is this a space", "\x0b\x0cpage two of many\r"]
    rows = [(i, "\n".join(r.choice(pool) if r.random() < 0.6 else f"own line {r.random()}" for _ in range(r.randint(1, 12)))) for i in range(-5, 60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "one\n" * 4000 + "a footer that returns"), (None, "a footer that returns\nonly without an id"), (None, "only without an id\nown"), (7, rows[3][1]), rows[12], rows[12]]
    r.shuffle(rows)
    assert result(lines.drop_repeated_lines(table(spark, rows))) == expected(rows)
    assert result(lines.drop_repeated_lines(table(spark, rows), min_chars=3, min_docs=5)) == expected(rows, min_chars=3, min_docs=5)


def test_a_line_that_most_documents_have(spark):
    rows = [(i, f"own words of number {i}\nthe same line everywhere\nthe same line everywhere") for i in range(3000)]
    got = {r.doc_id: r.n_dropped for r in lines.drop_repeated_lines(table(spark, rows)).select("row.doc_id", "n_dropped").collect()}
    assert got == {i: 0 if i == 0 else 2 for i in range(3000)}


def test_other_columns_stay(spark):
    (r,) = lines.drop_repeated_lines(table(spark, [(1, "x")])).collect()
    assert r.row.asDict() == {"doc_id": 1, "text": "x"} | {c: n for n, c in enumerate(CLASHING)}


def test_no_documents(spark):
    assert lines.drop_repeated_lines(table(spark, [(1, "x")]).where("false")).count() == 0


def test_query_matches_its_sql(spark, duck):
    df = lines.op13_line_dedup(spark, SMALL)
    assert rows_of_spark(df) == rows_of(duck, lines.OP13_SQL)
    assert df.where("n_dropped > 0").count() > 0


def test_no_python_runs(spark):
    plan = lines.op13_line_dedup(spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hash_of_kept_text(spark):
    got = lines.op13_line_dedup(spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, _, _, t in brute(list(texts.items()))}
    assert {r.doc_id: r.kept_sha256 for r in got} == want
