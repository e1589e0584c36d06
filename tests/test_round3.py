"""Queries on odd rows against their SQL, and totals without pairs against brute force."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of, rows_of_spark
from tidemark.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def same_as_sql(spark, folder, name, **tables):
    """Whether the query gives its SQL's rows on these frames."""
    duck = duckdb.connect()
    duck.execute("SET TimeZone = 'UTC'")
    for k, frame in tables.items():
        frame.write.parquet(f"{folder}/{k}.parquet")
        duck.execute(f"CREATE VIEW {k} AS SELECT * FROM '{folder}/{k}.parquet/*.parquet'")
    assert rows_of_spark(QUERIES[name](spark, f"{folder}")) == rows_of(duck, ORACLES[name])


def test_triage_looks_at_the_text_as_it_is(spark, tmp_path):
    """Without "th" a text lost its "er", and what stood around it met: "eern" held "en", "eerr" held "er"."""
    texts = ["eern", "eerr", "th er", "er", "th", "then", "erther en", None, "", "ther", "eerrn en"]
    rows = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "conv_id long, turn int, text string")
    same_as_sql(spark, tmp_path, "keyword_triage", conversations=rows)


@pytest.mark.parametrize("parts", [1, 7])
def test_deliveries_are_counted_without_pairs(spark, parts, monkeypatch):
    from tidemark.streaming import stateful

    r = random.Random(parts)
    told = [(r.choice(["a", "b", "c", None]), i, r.choice([None, *range(-5, 60)]), r.choice([None, None, *range(-5, 60)])) for i in range(200)]
    sent = [(r.choice(["a", "b", "d", None]), i * 10**14, r.choice([None, *range(50)])) for i in range(400)]
    subscriptions = spark.createDataFrame(told, "channel string, subscriber long, since int, until int").repartition(parts)
    messages = spark.createDataFrame(sent, "topic string, message_id long, at int").repartition(parts)
    monkeypatch.setattr(stateful, "published", None)  # the pairs
    want = {}
    for c, i, since, until in told:
        held = [m for t, m, at in sent if None not in (c, t, at, since) and t == c and since <= at and (until is None or at < until)]
        want[i] = (len(held), sum(held))
    got = stateful.delivered(messages, subscriptions, "topic", "at", {"total": "message_id"})
    assert {x.subscriber: (x.n, x.total) for x in got.collect()} == want


@pytest.mark.parametrize("kind", ["long", "double"])
def test_points_get_totals_without_pairs(spark, kind):
    from tidemark.operators.ranges import totals_of_points

    r = random.Random(4)
    spans = [(i, lo := r.randrange(-500, 500), lo + r.choice([0, 1, 5, 40, 300])) for i in range(120)]
    spans += [(2**61, -(2**40), 2**40), (-3, 7, 7), (-3, 7, 7), (203, 9, 8), (204, None, 5), (205, 5, None), (None, 0, 9)]
    at = [(i, r.randrange(-700, 700)) for i in range(400)] + [(i, 7) for i in range(1000, 1300)] + [(2000, None), (2001, 2**41)]
    points = spark.createDataFrame([(i, None if v is None else float(v) if kind == "double" else v) for i, v in at], f"id int, v {kind}").repartition(3)
    got = totals_of_points(points, "v", spark.createDataFrame(spans, "area long, lo long, hi long"), "lo", "hi", {"total": "area"})
    want = []
    for i, v in at:
        held = [a for a, lo, hi in spans if None not in (v, lo, hi) and lo <= v <= hi]
        want.append((i, len(held), sum(a or 0 for a in held)))
    assert got.columns == ["id", "v", "n", "total"]
    assert sorted((x.id, x.n, x.total) for x in got.collect()) == want


def test_items_of_one_name_meet_the_rows_once(spark, tmp_path):
    """3000 items of a base have two names: 50 rows that ask for it are not paired with all of them."""
    from tidemark.operators import governance

    asked = spark.createDataFrame([(i, [1, 2, 1, None]) for i in range(50)], "k int, bases array<long>")
    items = spark.createDataFrame([(1, p, f"n{p % 2}") for p in range(3000, 0, -1)] + [(2, 5, "n0"), (2, 6, "z"), (2, 7, " "), (2, 8, None)], "base long, pos int, name string")
    got = governance.distinct_union(asked, items, "k", "bases", "base", "pos", "name")
    got.write.format("noop").mode("overwrite").save()
    assert sorted(tuple(x) for x in got.collect()) == sorted(row for i in range(50) for row in [(i, 1, 1, "n1"), (i, 2, 1, "n0"), (i, 3, 2, "z")])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2  # the base's items first, then the rows' own


def test_blocks_of_long_texts_are_bounded(spark, tmp_path, monkeypatch):
    """TEXTS long texts were one block, whose postings a task held at once."""
    from tidemark.operators import postings, retrieval

    monkeypatch.setattr(postings, "POSTINGS", 4000)
    r = random.Random(9)
    texts = [(i, " ".join(f"w{r.randrange(600)}" for _ in range(300))) for i in range(200)]
    rows = spark.createDataFrame(texts, "chunk_id long, content string")
    queries = spark.createDataFrame([(1, "w1 w2 w70"), (2, "w5")], "query_id long, query string")
    index = postings.Postings(spark, f"file://{tmp_path}/index")
    key = lambda found: sorted(map(str, found.select("query_id", "chunk_id", "score", "rank").collect()))
    want = key(retrieval.bm25_top_k(rows, queries, 7))
    for change in (lambda: index.upsert(rows), index.merge):
        version = change()
        held = spark.read.parquet(f"{index.folder}/postings").where(F.col("segment") == version).groupBy("block").agg(F.sum("n").alias("n"))
        assert held.agg(F.max("n")).first()[0] < 3 * 4000
        assert key(index.search(queries, 7)) == want


def test_elements_are_enriched_without_a_shuffle(spark):
    from tidemark.operators import enrich

    r, rows = random.Random(3), []
    for i in range(60):
        listed = []
        for p in range(r.choice([0, 1, 2, 40, 90])):
            kind = r.choice(["heading", "image", "paragraph", "paragraph", None])
            listed.append((p, kind, r.choice([None, 0, 1, 2, 3, 6, 7]) if kind == "heading" else None, r.choice([None, "", " ", "ab", "x. y", "a longer text", "é"])))
        rows.append((i, listed))
    df = spark.createDataFrame(rows, "id int, elements array<struct<pos:int,kind:string,level:int,text:string>>")
    titled, pictured = enrich.title_chains(df, "elements"), enrich.image_contexts(df, "elements", 12, ".")
    for made in (titled, pictured):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    said, titles = {}, {}
    for i, listed in rows:
        held, before, told = [None] * 6, "", []
        for p, kind, level, text in listed:
            if kind == "heading":
                before = ""
                if level and level <= 6:
                    held = [*held[: level - 1], text, *[None] * (6 - level)]
            told.append(None if kind in ("heading", None) else [t for t in held if t is not None])
            if kind == "image":
                s = before[-12:]
                cut = s.find(".")
                said[i, p] = (s[cut + 1 :] if cut > 0 and len(s) - cut < 6 else s).strip()
            if kind not in ("heading", None) and (text or "").strip(" "):
                before += text + "\n"
        titles[i] = told
    assert {x.id: [e.titles for e in x.elements] for x in titled.collect()} == titles
    assert {(x.id, x.pos): x.context for x in pictured.collect()} == said
