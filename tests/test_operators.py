"""Edge rules of filters, scopes, DML, evidence, metrics, streams."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import codecs, masking, numbers, similarity, validation
from tidemark.operators import dml, evaluation, evidence, governance, ports, scope, windows
from tidemark.operators.query import Query, page, safe_sort, snake
from tidemark.streaming import stateful


def test_optional_filters(spark):
    df = spark.range(10).withColumn("s", F.concat(F.lit("n"), "id"))
    assert Query(df).eq("id", None).in_("id", []).like("s", " ").between("id", 2, None).rows().count() == 8
    assert Query(df).in_("id", [], required=True).rows().count() == 0
    assert Query(df).eq("id", 3).one().count() == 1
    with pytest.raises(Exception, match="more than one row"):
        Query(df).one().collect()


def test_page_and_sort(spark):
    df = spark.range(25).withColumnRenamed("id", "row_id")
    p = page(df, 3, 10, [F.asc("row_id")])
    assert [r.row_id for r in p.rows.collect()] == [20, 21, 22, 23, 24] and p.total == 25
    assert page(df, 1, -1).rows.count() == 25
    with pytest.raises(ValueError):
        page(df, 1, 201)
    assert snake("rowId") == "row_id"
    assert safe_sort(df, [("rowId", "up"), ("x; drop", "asc")]).first().row_id == 24


def test_scope(spark):
    df = spark.createDataFrame([(1, 10, 7, 0), (2, 20, 8, 0), (3, 10, 9, 1)], "id int, dept int, usr int, deleted int")
    load = lambda name: df.withColumn("tenant", F.lit(1))
    ids = lambda s, **k: sorted(r.id for r in scope.Resolver(load, tenant=1, scope=s, tenant_cols={"t": "tenant"}, deleted_cols={"t": "deleted"}, dept_cols={"t": "dept"}, user_cols={"t": "usr"}, **k).table("t").collect())
    assert ids(scope.DataScope(everything=True)) == [1, 2]
    assert ids(scope.DataScope()) == []
    assert ids(scope.scope_of([(scope.DEPT_ONLY, frozenset()), (scope.SELF, frozenset())], 20, frozenset(), 7)) == [1, 2]
    assert ids(scope.scope_of([(scope.DEPT_AND_CHILD, frozenset())], None, frozenset({10}), 5)) == [1]
    with pytest.raises(ValueError):
        scope.Resolver(load, tenant_cols={"t": "tenant"}).table("t")


def test_update_keeps_what_is_null(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, x string, y int")
    update = spark.createDataFrame([(1, None, 9)], "id int, x string, y int")
    assert sorted(map(tuple, dml.update_by_id(base, update, "id").collect())) == [(1, "a", 9), (2, "b", 6)]


@pytest.mark.parametrize("n,limit", [(3, 5), (17, 5), (100, 7), (2, 2), (11, 10)])
def test_even_sample(spark, n, limit):
    got = sorted(r.id for r in windows.even_sample(spark.range(n).withColumn("k", F.lit(1)), ["k"], [F.asc("id")], limit).collect())
    want = list(range(n)) if n <= limit else sorted({int(i * (n - 1) / (limit - 1) + 0.5) for i in range(limit)})
    assert got == want


def test_masks_keep_length(spark):
    random.seed(1)
    rows = [("x" * random.randint(0, 15),) for _ in range(30)]
    df = spark.createDataFrame(rows, "s string")
    for name in masking.PRESETS:
        assert all(len(r.s) == len(r.m) for r in df.select("s", masking.preset(F.col("s"), name).alias("m")).collect())
    got = spark.createDataFrame([("13248765917",)], "s string").select(masking.preset(F.col("s"), "mobile").alias("m")).first().m
    assert got == "132****5917"


def test_validation_and_codecs(spark):
    df = spark.createDataFrame([("13800138000",), ("abc",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(validation.mobile(F.col("s"))).collect()] == [True, False, True, True]
    paths = spark.createDataFrame([("a/b.txt",), ("/a",), ("a//b",), ("a/../b",), ("c:x",), ("a\\b",)], "s string")
    assert [r[0] for r in paths.select(validation.safe_path(F.col("s"))).collect()] == [True] + [False] * 5
    key = "0123456789abcdef"
    assert [r[0] for r in df.select(codecs.decrypt(codecs.encrypt(F.col("s"), key), key)).collect()] == ["13800138000", "abc", "", None]


def test_distance_and_totals(spark):
    one = spark.range(1)
    assert one.select(numbers.distance_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("d")).first().d == round(3.141592653589793 * 6378.137, 4)
    assert one.select(numbers.scaled_total(F.lit(10), F.lit(3), F.lit(80)).alias("d")).first().d == 0


CASES = [  # gold, result, claims, recall5, mrr, ndcg5
    ([], [1, 2], [], 1.0, 1.0, 1.0),
    ([1], [], [], 0.0, 0.0, 0.0),
    ([1, None], [None, 2, 1], [], 1.0, 0.5, 0.6309),
    ([9], [1, 2, 3, 4, 5, 9], [], 0.0, 0.1667, 0.0),
    ([1], [1, 1], [], 1.0, 1.0, 1.0),
]


@pytest.mark.parametrize("gold,result,claims,recall,mrr,ndcg", CASES)
def test_metrics(spark, gold, result, claims, recall, mrr, ndcg):
    df = spark.createDataFrame([(1, gold, result, claims)], "id int, gold array<bigint>, result array<bigint>, claims array<struct<verdict: string, evidence: int>>")
    m = evaluation.metrics(df, ["id"]).first()
    assert (m.recall5, m.mrr, m.ndcg5) == (recall, mrr, ndcg)
    assert m.faithfulness == m.hallucination == m.citation == 0.0


def test_gate_at_the_threshold(spark):
    claims = [("SUPPORTED", 0)] * 49 + [("UNSUPPORTED", -1)]
    df = spark.createDataFrame([(1, [1], [1], claims)], "id int, gold array<bigint>, result array<bigint>, claims array<struct<verdict: string, evidence: int>>")
    assert evaluation.gate(df, ["id"]).first().passed


def _alike(a, b):
    from collections import Counter

    a, b = "".join(a.split()).lower(), "".join(b.split()).lower()
    if not a and not b:
        return 1.0
    return 2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b)) if a and b else 0.0


def test_evidence_dedup_is_greedy(spark):
    random.seed(3)
    rows = [(q, p, p, "".join(random.choice("abcd ") for _ in range(random.randint(0, 12))), random.random(), [random.choice(["bm25", "vector"])]) for q in range(8) for p in range(12)]
    df = spark.createDataFrame(rows, "q int, pos int, chunk_id int, content string, score double, channels array<string>")
    got = evidence.deduplicate(df, ["q"]).collect()
    for q in range(8):
        kept = []
        for _, p, _, text, score, ch in [x for x in rows if x[0] == q]:
            hit = next((k for k in kept if _alike(k[1], text) >= 0.85), None)
            if hit:
                hit[2], hit[3] = max(hit[2], score), list(dict.fromkeys(hit[3] + ch))
            else:
                kept.append([p, text, score, list(ch)])
        assert sorted((k.pos, k.chunk_id, k.score, k.channels) for k in got if k.q == q) == [(p, p, s, c) for p, _, s, c in kept]
    assert evidence.deduplicate(df.limit(0), ["q"]).count() == 0


def test_similarities(spark):
    df = spark.createDataFrame([(1, "", ""), (2, "a", ""), (3, "A b", "ab"), (4, "aab", "ab")], "id int, a string, b string")
    got = {r.id: round(r.similarity, 4) for r in similarity.multiset(df, ["id"], "a", "b").collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 1.0, 4: 0.8}
    assert [r[0] for r in df.orderBy("id").select(similarity.jaccard(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 0.25, 1.0]


def test_rules_and_versions(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "id int, x int")
    got = governance.apply_rules(df, [("a", 1, "x > 1", "A"), ("b", 2, "x > 4", "B")], ["id"]).collect()
    assert [tuple(r) for r in got] == [(1, "b", "B")]
    v = spark.createDataFrame([("V2",), ("V10",), ("draft",)], "n string")
    assert v.agg(governance.next_version(F.col("n")).alias("n")).first().n == "V11"


def test_retry():
    tries = []
    with pytest.raises(ValueError):
        ports.with_retry(lambda: tries.append(1) or (_ for _ in ()).throw(ValueError()), wait_ms=0)
    assert len(tries) == 2


def _events(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", i % 2, i % 5 == 0) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, ts string, k int, bad boolean").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return df


def test_stream_ingest_and_dead_letters(spark, tmp_path):
    df = _events(spark, tmp_path)
    stream = stateful.parquet_stream(spark, str(tmp_path / "in"), df.schema)
    q = stateful.ingest(stream, lambda b: b.withColumn("done", F.lit(1)), str(tmp_path / "good"), str(tmp_path / "dead"), str(tmp_path / "c"), F.col("bad"))
    assert q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 16 and spark.read.parquet(str(tmp_path / "dead")).count() == 4


def test_stream_twins(spark, tmp_path):
    df = _events(spark, tmp_path)
    stream = stateful.parquet_stream(spark, str(tmp_path / "in"), df.schema)
    q = stateful.idempotent(stream, ["k"], "ts", "10 minutes").writeStream.format("memory").queryName("idem").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {r.k for r in spark.table("idem").collect()} == {0, 1}
    assert stateful.sessions(df, ["k"], "ts", "3 minutes").count() == 2


def test_redelivery(spark):
    sent = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:00"), (3, "2024-01-01 00:09:00")], "message_id int, delivered_at string").withColumn("delivered_at", F.to_timestamp("delivered_at"))
    acks = spark.createDataFrame([(2,)], "message_id int")
    assert [r.message_id for r in stateful.pending(sent, acks, F.to_timestamp(F.lit("2024-01-01 00:10:00"))).collect()] == [1]


def test_deep_trees_are_whole(spark):
    """A chain of 100 nodes below a bushy top, a missing parent, and a cycle."""
    from tidemark.functions import tree

    rows = [(i, i - 1, f"n{i}") for i in range(1, 101)] + [(200 + i, 50, "") for i in range(3)] + [(300, 999, "orphan")]
    nodes = spark.createDataFrame(rows, "id long, parent_id long, name string")
    got = {r.id: r.path for r in tree.paths(nodes, separator="/").collect()}
    assert got == {i: "/".join(f"n{k}" for k in range(1, i + 1)) for i in range(1, 101)} | {200 + i: "/".join(f"n{k}" for k in range(1, 51)) for i in range(3)}
    assert {r.id for r in scope.enabled_tree(nodes, enabled=F.col("id") != 70).collect()} == set(range(1, 70)) | {200, 201, 202}
    closure = {(r.root, r.node, r.depth) for r in scope.descendants(nodes, nodes.where("id IN (1, 40, 300)")).collect()}
    assert closure == {(1, i, i - 1) for i in range(1, 101)} | {(1, 200 + i, 50) for i in range(3)} | {(40, i, i - 40) for i in range(40, 101)} | {(40, 200 + i, 11) for i in range(3)} | {(300, 300, 0)}
    assert not tree.has_cycle(nodes)
    looped = nodes.unionByName(spark.createDataFrame([(500, 501, "a"), (501, 500, "b")], nodes.schema))
    assert tree.has_cycle(looped) and 500 not in {r.id for r in tree.paths(looped).collect()}
    with pytest.raises(ValueError):
        scope.descendants(looped, looped)


def test_bm25_in_blocks_and_passes(spark, monkeypatch):
    """Small blocks, several passes and string ids give the rows of one block; Chinese terms are pairs."""
    from tidemark.operators import retrieval

    r = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    rows = [(f"d{i:02d}", i, " ".join(r.choices(words, k=r.randint(0, 25)))) for i in range(70)] + [("zh", 70, "知识库 检索"), ("none", 71, None)]
    docs = spark.createDataFrame(rows, "name string, chunk_id long, content string")
    queries = spark.createDataFrame([(q, " ".join(r.choices(words, k=4))) for q in range(9)] + [(9, "知识"), (10, "unknown"), (11, None)], "query_id int, query string")
    whole = retrieval.bm25_top_k(docs, queries, 5).collect()
    assert [x.chunk_id for x in whole if x.query_id == 9] == [70] and not [x for x in whole if x.query_id > 9]
    monkeypatch.setattr(retrieval, "ASKED", 7)
    monkeypatch.setattr(retrieval, "TEXTS", 8)
    monkeypatch.setattr(retrieval, "QUESTIONS", 2)
    assert sorted(map(tuple, retrieval.bm25_top_k(docs, queries, 5).collect())) == sorted(map(tuple, whole))
    named = retrieval.bm25_top_k(docs, queries, 5, id_col="name").collect()
    ids = {n: i for n, i, _ in rows}
    assert sorted((x.query_id, ids[x.chunk_id], x.score) for x in named if x.rank < 5) == sorted((x.query_id, x.chunk_id, x.score) for x in whole if x.rank < 5)
    assert retrieval.bm25_top_k(docs.limit(0), queries).count() == 0


def test_publish_overwrites_its_versions_only(spark, tmp_path):
    from tidemark.operators import chat, index

    rows = [(i, i % 3, 1, 1, f"text {i}", [1.0, float(i)], "DRAFT") for i in range(9)]
    chunks = spark.createDataFrame(rows, "chunk_id long, version_id long, tenant_id int, kb_id int, content string, embedding array<double>, status string")
    folder = f"file://{tmp_path}/index"
    index.publish(spark, chunks.where("version_id < 2"), folder)
    index.publish(spark, chunks.where("version_id = 1 AND chunk_id > 1").withColumn("content", F.lit("new")), folder)
    got = {r.chunk_id: (r.content, r.status) for r in spark.read.parquet(f"{folder}/chunks").collect()}
    assert got == {0: ("text 0", "PUBLISHED"), 3: ("text 3", "PUBLISHED"), 6: ("text 6", "PUBLISHED"), 4: ("new", "PUBLISHED"), 7: ("new", "PUBLISHED")}
    entries = spark.read.parquet(f"{folder}/entries")
    assert index.visible(spark.read.parquet(f"{folder}/chunks"), entries).count() == 5 == spark.read.parquet(f"{folder}/vectors").count()
    chat.append(chunks, f"{tmp_path}/log", 4)
    chat.append(chunks, f"{tmp_path}/log", 4)
    assert spark.read.parquet(f"{tmp_path}/log").count() == 18
    with pytest.raises(ValueError):
        index.row_ids(spark.createDataFrame([(1, 10**6, None)], "g long, pos long, parent_pos long"), "g")


def test_allow_list_and_paths(spark):
    from tidemark.functions import strings

    html = [
        ('<p style="color:red" onclick="x()">a<script>alert(1)</script></p>', '<p style="color:red">a</p>'),
        ('<a href="javascript:alert(1)" target=_blank>x</a><a HREF=\'https://y\'>y</a>', "<a target=_blank>x</a><a HREF='https://y'>y</a>"),
        ('<IMG SRC="data:image/png;base64,xx" onerror=y><iframe src="http://z">in</iframe><!-- no -->', '<img SRC="data:image/png;base64,xx">in'),
        ("1 < 2 <b>bold</b><font>f</font>", "1 &lt; 2 <b>bold</b>f"),
        (None, ""),
    ]
    got = spark.createDataFrame(html, "h string, want string").select(strings.clean_html(F.col("h")).alias("h"), "want").collect()
    assert [(r.h, r.want) for r in got] == [(r.want, r.want) for r in got]
    paths = {"a/b.txt": True, "/a": False, "a\\b": False, "C:a": False, "a/../b": False, "a//b": False, "./a": False, "": False, "a.b/..c": True, "a\0b": False}
    df = spark.createDataFrame([(p,) for p in paths] + [(None,)], "p string")
    assert {r.p: r.s for r in df.select("p", strings.safe_path(F.col("p")).alias("s")).collect()} == paths | {None: False}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.createDataFrame([("1,x",)], "c string").select(strings.split_numbers(F.col("c"))).collect()


def test_idempotency_of_a_hot_key_over_batches(spark):
    r = random.Random(4)
    rows = [(r.choice(["hot", "hot", "a", "b"]), i, r.randrange(10**6)) for i in range(3000)]
    events = spark.createDataFrame(rows, "k string, id long, s long").select("k", "id", F.timestamp_seconds("s").alias("ts"))
    want = []
    last = {}
    for k, i, s in sorted(rows, key=lambda x: (x[0], x[2], x[1])):
        if k not in last or s - last[k] >= 5000:
            last[k] = s
            want.append((k, i))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = stateful.idempotent_batch(events, ["k"], "ts", "id", 5000).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((x.k, x.id) for x in got) == sorted(want)


def test_evidence_dedup_with_null_keys_and_positions(spark):
    rows = [(None, 1, 10, 0.5, ["a"], "the same words here"), (None, 2, 11, 0.9, ["b"], "the same words here"), (1, None, 12, 0.1, ["c"], "the same words here"), (1, 3, 13, 0.2, None, "the same words here"), (1, 4, 14, 0.3, ["d"], None), (2, None, 15, 0.4, [], "")]
    df = spark.createDataFrame(rows, "q int, pos int, chunk_id int, score double, channels array<string>, content string")
    got = {(r.q, r.pos): (r.chunk_id, r.score, r.channels) for r in evidence.deduplicate(df, ["q"]).collect()}
    assert got == {(None, 1): (10, 0.9, ["a", "b"]), (1, 3): (13, 0.2, ["c"]), (1, 4): (14, 0.3, ["d"]), (2, None): (15, 0.4, [])}


def test_listed_tables(spark):
    rows = [("b_user", "people"), ("a_user", None), ("act_user", "flows"), ("QRTZ_user", ""), ("sys$user", "x"), ("ACTOR_user", "people"), ("all_", "people")]
    df = spark.createDataFrame(rows, "name string, comment string")
    names = lambda *a: [r.name for r in governance.listed_tables(df, *a).collect()]
    assert names() == ["ACTOR_user", "a_user", "all_", "b_user"]
    assert names("user", "people") == ["ACTOR_user", "b_user"] and names("", "") == names()


def test_the_first_of_repeated_cases_counts(spark):
    cases = spark.createDataFrame([(1, 10, "first"), (1, 11, "again"), (2, 12, "other"), (None, 13, "none")], "case_id int, id int, name string")
    assert sorted(r.name for r in windows.first_per_key(cases.where("case_id IS NOT NULL"), ["case_id"], F.asc("id")).collect()) == ["first", "other"]
