"""Index, enrichment, conversations, records and string helpers over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions import strings
from tidemark.operators import chat, dml, enrich, evaluation, index, retrieval
from tidemark.plans.q_retrieval import _TOKENS, _docs
from tidemark.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# The index


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks of ten versions; every third has no vector."""
    vector = F.when(F.col("doc_id") % 3 != 0, F.array(F.col("n_chars").cast("double"), F.lit(1.0)))
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 10).alias("version_id"), F.lit(1).alias("tenant_id"), (F.col("doc_id") % 4).alias("kb_id"), F.coalesce("text", F.lit("")).alias("content"), vector.alias("embedding"), F.lit("DRAFT").alias("status"))


def _indexed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What was indexed before: versions 0 to 4, with old texts."""
    old = _chunks(spark, d).where("version_id < 5").withColumn("content", F.concat(F.lit("old "), F.substring("content", 1, 30)))
    return index.entries_of(old), index.vectors_of(old)


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_id % 10 IN (3, 7)").select((F.col("doc_id") % 10).alias("version_id")).distinct()


_CHUNKS = "c AS (SELECT doc_id AS chunk_id, doc_id % 10 AS version_id, coalesce(text, '') AS content, doc_id % 3 <> 0 AS has_vector FROM documents)"


@query("WITH old AS (SELECT doc_id AS chunk_id, 'old' AS content FROM documents WHERE doc_id % 2 = 0), fresh AS (SELECT doc_id AS chunk_id, CASE WHEN n_chars % 2 = 0 THEN 'second ' ELSE 'first ' END || coalesce(text, '') AS content FROM documents WHERE doc_id % 3 = 0) SELECT chunk_id, md5(content) AS content_md5 FROM fresh UNION ALL SELECT chunk_id, md5(content) FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM fresh)")
def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a key of the index replace it; of two rows with one key the later counts."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"), "n_chars")
    old = docs.where("chunk_id % 2 = 0").select("chunk_id", F.lit("old").alias("content"))
    fresh = docs.where("chunk_id % 3 = 0")
    first = fresh.select("chunk_id", F.concat(F.lit("first "), "text").alias("content"), F.lit(1).alias("seq"))
    second = fresh.where("n_chars % 2 = 0").select("chunk_id", F.concat(F.lit("second "), "text").alias("content"), F.lit(2).alias("seq"))
    out = index.upsert(old, first.unionByName(second), ["chunk_id"], F.col("seq"))
    return out.select("chunk_id", F.md5("content").alias("content_md5"))


@query(f"WITH {_CHUNKS} SELECT c.chunk_id, CASE WHEN version_id IN (3, 7) THEN md5(content) WHEN version_id < 5 THEN md5('old ' || left(content, 30)) END AS entry_md5, has_vector AND (version_id < 5 OR version_id = 7) AS in_vectors, CASE WHEN version_id IN (3, 7) THEN 'PUBLISHED' ELSE 'DRAFT' END AS status FROM c")
def index_version(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    return _index_state(chunks, *index.index_version(chunks, *_indexed(spark, d), _versions(spark, d)))


@query(f"WITH {_CHUNKS} SELECT c.chunk_id, CASE WHEN version_id IN (0, 1, 2, 4) THEN md5('old ' || left(content, 30)) END AS entry_md5, has_vector AND version_id IN (0, 1, 2, 4) AS in_vectors, CASE WHEN version_id IN (3, 7) THEN 'DISABLED' ELSE 'DRAFT' END AS status FROM c")
def delete_version_index(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    return _index_state(chunks, *index.delete_version_index(chunks, *_indexed(spark, d), _versions(spark, d)))


def _index_state(chunks: DataFrame, entries: DataFrame, vectors: DataFrame, after: DataFrame) -> DataFrame:
    state = after.select("chunk_id", "status").join(entries.select("chunk_id", F.md5("content").alias("entry_md5")), "chunk_id", "left")
    return state.join(vectors.select("chunk_id", F.lit(True).alias("v")), "chunk_id", "left").select("chunk_id", "entry_md5", F.coalesce("v", F.lit(False)).alias("in_vectors"), "status")


@query(f"WITH {_CHUNKS} SELECT chunk_id, length(content) AS chars FROM c WHERE version_id IN (3, 7) AND chunk_id % 20 <> 3")
def index_visible(spark: SparkSession, d: str) -> DataFrame:
    """What a search may see: of the indexed versions the published chunks, after some were deleted by key."""
    chunks = _chunks(spark, d)
    entries, _, after = index.index_version(chunks, *_indexed(spark, d), _versions(spark, d))
    entries = index.delete_keys(entries, chunks.where("chunk_id % 20 = 3").select("chunk_id"), ["chunk_id"])
    return index.visible(after, entries).select("chunk_id", F.length("content").cast("long").alias("chars"))


@query("SELECT conv_id * 1000000 + turn AS chunk_id, CASE WHEN turn % 3 <> 0 THEN conv_id * 1000000 + turn - turn % 3 END AS parent_id FROM conversations")
def chunk_row_ids(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("pos"), F.when(F.col("turn") % 3 != 0, F.col("turn") - F.col("turn") % 3).cast("long").alias("parent_pos"))
    return index.row_ids(turns, "conv_id").select("chunk_id", "parent_id")


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS deleted FROM events")
def soft_delete_rows(spark: SparkSession, d: str) -> DataFrame:
    return dml.soft_delete(table(spark, d, "events").select("event_id"), F.col("event_id") % 7 == 0)


# Search


@query("SELECT user_id, event_id, CASE WHEN user_id % 5 = 0 THEN 'EMPTY' WHEN event_id % 3 = 0 AND event_id % 4 NOT IN (user_id % 4, (user_id + 1) % 4) THEN 'EMPTY' WHEN event_type = 'click' THEN 'BLOCKED' ELSE 'SEARCH' END AS state FROM events")
def search_gate(spark: SparkSession, d: str) -> DataFrame:
    """Users see two bases, every fifth none; every third request names one base."""
    u, e = F.col("user_id"), F.col("event_id")
    visible = F.when(u % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array((u % 4).cast("long"), ((u + 1) % 4).cast("long")))
    asked = F.when(e % 3 == 0, F.array((e % 4).cast("long")))
    intent = F.when(F.col("event_type") == "click", "OUT_OF_SCOPE").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("user_id", "event_id", retrieval.gate(visible, asked, intent).alias("state"))


_VARIANTS = f"""v AS (SELECT item_id AS query_id, 0 AS variant, text FROM benchmark UNION ALL SELECT item_id, 1, left(text, 40) FROM benchmark UNION ALL SELECT item_id, 2, right(text, 60) FROM benchmark),
w AS (SELECT doc_id, {_TOKENS.format('text')} AS words FROM documents), st AS (SELECT count(*) AS n, avg(len(words)) AS a FROM w),
qt AS (SELECT query_id, variant, unnest(list_distinct({_TOKENS.format('text')})) AS term FROM v), po AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(words) AS len, unnest(words) AS term FROM w) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
fr AS (SELECT term, count(*) AS df FROM po GROUP BY 1), sc AS (SELECT query_id, variant, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a))), 6) AS score FROM po JOIN qt USING (term) JOIN fr USING (term), st GROUP BY 1, 2, 3),
bm AS (SELECT query_id, variant, doc_id AS chunk_id, score, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 20),
b AS (SELECT query_id, chunk_id, max(score) AS score, min(variant * 1000 + rank) AS seen FROM bm GROUP BY 1, 2)"""


@query(f"WITH {_VARIANTS} SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY seen, chunk_id) AS INTEGER) AS rank FROM b")
def variant_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Each question, its start and its end are searched; ranks are by first appearance, scores the best."""
    n = F.length("text")
    variants = F.array("text", F.substring("text", 1, 40), F.substring("text", F.greatest(n - 59, F.lit(1)), F.lit(60)))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), variants.alias("variants"))
    return retrieval.fan_out(_docs(spark, d), asked).select("query_id", "chunk_id", "score", "rank")


@query("""WITH c AS (SELECT user_id AS query_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank, count(*) OVER (PARTITION BY user_id) AS n FROM events),
s AS (SELECT *, CASE query_id % 3 WHEN 0 THEN 'model' WHEN 1 THEN 'judge' ELSE 'order' END AS rung, CASE query_id % 3 WHEN 0 THEN CAST(rank % 5 AS DOUBLE) WHEN 1 THEN CAST(rank % 7 AS DOUBLE) ELSE 0.0::DOUBLE END AS rerank_score FROM c)
SELECT query_id, event_id, rung, rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS INTEGER) AS place FROM s QUALIFY place <= 5""")
def rerank_ladder(spark: SparkSession, d: str) -> DataFrame:
    """A third of the users get fitting model scores, a third a judge's text, a third neither."""
    from pyspark.sql import Window

    listed = table(spark, d, "events").select(F.col("user_id").alias("query_id"), "event_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("event_id")))
    counts = listed.groupBy("query_id").agg(F.count("*").cast("int").alias("n"))
    ranks = F.sequence(F.lit(1), F.col("n"))
    model = F.when(F.col("query_id") % 3 == 0, F.transform(ranks, lambda r: (r % 5).cast("double"))).otherwise(F.array(F.lit(1.0)))
    model = F.when((F.col("query_id") % 3 != 0) & (F.col("n") == 1), F.lit(None)).otherwise(model)
    judge = F.when(F.col("query_id") % 3 == 1, F.concat(F.lit("scores: "), F.to_json(F.transform(ranks, lambda r: r % 7)), F.lit(" as asked"))).otherwise("none, sorry")
    out = retrieval.rerank_ladder(listed, counts.select("query_id", model.alias("model"), judge.alias("judge")), 5)
    return out.select("query_id", "event_id", "rung", "rerank_score", "place")


# Enrichment

_ELEMENTS = """l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS t, generate_subscripts(string_split(coalesce(text, ''), ' '), 1) - 1 AS pos FROM documents),
e AS (SELECT doc_id, pos, CASE WHEN pos % 17 = 0 THEN 'heading' WHEN pos % 11 = 5 THEN 'image' ELSE 'paragraph' END AS kind, CASE WHEN pos % 17 = 0 THEN 1 + (pos // 17 * 2) % 3 END AS level, t FROM l)"""


def _elements(spark: SparkSession, d: str) -> DataFrame:
    """Each word of a document as an element: headings of three levels, images and paragraphs."""

    def element(t: Column, i: Column) -> Column:
        kind = F.when(i % 17 == 0, "heading").when(i % 11 == 5, "image").otherwise("paragraph")
        level = F.when(i % 17 == 0, 1 + (F.floor(i / 17) * 2) % 3).cast("int")
        return F.struct(i.alias("pos"), kind.alias("kind"), level.alias("level"), t.alias("text"))

    # As the one row of an explode they are made once, not wherever they are used.
    return table(spark, d, "documents").select("doc_id", F.explode(F.array(F.transform(F.split(F.coalesce("text", F.lit("")), " "), element))).alias("elements"))


@query(f"""WITH {_ELEMENTS}, h AS (SELECT *, last_value(CASE WHEN level = 1 THEN pos END IGNORE NULLS) OVER w AS p1, last_value(CASE WHEN level = 2 THEN pos END IGNORE NULLS) OVER w AS p2, last_value(CASE WHEN level = 3 THEN pos END IGNORE NULLS) OVER w AS p3,
 last_value(CASE WHEN level = 1 THEN t END IGNORE NULLS) OVER w AS t1, last_value(CASE WHEN level = 2 THEN t END IGNORE NULLS) OVER w AS t2, last_value(CASE WHEN level = 3 THEN t END IGNORE NULLS) OVER w AS t3 FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
k AS (SELECT doc_id, pos, kind, concat_ws('>', t1, CASE WHEN p2 > coalesce(p1, -1) THEN t2 END, CASE WHEN p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN t3 END) AS chain FROM h)
SELECT doc_id, count(*) AS n, md5(string_agg(chain, '|' ORDER BY pos)) AS chains_md5 FROM k WHERE kind <> 'heading' GROUP BY doc_id""")
def enrich_titles(spark: SparkSession, d: str) -> DataFrame:
    others = F.filter("elements", lambda e: e["kind"] != "heading")
    rows = enrich.title_chains(_elements(spark, d), "elements").select("doc_id", F.explode(F.array(F.transform(others, lambda e: F.array_join(e["titles"], ">")))).alias("chains"))
    return rows.select("doc_id", F.size("chains").cast("long").alias("n"), F.md5(F.array_join("chains", "|")).alias("chains_md5")).where("n > 0")


@query(f"""WITH {_ELEMENTS}, s AS (SELECT *, sum(CAST(kind = 'heading' AS INT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM e),
r AS (SELECT *, coalesce(string_agg(CASE WHEN kind <> 'heading' AND trim(t) <> '' THEN t || chr(10) END, '') OVER (PARTITION BY doc_id, section ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS said FROM s),
k AS (SELECT doc_id, pos, right(said, 60) AS x FROM r WHERE kind = 'image'),
c AS (SELECT doc_id, pos, CASE WHEN instr(x, '.') > 1 AND length(x) - instr(x, '.') + 1 < 30 THEN substr(x, instr(x, '.') + 1) ELSE x END AS y FROM k)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5(regexp_replace(y, '^\\s+|\\s+$', '', 'g')) AS context_md5 FROM c""")
def enrich_images(spark: SparkSession, d: str) -> DataFrame:
    rows = enrich.image_contexts(_elements(spark, d), "elements", limit=60, stop=".")
    return rows.select("doc_id", "pos", F.md5("context").alias("context_md5"))


# Conversations


@query("""WITH m AS (SELECT conv_id, turn, turn = 3 AND conv_id % 4 = 0 AS closes, contains(text, 'z') AS manual, length(text) % 5 = 0 AS missing, length(text) % 2 = 0 AS good FROM conversations),
c AS (SELECT *, coalesce(bool_or(closes) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS closed FROM m),
r AS (SELECT *, CASE WHEN closed THEN 'IGNORED' WHEN manual THEN 'TRANSFER' WHEN missing THEN 'CLARIFY' WHEN good THEN 'ANSWER' ELSE 'TRANSFER' END AS route FROM c)
SELECT conv_id, turn, route, NOT closed AS stored, coalesce(bool_or(route = 'TRANSFER') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS transferred FROM r""")
def chat_routes(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    out = chat.route_messages(table(spark, d, "conversations"), "conv_id", "turn", (F.col("turn") == 3) & (F.col("conv_id") % 4 == 0), F.col("text").contains("z"), n % 5 == 0, n % 2 == 0)
    return out.select("conv_id", "turn", "route", "stored", "transferred")


@query("""SELECT event_id, CASE WHEN event_id % 5 >= 3 OR event_id % 7 = 0 THEN NULL ELSE event_type || (event_id % 5) END AS answer, CASE WHEN event_id % 7 = 0 THEN 1 ELSE least(event_id % 5 + 1, 3) END AS attempts,
event_id % 5 >= 3 OR event_id % 7 = 0 AS claim_fail FROM events""")
def generate_verify(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in's answer n is supported from a row's own attempt on; every seventh row fails to generate."""
    e = F.col("event_id")
    generate = lambda n: F.when(e % 7 != 0, F.concat("event_type", n.cast("string")))
    verify = lambda answer, n: F.when((n == 0) & (e % 5 == 1), F.lit(None)).otherwise(n >= e % 5)
    out = chat.generate_and_verify(table(spark, d, "events").select("event_id", "event_type"), "event_id", generate, verify)
    return out.select("event_id", "answer", F.col("attempts").cast("long").alias("attempts"), "claim_fail")


def _evaluations(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation as an evaluation: its turns are the evidence, the first two in conflict in every third, the last cited."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    pair = "array<struct<a: int, b: int>>"
    conflicts = F.when(F.col("conv_id") % 3 == 0, F.array(F.struct(F.lit(0).alias("a"), F.lit(1).alias("b")))).otherwise(F.array().cast(pair))
    evidence = F.transform("t", lambda x: F.struct(x["turn"].cast("long").alias("chunk_id"), (F.length(x["text"]) / 100.0).alias("score")))
    claims = F.array(F.struct((F.size("t") - 1).alias("evidence"), F.lit("SUPPORTED").alias("verdict")), F.struct(F.lit(0).alias("evidence"), F.lit("UNSUPPORTED").alias("verdict")))
    return c.select(F.col("conv_id").alias("trace_id"), F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("query"), (F.col("conv_id") % 2 == 0).alias("answerable"), (F.col("conv_id") % 130 / 100.0).alias("confidence"), F.lit(None).cast("string").alias("refusal_reason"), evidence.alias("evidence"), conflicts.alias("conflicts"), claims.alias("claims"), F.when(F.col("conv_id") % 4 != 0, "ok").alias("answer"), (F.col("conv_id") % 5 == 0).alias("claim_fail"))


@query("SELECT conv_id AS trace_id, md5(left(string_agg(text, ' ' ORDER BY turn), 500)) AS query_md5, CAST(conv_id % 2 = 0 AS INTEGER) AS answerable, CAST(round(least(conv_id % 130 / 100.0, 1) * 10000) AS BIGINT) AS confidence, CAST(count(*) AS INTEGER) AS evidence_count, CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END AS conflict_count, CAST(conv_id % 4 <> 0 AND conv_id % 5 <> 0 AS INTEGER) AS claim_pass FROM conversations GROUP BY conv_id")
def evaluation_records(spark: SparkSession, d: str) -> DataFrame:
    out = chat.evaluation_records(_evaluations(spark, d))
    return out.select("trace_id", F.md5("query").alias("query_md5"), "answerable", (F.col("confidence") * 10000).cast("long").alias("confidence"), "evidence_count", "conflict_count", "claim_pass")


@query("""WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id AS trace_id, CAST(i AS INTEGER) AS pos, CAST(turn AS BIGINT) AS chunk_id, CASE WHEN conv_id % 3 = 0 AND i < 2 THEN 'WARN' WHEN conv_id % 4 <> 0 AND i = n - 1 THEN 'SUPPORTED' ELSE 'WARN' END AS verdict FROM t""")
def evidence_records(spark: SparkSession, d: str) -> DataFrame:
    return chat.evidence_records(_evaluations(spark, d)).select("trace_id", "pos", "chunk_id", "verdict")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE CAST(event_id % 3 AS INTEGER) END AS attempt, CASE WHEN event_id % 4 = 0 THEN 0 ELSE CAST(floor(value) AS INTEGER) END AS prompt_tokens, CASE WHEN event_id % 2 = 0 THEN length(left(repeat(event_type, 120), 500)) END AS error_chars FROM events")
def audit_log(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    calls = table(spark, d, "events").select("event_id", F.when(e % 3 != 0, (e % 3).cast("int")).alias("attempt"), F.when(e % 4 != 0, F.floor("value").cast("int")).alias("prompt_tokens"), F.when(e % 2 == 0, F.repeat("event_type", F.lit(120))).alias("error_msg"))
    return chat.audit_rows(calls).select("event_id", "attempt", "prompt_tokens", F.length("error_msg").cast("long").alias("error_chars"))


@query("SELECT e.event_id AS feedback_id, md5(c.text) AS question_md5 FROM events e JOIN conversations c ON c.conv_id * 100 + c.turn = e.user_id * 100 + e.event_id % 8 WHERE e.event_type = 'click'")
def feedback_cases(spark: SparkSession, d: str) -> DataFrame:
    """Clicks stand for thumbs down, turns for messages."""
    feedback = table(spark, d, "events").select(F.col("event_id").alias("feedback_id"), (F.col("user_id") * 100 + F.col("event_id") % 8).alias("message_id"), F.when(F.col("event_type") == "click", "thumb_down").otherwise("thumb_up").alias("type"))
    messages = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("message_id"), F.col("text").alias("content"))
    return chat.cases_from_feedback(feedback, messages).select("feedback_id", F.md5("question").alias("question_md5"))


@query("""WITH x AS (SELECT doc_id, doc_id % 6 AS kb_id, trim(coalesce(text, '')) AS q FROM documents),
i AS (SELECT kb_id, doc_id, q, unnest([doc_id, doc_id + 1, doc_id - 6]) AS g, unnest([1, 2, 3]) AS n FROM x WHERE kb_id <> 5 AND q <> '' AND doc_id % 9 <> 0)
SELECT i.kb_id, i.doc_id AS proposal_id, md5(left(q, 500)) AS question_md5, string_agg(CAST(g AS VARCHAR), ',' ORDER BY n) AS gold FROM i JOIN documents d ON d.doc_id = g AND g % 2 = 0 AND g % 6 = i.kb_id GROUP BY 1, 2, 3""")
def auto_cases(spark: SparkSession, d: str) -> DataFrame:
    """Base 5 has cases enough; even documents are the sample; every ninth proposal has a blank answer."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 6).alias("kb_id"), F.coalesce("text", F.lit("")).alias("text"))
    proposals = docs.select("kb_id", F.col("doc_id").alias("proposal_id"), F.col("text").alias("question"), F.when(F.col("doc_id") % 9 == 0, "  ").otherwise("yes").alias("gold_answer"), F.array(F.col("doc_id"), F.col("doc_id") + 1, F.col("doc_id") - 6).alias("gold_chunks"))
    sampled = docs.where("doc_id % 2 = 0").select("kb_id", F.col("doc_id").alias("chunk_id"))
    out = chat.accepted_cases(proposals, sampled, docs.where("kb_id = 5").select("kb_id"))
    return out.select("kb_id", "proposal_id", F.md5("question").alias("question_md5"), F.array_join("gold_chunks", ",").alias("gold"))


@query("SELECT user_id, count(*) AS cases, count(*) FILTER (WHERE event_id % 6 <> 0) AS with_metrics, CAST(avg(CASE WHEN event_id % 6 <> 0 THEN CAST(event_id % 2 AS DOUBLE) END) * 1000000 AS BIGINT) AS recall_micros FROM events GROUP BY user_id")
def skip_failed(spark: SparkSession, d: str) -> DataFrame:
    """Results whose run failed count as cases and have no metrics."""
    e = F.col("event_id")
    results = table(spark, d, "events").select("user_id", "event_id", F.when(e % 6 == 0, "timeout").when(e % 6 == 1, " ").alias("fail_reason"), F.array(F.lit(1).cast("long")).alias("gold"), F.array((e % 2).cast("long")).alias("result"), F.array().cast("array<struct<verdict: string, evidence: int>>").alias("claims"))
    measured = evaluation.metrics(evaluation.without_failed(results), ["event_id"]).select("event_id", "recall5")
    joined = results.join(measured, "event_id", "left").groupBy("user_id").agg(F.count("*").alias("cases"), F.count("recall5").alias("with_metrics"), F.avg("recall5").alias("r"))
    return joined.select("user_id", "cases", "with_metrics", F.round(F.col("r") * 1000000).cast("long").alias("recall_micros"))


# Strings


@query("""SELECT doc_id, coalesce(starts_with(text, 'De') OR starts_with(text, 'The') OR starts_with(text, 'l'), false) AS led, CAST(list_sum(list_transform(range(1, doc_id % 5 + 1), lambda i: i * doc_id)) AS BIGINT) AS total,
md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT contains(x, 'er')), chr(10))) AS without_md5 FROM documents""")
def string_helpers(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.functions.masking import remove_lines_containing

    listed = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 5), lambda i: F.when(i > 0, (i * F.col("doc_id")).cast("string")).otherwise("")), " , ")
    parsed = F.aggregate(strings.split_numbers(listed), F.lit(None).cast("long"), lambda a, x: F.coalesce(a, F.lit(0).cast("long")) + x)
    return table(spark, d, "documents").select("doc_id", strings.starts_with_any(F.col("text"), ["De", "The", "l"]).alias("led"), parsed.alias("total"), F.md5(remove_lines_containing(F.col("text"), "er")).alias("without_md5"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN '/' || regexp_replace(url, '^[a-z]+://', '') WHEN 1 THEN regexp_replace(url, '^[a-z]+://', '') || '/../x' WHEN 2 THEN 'C:' || url WHEN 3 THEN 'a\\b' WHEN 4 THEN 'a//b' ELSE 'x/' || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/+$', '') END AS path FROM pages)
SELECT page_id, coalesce(path <> '' AND NOT starts_with(path, '/') AND NOT contains(path, chr(92)) AND NOT regexp_matches(path, '^[A-Za-z]:') AND len(list_filter(string_split(path, '/'), lambda s: s IN ('', '.', '..'))) = 0, false) AS safe FROM p""")
def path_safety(spark: SparkSession, d: str) -> DataFrame:
    bare, m = F.regexp_replace("url", "^[a-z]+://", ""), F.col("page_id") % 7
    path = F.when(m == 0, F.concat(F.lit("/"), bare)).when(m == 1, F.concat(bare, F.lit("/../x"))).when(m == 2, F.concat(F.lit("C:"), "url")).when(m == 3, "a\\b").when(m == 4, "a//b").otherwise(F.concat(F.lit("x/"), F.regexp_replace(bare, "/+$", "")))
    return table(spark, d, "pages").select("page_id", strings.safe_path(path).alias("safe"))


@query("SELECT event_id, md5('pay' || CAST(event_id % 10 AS VARCHAR)) AS by_call, md5('pay' || CAST(event_id % 10 AS VARCHAR) || CAST(user_id AS VARCHAR)) AS by_user FROM events")
def key_resolve(spark: SparkSession, d: str) -> DataFrame:
    args = (F.col("event_id") % 10).cast("string")
    return table(spark, d, "events").select("event_id", strings.resolved_key(F.lit("pay"), args).alias("by_call"), strings.resolved_key(F.lit("pay"), args, F.col("user_id")).alias("by_user"))


_PROFILED = {"events": ["event_id", "user_id", "event_type", "value"], "documents": ["doc_id", "text", "lang", "source", "n_chars"], "labels": ["doc_id", "quality", "toxic"]}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {i} AS position, count(*) AS n_rows, count(*) - count({c}) AS n_nulls FROM {t}" for t, cs in _PROFILED.items() for i, c in enumerate(cs, 1)))
def table_profile(spark: SparkSession, d: str) -> DataFrame:
    """The listed tables' columns, with rows and nulls."""
    parts = [strings.profile(strings.common_columns(table(spark, d, t), cs), t) for t, cs in _PROFILED.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(None)
def html_balanced(spark: SparkSession, d: str) -> DataFrame:
    """Pages with allowed tags alone, well nested."""
    from tidemark.functions.html import balanced_html

    return table(spark, d, "pages").select("page_id", balanced_html(F.col("html")).alias("safe"))


@query(r"""WITH h AS (SELECT page_id, regexp_replace(coalesce(html, ''), '<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>|<title[^>]*>.*?</title\s*>|<noscript[^>]*>.*?</noscript\s*>|<!--.*?-->|<![^>]*>', '', 'gis') AS x FROM pages),
p AS (SELECT page_id, regexp_extract_all(x, '</?[A-Za-z][^>]*>|[^<]+|<', 0, 's') AS pieces FROM h),
k AS (SELECT page_id, list_filter(pieces, lambda t: t[1] <> '<' OR t = '<') AS texts, list_filter(list_transform(pieces, lambda t: lower(regexp_extract(t, '^</?([A-Za-z][A-Za-z0-9]*)', 1))), lambda n: n IN ('a','b','blockquote','br','caption','cite','code','col','colgroup','dd','div','dl','dt','em','h1','h2','h3','h4','h5','h6','i','img','li','ol','p','pre','q','small','span','strike','strong','sub','sup','table','tbody','td','tfoot','th','thead','tr','u','ul')) AS tags FROM p)
SELECT page_id, md5(array_to_string(list_transform(texts, lambda t: CASE WHEN t = '<' THEN '&lt;' ELSE t END), '')) AS text_md5, CAST(len(tags) AS BIGINT) AS n_tags FROM k""")
def html_allowlist(spark: SparkSession, d: str) -> DataFrame:
    """Of the cleaned pages the text between the tags, and how many tags were kept."""
    cleaned = table(spark, d, "pages").select("page_id", strings.clean_html(F.col("html")).alias("h"))
    return cleaned.select("page_id", F.md5(F.regexp_replace("h", "<[^>]*>", "")).alias("text_md5"), F.regexp_count("h", F.lit("<[^>]*>")).cast("long").alias("n_tags"))
