"""Parsing, chunking and search; documents stand for the knowledge base, benchmark texts for questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.functions import text
from tidemark.functions.text import trim
from tidemark.operators import chunking, clusters, retrieval, windows
from tidemark.operators.postings import Postings
from tidemark.session import working_folder
from tidemark.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({0}, '([。！？.!?])', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
_PACK = """list_reduce(list_prepend({{'cur': '', 'out': CAST([] AS VARCHAR[])}}, list_transform({0}, lambda z: {{'cur': z, 'out': CAST([] AS VARCHAR[])}})),
 lambda a, x: CASE WHEN a.cur <> '' AND ceil(length(a.cur) / 1.5) + ceil(length(x.cur) / 1.5) > {1} THEN {{'cur': x.cur, 'out': list_append(a.out, a.cur)}} ELSE {{'cur': a.cur || x.cur, 'out': a.out}} END)"""


@query(r"SELECT doc_id, CAST(len(p) AS BIGINT) AS parts, md5(array_to_string(p, '|')) AS parts_md5 FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS p FROM documents)")
def parse_plain(spark: SparkSession, d: str) -> DataFrame:
    p = F.transform(chunking.parse_plain(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))), lambda e: e["text"])
    return table(spark, d, "documents").select("doc_id", F.size(p).cast("long").alias("parts"), F.md5(F.array_join(p, "|")).alias("parts_md5"))


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    """Each document as Markdown: its source and language are headings, every line a paragraph."""
    body = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n"))
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("# "), F.col("source"), F.lit("\n\n## "), F.col("lang"), F.lit("\n"), body).alias("text"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS p, source, lang FROM documents)
SELECT doc_id, CAST(len(p) + 2 AS BIGINT) AS n, md5('1' || source || '|2' || lang || CASE WHEN len(p) > 0 THEN '|' ELSE '' END || array_to_string(p, '|')) AS elements_md5 FROM l""")
def parse_markdown(spark: SparkSession, d: str) -> DataFrame:
    e = chunking.parse_markdown(F.col("text"))
    rows = _markdown(spark, d).select("doc_id", e.alias("e"))
    return rows.select("doc_id", F.size("e").cast("long").alias("n"), F.md5(F.array_join(F.transform("e", lambda x: F.concat(F.coalesce(x["level"].cast("string"), F.lit("")), x["text"])), "|")).alias("elements_md5"))


@query(r"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 800 ELSE 500 END AS max_tokens, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS overlap, event_id % 3 <> 0 AS title_chain FROM events")
def split_params(spark: SparkSession, d: str) -> DataFrame:
    j = F.when(F.col("event_id") % 3 == 0, F.lit('{"maxTokens":800,"overlap":1,"titleChain":false}')).when(F.col("event_id") % 3 == 1, F.lit("{oops"))
    return table(spark, d, "events").select("event_id", chunking.merge_params(j).alias("p")).select("event_id", "p.*")


@query(f"WITH s AS (SELECT doc_id, {_SENTENCES.format(_TRIM.format('coalesce(text, chr(32))'))} AS s, {_TRIM.format('text')} AS t FROM documents WHERE {_TRIM.format('text')} <> ''), k AS (SELECT doc_id, t, {_PACK.format('s', 200)} AS r FROM s), b AS (SELECT doc_id, CASE WHEN ceil(length(t) / 1.5) > 200 THEN CASE WHEN r.cur <> '' THEN list_append(r.out, r.cur) ELSE r.out END ELSE [t] END AS blocks FROM k) SELECT doc_id, CAST(unnest(range(len(blocks))) AS INTEGER) AS pos, md5(unnest(blocks)) AS content_md5 FROM b")
def chunk_semantic(spark: SparkSession, d: str) -> DataFrame:
    """Single line ends part no paragraphs, so a document is one element here."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = docs.select("doc_id", F.posexplode(chunking.semantic(chunking.parse_plain(F.col("text")), chunking.Params(200))).alias("pos", "c"))
    return out.select("doc_id", "pos", F.md5("c.content").alias("content_md5"))


def _told(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of each document's chunks the number, the characters, the largest kind, and a digest of the texts in their order."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"])
    return chunks.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"), F.max("chunk_type").alias("kind"), F.md5(F.array_join(texts, "\u0001")).alias("contents_md5"))


def _chunks(spark: SparkSession, d: str, key: str) -> DataFrame:
    docs = _markdown(spark, d)
    return _told(chunking.split(docs, chunking.parse_markdown(F.col("text")), F.lit(key), chunking.Params(120)))


_LINES = r"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
_BLOCKS = "CASE WHEN r.cur <> '' THEN list_append(r.out, r.cur) ELSE r.out END"
#: Lines as blocks, packed with line ends between them.
_PACK_LINES = _PACK.replace("a.cur || x.cur", "CASE WHEN a.cur = '' THEN x.cur ELSE a.cur || chr(10) || x.cur END")
#: doc_id, contents, kind -> what _told has of them.
_TELL = "SELECT {key}, CAST(len(contents) AS BIGINT) AS n, CAST(list_sum(list_transform(contents, lambda x: length(x))) AS BIGINT) AS chars, kind, md5(array_to_string(contents, chr(1))) AS contents_md5 FROM {name} WHERE len(contents) > 0"
_STRUCTURE = f"""sb AS (SELECT doc_id, source, lang, array_to_string({_LINES}, chr(10)) AS body FROM documents), ss AS (SELECT *, {_SENTENCES.format('body')} AS s FROM sb WHERE body <> ''), sk AS (SELECT *, {_PACK.format('s', 120)} AS r FROM ss),
structured AS (SELECT doc_id, list_transform(CASE WHEN ceil(length(body) / 1.5) > 120 THEN {_BLOCKS} ELSE [body] END, lambda x: '[' || source || ' > ' || lang || '] ' || x) AS contents, 'STRUCTURE' AS kind FROM sk)"""
#: Each heading and line is an element here; long ones are cut.
_PARTS = f"""WITH l AS (SELECT doc_id, list_concat([source, lang], {_LINES}) AS ts FROM documents), p AS (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM l), s AS (SELECT *, {_SENTENCES.format('t')} AS s FROM p), k AS (SELECT *, {_PACK.format('s', 120)} AS r FROM s),
c AS (SELECT doc_id, list(list_prepend(t, CASE WHEN ceil(length(t) / 1.5) > 120 THEN {_BLOCKS} ELSE [] END) ORDER BY i) AS parts FROM k GROUP BY doc_id), o AS (SELECT doc_id, flatten(parts) AS contents, 'PARENT' AS kind FROM c)"""


@query(f"WITH {_STRUCTURE} {_TELL.format(key='doc_id', name='structured')}")
def chunk_structure(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, "structure")


@query(f"{_PARTS} {_TELL.format(key='doc_id', name='o')}")
def chunk_parent_child(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, "parent-child")


_CLAUSE = r"(第[一二三四五六七八九十百千零〇\d]+条|(?m:^)\d+\.\d+|(?m:^)[一二三四五六七八九十]+、)"


def _ruled(name: str, text: str) -> str:
    """CTEs that cut a document's text (SQL over its row) before each clause mark."""
    cut = _TRIM.format("CASE WHEN contains(x, chr(2)) THEN string_split(x, chr(2))[1] || ' ' || " + _TRIM.format("string_split(x, chr(2))[-1]") + " ELSE x END")
    return f"""{name}_pieces AS (SELECT doc_id, string_split(regexp_replace({text}, '{_CLAUSE}', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS pieces FROM documents),
{name} AS (SELECT doc_id, list_filter(list_transform(pieces, lambda x: {cut}), lambda x: x <> '') AS contents, 'POLICY' AS kind FROM {name}_pieces)"""


#: Every third line of a document is led by a clause mark.
_POLICY = _ruled("ruled", f"array_to_string(list_transform({_LINES}, lambda x, i: CASE WHEN i % 3 = 1 THEN '第' || i || '条 ' || x ELSE x END), chr(10))")


def _clauses(text: str = "text"):
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: trim(x)), lambda x: x != "")
    return F.array_join(F.transform(lines, lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("第"), (i + 1).cast("string"), F.lit("条 "), x)).otherwise(x)), "\n")


@query(f"WITH {_POLICY} {_TELL.format(key='doc_id', name='ruled')}")
def chunk_policy(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", _clauses().alias("text"))
    return _told(chunking.split(docs, F.array(chunking.element("paragraph", F.col("text"))), F.lit("policy"), chunking.Params(120)))


@query(f"""WITH t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
p AS (SELECT q.conv_id, list('问:' || {_TRIM.format('q.text')} || chr(10) || '答:' || {_TRIM.format('a.text')} ORDER BY q.i) AS contents, 'FAQ' AS kind FROM t q JOIN t a ON a.conv_id = q.conv_id AND a.i = q.i + 1 WHERE q.i % 2 = 1 GROUP BY q.conv_id) {_TELL.format(key='conv_id', name='p')}""")
def chunk_faq(spark: SparkSession, d: str) -> DataFrame:
    """Turns stand for questions and answers by turns."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x, i: F.concat(F.when(i % 2 == 0, "Q: ").otherwise("A: "), x["text"]))
    talks = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(turns, "\n").alias("text"))
    return _told(chunking.split(talks, F.array(chunking.element("paragraph", F.col("text"))), F.lit("faq"), chunking.Params(120)), "conv_id")


@query(f"WITH l AS (SELECT doc_id, {_LINES} AS contents, 'TABLE' AS kind FROM documents) {_TELL.format(key='doc_id', name='l')}")
def chunk_table(spark: SparkSession, d: str) -> DataFrame:
    """Without a table every line is packed by itself."""
    return _chunks(spark, d, "table")


@query(f"""WITH l AS (SELECT o_custkey, list('表头: order | status | 行: ' || o_orderkey || ' | ' || o_orderstatus ORDER BY o_orderkey) AS s FROM orders GROUP BY o_custkey), k AS (SELECT *, {_PACK_LINES.format('s', 120)} AS r FROM l),
o AS (SELECT o_custkey, {_BLOCKS} AS contents, 'TABLE' AS kind FROM k) {_TELL.format(key='o_custkey', name='o')}""")
def chunk_table_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as a table."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: F.array(x["o_orderkey"].cast("string"), x["o_orderstatus"]))
    docs = table(spark, d, "orders").groupBy("o_custkey").agg(rows.alias("rows"))
    elements = F.array(chunking.element("table", F.lit(None), header=F.array(F.lit("order"), F.lit("status")), rows=F.col("rows")))
    return _told(chunking.split(docs, elements, F.lit("table"), chunking.Params(120)), "o_custkey")


_WHOLE = f"""ws AS (SELECT doc_id, {_TRIM.format("coalesce(text, '')")} AS t FROM documents), wk AS (SELECT *, {_SENTENCES.format('t')} AS s FROM ws WHERE t <> ''), wr AS (SELECT *, {_PACK.format('s', 120)} AS r FROM wk),
whole AS (SELECT doc_id, CASE WHEN ceil(length(t) / 1.5) > 120 THEN {_BLOCKS} ELSE [t] END AS contents, 'SEMANTIC' AS kind FROM wr),
tl AS (SELECT doc_id, list_transform({_LINES}, lambda x: '表头: line | 行: ' || x) AS s FROM documents), tk AS (SELECT *, {_PACK_LINES.format('s', 120)} AS r FROM tl), tabled AS (SELECT doc_id, {_BLOCKS} AS contents, 'TABLE' AS kind FROM tk)"""


_NUMBERED = "doc_id IN (SELECT doc_id FROM documents WHERE regexp_matches(text, '\\d\\.\\d'))"  # looks like a clause to auto


@query(f"""WITH {_STRUCTURE}, {_POLICY}, {_ruled('plainly', _TRIM.format("coalesce(text, '')"))}, {_WHOLE}, chosen AS (SELECT * FROM structured WHERE doc_id % 4 = 0 UNION ALL SELECT * FROM ruled WHERE doc_id % 4 = 1 UNION ALL SELECT * FROM whole WHERE doc_id % 4 = 2 AND NOT {_NUMBERED} UNION ALL SELECT * FROM plainly WHERE doc_id % 4 = 2 AND {_NUMBERED} UNION ALL SELECT * FROM tabled WHERE doc_id % 4 = 3) {_TELL.format(key='doc_id', name='chosen')}""")
def chunk_auto(spark: SparkSession, d: str) -> DataFrame:
    """A quarter of the documents with headings, one with clauses, one plain, one as tables: each takes its own branch."""
    body, m = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n")), F.col("doc_id") % 4
    marked = F.concat(F.lit("# "), F.col("source"), F.lit("\n\n## "), F.col("lang"), F.lit("\n"), body)
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: trim(x)), lambda x: x != "")
    tabled = F.array(chunking.element("table", F.lit(None), header=F.array(F.lit("line")), rows=F.transform(lines, lambda x: F.array(x))))
    one = lambda t: F.array(chunking.element("paragraph", t))
    elements = F.when(m == 0, chunking.parse_markdown(marked)).when(m == 1, one(_clauses())).when(m == 2, one(trim(F.coalesce("text", F.lit(""))))).otherwise(tabled)
    docs = table(spark, d, "documents").select("doc_id", "text", "source", "lang")
    return _told(chunking.split(docs, elements, F.lit(None).cast("string"), chunking.Params(120)))


@query(f"WITH s AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations), k AS (SELECT *, {_SENTENCES.format('coalesce(p, chr(32))')} AS ps FROM s) SELECT conv_id, turn, md5(CASE WHEN p IS NULL THEN text WHEN len(ps) <= 2 THEN p || text ELSE ps[len(ps) - 1] || ps[len(ps)] || text END) AS content_md5 FROM k")
def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))  # a conversation's turns
    blocks = text.overlapped(F.transform("t", lambda x: x["text"]), 2)
    return turns.select("conv_id", F.explode(F.arrays_zip(F.transform("t", lambda x: x["turn"]).alias("turn"), blocks.alias("b"))).alias("x")).select("conv_id", "x.turn", F.md5("x.b").alias("content_md5"))


_TOKENS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_BM25 = f"""w AS (SELECT doc_id, {_TOKENS.format('text')} AS words FROM documents), st AS (SELECT count(*) AS n, avg(len(words)) AS a FROM w),
qt AS (SELECT item_id AS query_id, unnest(list_distinct({_TOKENS.format('text')})) AS term FROM benchmark), po AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(words) AS len, unnest(words) AS term FROM w) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
fr AS (SELECT term, count(*) AS df FROM po GROUP BY 1), sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a))), 6) AS score FROM po JOIN qt USING (term) JOIN fr USING (term), st GROUP BY 1, 2),
bm AS (SELECT query_id, doc_id AS chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc QUALIFY rank <= 20)"""
_VEC = """vs AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM {q} q, embeddings v),
ve AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM vs QUALIFY rank <= 20)"""
_PAIRED = _VEC.format(q="(SELECT e.* FROM embeddings e JOIN benchmark ON item_id = vec_id)")
_FUSED = "ch AS (SELECT query_id, 'bm25' AS channel, chunk_id, rank FROM bm UNION ALL SELECT query_id, 'vector', chunk_id, rank FROM ve), rr AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score, string_agg(channel, ',' ORDER BY channel) AS channels FROM ch GROUP BY 1, 2), fu AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM rr QUALIFY rank <= 20)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def _question_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A benchmark text's vector is the embedding with its number."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding").join(_questions(spark, d).select("query_id"), "query_id")


@query(f"WITH {_BM25} SELECT * FROM bm")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25_top_k(_docs(spark, d), _questions(spark, d)).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {_BM25} SELECT * FROM bm")
def bm25_indexed(spark: SparkSession, d: str) -> DataFrame:
    """bm25_topk from a kept index of all documents."""
    index = Postings(spark, working_folder(spark, "postings"))
    index.upsert(_docs(spark, d))
    return index.search(_questions(spark, d)).select("query_id", "chunk_id", "score", "rank")


def _changed(spark: SparkSession, d: str) -> Postings:
    """An index of all documents, after a seventh of them got other texts, new ones came, and an eleventh was deleted."""
    index, docs, k = Postings(spark, working_folder(spark, "postings")), _docs(spark, d), F.col("chunk_id")
    index.upsert(docs)
    again = docs.where(k % 7 == 0).withColumn("content", F.concat_ws(" ", "content", F.lit("und der die"), "content"))
    index.upsert(again.unionByName(docs.where(k % 13 == 0).withColumn("chunk_id", k + 1_000_000_000)))
    index.delete(docs.where(k % 11 == 0))
    return index


_CHANGED = """changed AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN concat_ws(' ', text, 'und der die', text) ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0
UNION ALL SELECT doc_id + 1000000000, text FROM documents WHERE doc_id % 13 = 0)"""


@query(f"WITH {_CHANGED}, {_BM25.replace('FROM documents', 'FROM changed')} SELECT * FROM bm")
def bm25_indexed_changed(spark: SparkSession, d: str) -> DataFrame:
    return _changed(spark, d).search(_questions(spark, d)).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {_CHANGED}, {_BM25.replace('FROM documents', 'FROM changed')} SELECT * FROM bm")
def bm25_indexed_merged(spark: SparkSession, d: str) -> DataFrame:
    index = _changed(spark, d)
    index.merge()
    return index.search(_questions(spark, d)).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {_VEC.format(q='(SELECT * FROM embeddings WHERE vec_id % 50 = 0)')} SELECT * FROM ve")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return retrieval.vector_top_k(v, v.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")).select("query_id", "chunk_id", "score", "rank")


def _clustered(spark: SparkSession, d: str) -> tuple[clusters.Clusters, DataFrame]:
    v = _vectors(spark, d)
    return clusters.cluster(v), v.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")


@query(f"WITH {_VEC.format(q='(SELECT * FROM embeddings WHERE vec_id % 50 = 0)')} SELECT * FROM ve")
def vector_clustered_exact(spark: SparkSession, d: str) -> DataFrame:
    """vector_topk from a clustered index, exactly: lists that can't hold anything better are left out."""
    index, asked = _clustered(spark, d)
    return clusters.search(index, asked, exact=True).select("query_id", "chunk_id", "score", "rank")


@query(None)
def vector_clustered_recall(spark: SparkSession, d: str) -> DataFrame:
    """Of each question's 20 nearest, how many the clustered index finds, and how many of its lists it reads."""
    index, asked = _clustered(spark, d)
    told = clusters.recall_at(clusters.search(index, asked), clusters.search(index, asked, exact=True))
    return told.select("query_id", "hits", "wanted", F.lit(index.nprobe).alias("lists_read"), F.lit(len(index.centroids)).alias("lists"))


@query(f"WITH {_BM25}, {_PAIRED}, {_FUSED} SELECT query_id, chunk_id, score, channels, rank FROM fu")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    words = retrieval.bm25_top_k(_docs(spark, d), _questions(spark, d)).select("query_id", F.lit("bm25").alias("channel"), "chunk_id", "rank")
    near = retrieval.vector_top_k(_vectors(spark, d), _question_vectors(spark, d)).select("query_id", F.lit("vector").alias("channel"), "chunk_id", "rank")
    return retrieval.rrf(words.unionByName(near)).select("query_id", "chunk_id", "score", "channels", "rank")


@query(f"WITH {_BM25}, {_PAIRED}, {_FUSED} SELECT query_id, chunk_id, score, channels, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS place FROM fu WHERE chunk_id IN (SELECT doc_id FROM documents WHERE lang <> 'es') QUALIFY place <= 5")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    published = table(spark, d, "documents").where("lang <> 'es'").select(F.col("doc_id").alias("chunk_id"))
    return retrieval.hybrid(_docs(spark, d), _vectors(spark, d), _questions(spark, d), _question_vectors(spark, d), published)


@query(f"""WITH {_BM25}, c AS (SELECT bm.query_id, bm.chunk_id, bm.rank, list_distinct({_TOKENS.format('b.text')}) AS q, {_TOKENS.format('left(d.text, 256)')} AS t FROM bm JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = chunk_id),
s AS (SELECT query_id, chunk_id, rank, CASE WHEN len(q) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(q, t))::DOUBLE / len(q), 6) END AS rerank_score FROM c)
SELECT query_id, chunk_id, rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS INTEGER) AS place FROM s QUALIFY place <= 5""")
def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    docs, questions = _docs(spark, d), _questions(spark, d)
    found = retrieval.bm25_top_k(docs, questions).join(docs, "chunk_id").join(questions, "query_id")
    return retrieval.rerank(found, 5).select("query_id", "chunk_id", "rerank_score", "place")


@query("WITH s AS (SELECT user_id AS query_id, event_id % 97 AS chunk_id, CAST(event_id % 4 AS INTEGER) AS variant, CAST(floor(value) AS INTEGER) AS rank, value AS score FROM events), b AS (SELECT query_id, chunk_id, max(score) AS score, min(variant * 100000 + rank) AS seen FROM s GROUP BY 1, 2) SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY seen, chunk_id) AS INTEGER) AS rank FROM b")
def multi_variant(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "events").select(F.col("user_id").alias("query_id"), (F.col("event_id") % 97).alias("chunk_id"), (F.col("event_id") % 4).cast("int").alias("variant"), F.floor("value").cast("int").alias("rank"), F.col("value").alias("score"))
    return retrieval.keep_best(lists).select("query_id", "chunk_id", "score", "rank")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name || '|a|b|c|d|e' ELSE n_name || '|a|b' END AS listed FROM nation")
def variants(spark: SparkSession, d: str) -> DataFrame:
    more = F.when(F.col("n_nationkey") % 2 == 0, F.array(*[F.lit(x) for x in ("b", "c", "d", "e", "f")])).otherwise(F.array(F.lit("a"), F.lit(" "), F.lit("b")))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(retrieval.variants(F.col("n_name"), F.array(F.lit("a"), F.col("n_name")), more), "|").alias("listed"))


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'OUT_OF_SCOPE' END AS intent, CASE WHEN event_id % 2 = 0 THEN 'OTHER' ELSE event_type END AS free_intent FROM events")
def intent_clamp(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, d, "events").select("event_id", retrieval.clamp_intent(F.concat(F.lit(" "), kind), ["view", "click"]).alias("intent"), retrieval.clamp_intent(F.when(F.col("event_id") % 2 == 0, " ").otherwise(kind), []).alias("free_intent"))


@query("""WITH q AS (SELECT conv_id, turn, role, text AS q, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN trim(coalesce(u, '')) <> '' AND turn % 2 = 0 AND length(q) <= 90 THEN CASE WHEN contains(u, q) THEN u WHEN contains(q, u) THEN q ELSE u || ' ' || q END ELSE q END) AS rewritten_md5 FROM q""")
def fallback_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Turns of up to 90 characters count as short: the invented ones are longer than real questions."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w)
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("q"), last.alias("u"))
    return rows.select("conv_id", "turn", F.md5(retrieval.fallback_rewrite(F.col("q"), F.col("u"), F.col("turn") % 2 == 0, 90)).alias("rewritten_md5"))


@query("""WITH l AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN '用户' ELSE '客服' END || ': ' || CASE WHEN length(text) > 200 THEN left(text, 200) || '…' ELSE text END AS line FROM conversations WHERE role <> 'system'),
u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM l) SELECT conv_id, turn, line FROM u WHERE used <= 600""")
def history_budget(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.functions.masking import ellipsis

    who = F.when(F.col("role") == "user", "用户").otherwise("客服")
    lines = table(spark, d, "conversations").where("role <> 'system'").select("conv_id", "turn", F.concat(who, F.lit(": "), ellipsis(F.col("text"), 200)).alias("line"))
    return windows.within_budget(lines, ["conv_id"], [F.desc("turn")], F.length("line") + 1, 600)
