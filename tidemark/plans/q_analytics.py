"""Metering, evaluation and evidence queries; the events table stands for the call log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import evaluation, evidence, metering
from tidemark.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Price lists have a row per model; this one is small and fixed: (id, model, in, out, status).
PRICES = [(1, "view", "1.2500", "10.0000", 1), (2, "click", "0.4000", "1.6000", 1), (3, "purchase", None, "3.0000", 1), (4, "signup", "2.0000", "8.0000", 0), (5, "view", "1.5000", "9.0000", 1)]


def _calls(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "click", "DEGRADED").otherwise("SUCCESS")
    scenario = F.when(F.col("user_id") % 5 == 0, None).otherwise(F.col("event_type"))
    return table(spark, d, "events").select((F.col("user_id") % 8).alias("tenant"), scenario.alias("scenario"), F.col("event_type").alias("model"), status.alias("status"), (k * 1000).alias("prompt_tokens"), F.when(F.col("event_id") % 10 == 0, None).otherwise(k * 37).alias("completion_tokens"), F.floor("value").alias("elapsed_ms"), F.col("ts").alias("create_time"))


def _models(spark: SparkSession) -> DataFrame:
    schema = "id int, model_name string, in_per_mtok string, out_per_mtok string, status int"
    return spark.createDataFrame(PRICES, schema).withColumns({c: F.col(c).cast("decimal(10,4)") for c in ("in_per_mtok", "out_per_mtok")})


_CALLS = """c AS (SELECT user_id % 8 AS tenant, CASE WHEN user_id % 5 = 0 THEN NULL ELSE event_type END AS scenario, event_type AS model, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'DEGRADED' ELSE 'SUCCESS' END AS status,
CAST(json_extract_string(props, '$.k') AS BIGINT) * 1000 AS p, CASE WHEN event_id % 10 = 0 THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) * 37 END AS q, CAST(floor(value) AS BIGINT) AS ms, ts FROM events)"""
_SUMS = "count(*) AS calls, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(q) AS BIGINT) AS completion_tokens, CAST(sum(p) + sum(q) AS BIGINT) AS total_tokens, round(100.0 * count(*) FILTER (WHERE status <> 'FAILED') / count(*), 1)::DOUBLE AS success_rate, CAST(sum(ms) // count(*) AS BIGINT) AS avg_elapsed_ms"
#: Half up in whole numbers: {p} is the price in ten-thousandths.
_SIDE = "CAST(CAST(({t} * {p} * 2 + 1000000) // 2000000 AS BIGINT) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(20,4))"


@query(f"""WITH {_CALLS}, m(model, i, o) AS (VALUES ('view', 15000, 90000), ('click', 4000, 16000)),
x AS (SELECT c.*, {_SIDE.format(t='p', p='i')} + {_SIDE.format(t='q', p='o')} AS cost FROM c LEFT JOIN m USING (model))
SELECT {_SUMS}, CAST(sum(cost) AS DECIMAL(20,4)) AS cost FROM x""")
def cost_summary(spark: SparkSession, d: str) -> DataFrame:
    return metering.summary(_calls(spark, d), _models(spark))


@query(f"""WITH {_CALLS}, n AS (SELECT max(ts) AS now FROM events), r AS (SELECT *, {_SIDE.format(t='p', p="12500")} + {_SIDE.format(t='q', p="100000")} AS cost FROM c, n WHERE ts >= now - INTERVAL 30 DAY),
k AS (SELECT CAST(unnest(generate_series(date_trunc('day', now - INTERVAL 30 DAY)::TIMESTAMP, date_trunc('day', now)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM n),
g AS (SELECT CAST(ts AS DATE) AS day, count(*) AS calls, CAST(sum(p + q) AS BIGINT) AS tokens, sum(cost) AS cost FROM r GROUP BY 1)
SELECT k.day, coalesce(calls, 0) AS calls, coalesce(tokens, 0) AS tokens, CAST(coalesce(cost, 0) AS DECIMAL(20,4)) AS cost FROM k LEFT JOIN g ON k.day = g.day""")
def cost_trend(spark: SparkSession, d: str) -> DataFrame:
    now = table(spark, d, "events").agg(F.max("ts").alias("now"))
    return metering.trend(_calls(spark, d), F.lit("1.2500"), F.lit("10.0000"), now)


@query(f"WITH {_CALLS} SELECT coalesce(scenario, '*') AS key, {_SUMS}, CAST(0 AS DECIMAL(20,4)) AS cost FROM c GROUP BY 1")
def cost_by_scenario(spark: SparkSession, d: str) -> DataFrame:
    return metering.by(_calls(spark, d), "scenario")


@query(f"WITH {_CALLS} SELECT model AS key, {_SUMS}, CAST(0 AS DECIMAL(20,4)) AS cost FROM c GROUP BY 1")
def cost_by_model(spark: SparkSession, d: str) -> DataFrame:
    return metering.by(_calls(spark, d), "model")


@query(f"""WITH {_CALLS} SELECT 'tenant' AS dimension, CAST(tenant AS VARCHAR) AS key, count(*) AS calls FROM c GROUP BY 2 UNION ALL SELECT 'scenario', coalesce(scenario, '*'), count(*) FROM c GROUP BY 2
UNION ALL SELECT 'model', model, count(*) FROM c GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM c GROUP BY 2""")
def cost_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return metering.all_dimensions(_calls(spark, d))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """A case per order: gold are parts of its lines with a high discount, results its parts by quantity."""
    lines = table(spark, d, "lineitem")
    gold = F.collect_list(F.when(F.col("l_discount") > 0.05, F.col("l_partkey"))).alias("gold")
    result = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("l_quantity")).alias("q"), "l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("result")
    claim = F.struct(F.when(F.col("l_returnflag") == "N", "SUPPORTED").otherwise("UNSUPPORTED").alias("verdict"), (F.col("l_linenumber") - 2).alias("evidence"), "l_linenumber")
    claims = F.transform(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), claim.alias("c")))), lambda x: F.struct(x["c"]["verdict"].alias("verdict"), x["c"]["evidence"].alias("evidence"))).alias("claims")
    return lines.groupBy(F.col("l_orderkey").alias("case_id")).agg(gold, result, claims)


_CASES = """x AS (SELECT l_orderkey AS case_id, coalesce(list(l_partkey) FILTER (WHERE l_discount > 0.05), []) AS gold, list(l_partkey ORDER BY -l_quantity, l_linenumber, l_partkey) AS r,
count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'N') AS good, list(CASE WHEN l_returnflag = 'N' THEN l_linenumber - 2 ELSE -1 END) AS idx FROM lineitem GROUP BY 1),
y AS (SELECT *, list_distinct(gold) AS g, list_filter(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN list_contains(gold, r[i]) THEN i END), lambda i: i IS NOT NULL) AS hits,
list_distinct(list_transform(list_filter(idx, lambda i: i >= 0 AND i < len(r)), lambda i: r[i + 1])) AS cited FROM x),
z AS (SELECT case_id, CASE WHEN len(g) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(list_distinct(r[1:5]), g))::DOUBLE / len(g) END AS recall5, CASE WHEN len(g) = 0 THEN 1.0::DOUBLE WHEN len(hits) = 0 THEN 0.0 ELSE 1.0::DOUBLE / list_min(hits) END AS mrr,
CASE WHEN len(g) = 0 THEN 1.0::DOUBLE WHEN len(hits) = 0 THEN 0.0 ELSE coalesce(list_sum(list_transform(list_filter(hits, lambda i: i <= 5), lambda i: 1.0::DOUBLE / log2(i + 1))), 0) / list_sum(list_transform(range(1, least(len(hits), 5) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) END AS ndcg5,
good::DOUBLE / n AS faithfulness, (n - good)::DOUBLE / n AS hallucination, CASE WHEN len(cited) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(cited, g))::DOUBLE / len(cited) END AS citation FROM y)"""
_METRICS = ["recall5", "mrr", "ndcg5", "faithfulness", "hallucination", "citation"]
_ROUNDED = ", ".join(f"CAST(round(CAST({m} AS DECIMAL(20,12)), 4) AS DOUBLE) AS {m}" for m in _METRICS)
_REASONS = "concat_ws('; ', CASE WHEN recall5 < 0.9::DOUBLE THEN 'recall5' END, CASE WHEN mrr < 0.8::DOUBLE THEN 'mrr' END, CASE WHEN ndcg5 < 0.8::DOUBLE THEN 'ndcg5' END, CASE WHEN faithfulness < 0.95::DOUBLE THEN 'faithfulness' END, CASE WHEN hallucination > 0.02::DOUBLE THEN 'hallucination' END, CASE WHEN citation < 0.97::DOUBLE THEN 'citation' END)"


@query(f"WITH {_CASES} SELECT case_id, {_ROUNDED} FROM z")
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.metrics(_cases(spark, d), ["case_id"])


@query(f"WITH {_CASES} SELECT case_id, {_REASONS} = '' AS passed, {_REASONS} AS reasons FROM z")
def eval_gate(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.gate(_cases(spark, d), ["case_id"])


@query(f"""WITH {_CASES}, m AS (SELECT case_id % 10 AS task_id, {_REASONS} = '' AS passed, {_ROUNDED} FROM z)
SELECT task_id, count(*) AS cases, CAST(round(CAST(avg(CAST(passed AS INT)) AS DECIMAL(20,12)), 4) AS DOUBLE) AS pass_rate, {', '.join(f'CAST(round(CAST(avg({m}) AS DECIMAL(20,12)), 4) AS DOUBLE) AS {m}' for m in _METRICS)}, bool_and(passed) AS gate_pass FROM m GROUP BY 1""")
def eval_task_report(spark: SparkSession, d: str) -> DataFrame:
    cases = _cases(spark, d)
    both = evaluation.metrics(cases, ["case_id"]).join(evaluation.gate(cases, ["case_id"]), "case_id")
    return evaluation.task_report(both.withColumn("task_id", F.col("case_id") % 10), "task_id", _METRICS)


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """A conversation's turns as the evidence of one question."""
    return table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), F.col("turn").alias("chunk_id"), F.col("text").alias("content"), (F.length("text") % 100 / 100.0).alias("score"), F.array(F.when(F.col("turn") % 2 == 0, "bm25").otherwise("vector")).alias("channels"))


@query(r"""WITH e AS (SELECT conv_id AS query_id, turn AS pos, lower(regexp_replace(text, '\s+', '', 'g')) AS t FROM conversations WHERE trim(text) <> ''),
c AS (SELECT query_id, pos, ch, count(*) AS n FROM (SELECT query_id, pos, unnest(string_split(t, '')) AS ch FROM e) GROUP BY ALL),
p AS (SELECT x.query_id, x.pos AS a, y.pos AS b, sum(least(x.n, y.n)) AS n FROM c x JOIN c y ON x.query_id = y.query_id AND x.ch = y.ch AND x.pos < y.pos GROUP BY ALL),
s AS (SELECT p.query_id, a, b, round(2.0::DOUBLE * n / (length(x.t) + length(y.t)), 6) AS similarity FROM p JOIN e x ON x.query_id = p.query_id AND x.pos = a JOIN e y ON y.query_id = p.query_id AND y.pos = b)
SELECT query_id, a, b, similarity FROM s WHERE similarity >= 0.5 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, a, b) <= 10""")
def evidence_pairs(spark: SparkSession, d: str) -> DataFrame:
    return evidence.conflict_pairs(_evidence(spark, d), "query_id")


#: A turn's length, score and channel, and the characters that two turns share.
_EVIDENCE = r"""et AS (SELECT conv_id AS query_id, turn AS pos, lower(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) AS t, (length(text) % 100) / 100.0::DOUBLE AS score, CASE WHEN turn % 2 = 0 THEN 'bm25' ELSE 'vector' END AS channel FROM conversations),
ev AS (SELECT query_id, pos, length(t) AS n, score, channel FROM et), ec AS (SELECT query_id, pos, ch, count(*) AS n FROM (SELECT query_id, pos, unnest(string_split(t, '')) AS ch FROM et WHERE t <> '') GROUP BY ALL),
sh AS (SELECT x.query_id, x.pos AS a, y.pos AS b, sum(least(x.n, y.n)) AS n FROM ec x JOIN ec y ON x.query_id = y.query_id AND x.ch = y.ch AND x.pos < y.pos GROUP BY ALL)"""


@query("""WITH RECURSIVE EVIDENCE_CTES,
near AS (SELECT x.query_id, y.pos AS i, coalesce(list(x.pos) FILTER (WHERE x.pos < y.pos AND CASE WHEN x.n + y.n = 0 THEN true ELSE 2.0::DOUBLE * coalesce(s.n, 0) / (x.n + y.n) >= 0.85::DOUBLE END), []) AS before, any_value(y.score) AS score, any_value(y.channel) AS channel
  FROM ev y JOIN ev x ON x.query_id = y.query_id LEFT JOIN sh s ON s.query_id = y.query_id AND s.a = x.pos AND s.b = y.pos GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i) AS r FROM near),
w(query_id, r, kept) AS (SELECT query_id, r, [i] FROM o WHERE r = 1 UNION ALL SELECT o.query_id, o.r, CASE WHEN list_has_any(w.kept, o.before) THEN w.kept ELSE list_append(w.kept, o.i) END FROM w JOIN o ON o.query_id = w.query_id AND o.r = w.r + 1),
f AS (SELECT query_id, max_by(kept, r) AS kept FROM w GROUP BY 1),
p AS (SELECT o.query_id, o.i, score, channel, CASE WHEN list_contains(kept, o.i) THEN o.i ELSE list_min(list_intersect(before, kept)) END AS pos FROM o JOIN f USING (query_id)),
c AS (SELECT query_id, pos, channel, min(i) AS i FROM p GROUP BY 1, 2, 3), l AS (SELECT query_id, pos, string_agg(channel, ',' ORDER BY i) AS channels FROM c GROUP BY 1, 2)
SELECT query_id, pos, max(score) AS score, any_value(channels) AS channels FROM p JOIN l USING (query_id, pos) GROUP BY 1, 2""".replace("EVIDENCE_CTES", _EVIDENCE))
def evidence_dedup(spark: SparkSession, d: str) -> DataFrame:
    return evidence.deduplicate(_evidence(spark, d), ["query_id"]).select("query_id", "pos", "score", F.array_join("channels", ",").alias("channels"))


@query("""WITH g AS (SELECT user_id, CAST(ts AS DATE) AS day, greatest(max(value) / 100, 0) AS top, count(*) AS n, CASE WHEN bool_or(event_type = 'purchase') THEN 1.0 ELSE 0.0 END AS cover, bool_or(event_type = 'error') AS conflicts, user_id % 3 = 0 AS products FROM events GROUP BY user_id, CAST(ts AS DATE)),
c AS (SELECT *, least(greatest(0.5::DOUBLE * top + 0.3::DOUBLE * CASE WHEN n >= 2 THEN least(1.0::DOUBLE, 0.7::DOUBLE + 0.15::DOUBLE * (n - 2)) ELSE least(0.65::DOUBLE, 0.65::DOUBLE * n / 2) END + 0.2::DOUBLE * cover, 0), 1) AS confidence,
concat_ws(';', CASE WHEN n < 2 THEN 'too little evidence' END, CASE WHEN conflicts THEN 'conflicting evidence' END, CASE WHEN products AND cover <= 0 THEN 'product not covered' END) AS reasons FROM g)
SELECT user_id, day, round(confidence, 6) AS confidence, CASE WHEN reasons <> '' THEN 'refuse' WHEN confidence >= 0.75 THEN 'answer' WHEN confidence >= 0.5 THEN 'consult' ELSE 'refuse' END AS verdict, reasons FROM c""")
def sufficiency(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    g = e.groupBy("user_id", F.to_date("ts").alias("day")).agg((F.max("value") / 100).alias("top"), F.count("*").alias("n"), F.max(F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)).alias("cover"), F.some(F.col("event_type") == "error").alias("conflicts"))
    c = evidence.confidence(F.col("top"), F.col("n"), F.col("cover"))
    level, reasons = evidence.verdict(c, F.lit(False), F.col("n"), F.col("conflicts"), F.col("user_id") % 3 == 0, F.col("cover"))
    return g.select("user_id", "day", F.round(c, 6).alias("confidence"), level.alias("verdict"), reasons.alias("reasons"))


def _claims() -> tuple:
    claims = F.array(*[F.struct(F.when((F.col("l_linenumber") + i) % 2 == 0, F.lit(" supported ")).otherwise(F.lit("partly")).alias("verdict"), (F.col("l_linenumber") + i - 3).alias("evidence")) for i in range(3)])
    return claims, F.array("l_partkey", "l_suppkey")


_CLAIMS = "WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_transform([0, 1, 2], lambda i: CASE WHEN (l_linenumber + i) % 2 = 0 AND l_linenumber + i - 3 BETWEEN 0 AND 1 THEN l_linenumber + i - 3 ELSE -1 END) AS ok, list_transform([0, 1, 2], lambda i: CASE WHEN l_linenumber + i - 3 BETWEEN 0 AND 1 THEN l_linenumber + i - 3 ELSE -1 END) AS idx FROM lineitem)"


@query(_CLAIMS + " SELECT l_orderkey, l_linenumber, array_to_string(idx, ',') AS indexes, CAST(len(list_filter(ok, lambda i: i >= 0)) AS BIGINT) AS supported, len(list_filter(ok, lambda i: i < 0)) = 0 AS all_supported FROM x")
def claim_clamp(spark: SparkSession, d: str) -> DataFrame:
    claims, chunks = _claims()
    c = evidence.clamp_claims(claims, F.size(chunks))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.transform(c, lambda x: x["evidence"].cast("string")), ",").alias("indexes"), F.size(F.filter(c, lambda x: x["verdict"] == "SUPPORTED")).cast("long").alias("supported"), evidence.all_supported(c).alias("all_supported"))


@query(_CLAIMS + " SELECT l_orderkey, l_linenumber, array_to_string(CASE WHEN list_contains(ok, 0) AND list_contains(ok, 1) AND l_partkey <> l_suppkey THEN [l_partkey, l_suppkey] WHEN list_contains(ok, 0) THEN [l_partkey] WHEN list_contains(ok, 1) THEN [l_suppkey] ELSE [] END, ',') AS cited FROM x")
def citations(spark: SparkSession, d: str) -> DataFrame:
    claims, chunks = _claims()
    cited = evidence.citations(evidence.clamp_claims(claims, F.size(chunks)), chunks)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.transform(cited, lambda x: x.cast("string")), ",").alias("cited"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'WARN' WHEN value > 5 AND event_type = 'purchase' THEN 'SUPPORTED' ELSE 'WARN' END AS verdict FROM events")
def evidence_verdict(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, d, "events").select("event_id", evidence.evidence_verdict(kind == "error", F.col("value") > 5, kind == "purchase").alias("verdict"))


@query("SELECT conv_id, md5(string_agg('[C' || n || '] ' || role || '; ' || CASE WHEN length(text) > 300 THEN left(text, 300) || '…' ELSE text END, chr(10) ORDER BY n)) AS rendered_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id")
def context_render(spark: SparkSession, d: str) -> DataFrame:
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("name"), F.col("text").alias("content")))), lambda x: F.struct(x["name"].alias("name"), x["content"].alias("content")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("e")).select("conv_id", F.md5(evidence.render(F.col("e"))).alias("rendered_md5"))


@query("""WITH x AS (SELECT c_custkey, CAST(least(c_custkey % 5, c_custkey % 3) AS INTEGER) AS a, CAST(greatest(c_custkey % 5, c_custkey % 3) AS INTEGER) AS b FROM customer WHERE c_custkey % 2 = 0)
SELECT * FROM x WHERE (a, b) IN ((0, 1), (0, 2), (1, 2))""")
def conflict_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    answer = F.format_string('pairs: [{"a":%d,"b":%d,"conflict":%s}, {"a":4}] end', k % 5, k % 3, F.when(k % 2 == 0, "true").otherwise("false"))
    pair = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
    found = evidence.parse_conflicts(answer, F.array(pair(0, 1), pair(0, 2), pair(1, 2)))
    return table(spark, d, "customer").select("c_custkey", F.explode(found).alias("p")).select("c_custkey", "p.a", "p.b")
