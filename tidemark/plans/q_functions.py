"""Scalar functions: masking, dates, money, distance, JSON, arrays, similarities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import codecs, dates, jsons, masking, numbers, similarity
from tidemark.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query("""SELECT c_custkey, CASE WHEN length(c_name) <= 7 THEN repeat('*', length(c_name)) ELSE left(c_name, 3) || repeat('*', CAST(length(c_name) - 7 AS BIGINT)) || right(c_name, 4) END AS mobile,
CASE WHEN length(c_name) <= 1 THEN repeat('*', length(c_name)) ELSE left(c_name, 1) || repeat('*', CAST(length(c_name) - 1 AS BIGINT)) END AS chinese_name, repeat('*', length(c_name)) AS password,
regexp_replace(c_name || '@' || c_mktsegment || '.com', '(^.)[^@]*(@.*$)', '\\1****\\2') AS email, CASE WHEN length(c_mktsegment) > 6 THEN left(c_mktsegment, 6) || '...' ELSE c_mktsegment END AS short FROM customer""")
def mask_presets(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", masking.preset(c, "mobile").alias("mobile"), masking.preset(c, "chinese_name").alias("chinese_name"), masking.preset(c, "password").alias("password"), masking.email(F.concat(c, F.lit("@"), "c_mktsegment", F.lit(".com"))).alias("email"), masking.max_length(F.col("c_mktsegment"), 9).alias("short"))


@query(r"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', '', 'gis'), '<!--.*?-->', '', 'gs'), '<[^>]*>', '', 'g')) AS text_md5 FROM pages")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(masking.strip_html(F.col("html"))).alias("text_md5"))


@query("""WITH r AS (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders),
m AS (SELECT unnest(generate_series(date_trunc('month', lo)::TIMESTAMP, date_trunc('month', hi)::TIMESTAMP, INTERVAL 1 MONTH)) AS s, lo, hi FROM r)
SELECT strftime(s, '%Y-%m') AS label, strftime(greatest(s, lo::TIMESTAMP), '%Y-%m-%d') AS first_day, strftime(least(s + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND, hi::TIMESTAMP + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND), '%Y-%m-%d') AS last_day,
 (SELECT count(*) FROM orders WHERE date_trunc('month', o_orderdate) = s) AS n FROM m""")
def date_buckets(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    span = orders.agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    months = span.select(F.explode(dates.buckets(F.col("lo"), F.col("hi"), "MONTH")).alias("b"))
    counts = orders.groupBy(F.date_trunc("MONTH", "o_orderdate").alias("month")).agg(F.count("*").alias("n"))
    out = months.join(counts, F.date_trunc("MONTH", F.col("b.start")) == F.col("month"), "left")
    return out.select(dates.label(F.col("b.start"), "MONTH").alias("label"), F.date_format("b.start", "yyyy-MM-dd").alias("first_day"), F.date_format("b.end", "yyyy-MM-dd").alias("last_day"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS hour_label, strftime(o_orderdate, '%Y-%m-%d') || '(第 ' || CAST(weekofyear(o_orderdate) AS VARCHAR) || ' 周)' AS week_label,
CAST(year(o_orderdate) AS VARCHAR) || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter_label, CAST(year(o_orderdate) AS VARCHAR) AS year_label FROM orders""")
def date_labels(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", *[dates.label(ts, u).alias(f"{u.lower()}_label") for u in ("HOUR", "WEEK", "QUARTER", "YEAR")])


@query("""SELECT l_orderkey, l_linenumber, CAST(round(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(l_linenumber AS DECIMAL(20,4)) / 100, 0) AS BIGINT) AS rated, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) // 100 AS BIGINT) AS units,
CAST(CAST(round(l_extendedprice * 100) AS BIGINT) * l_linenumber * (CAST(l_quantity * 10 AS BIGINT) // 100) AS BIGINT) AS scaled FROM lineitem""")
def money_ops(spark: SparkSession, d: str) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.rate_price(cents, F.col("l_linenumber")).alias("rated"), F.floor(numbers.cents_to_units(cents)).cast("long").alias("units"), numbers.scaled_total(cents, F.col("l_linenumber"), (F.col("l_quantity") * 10).cast("long")).alias("scaled"))


@query("""WITH p AS (SELECT c_custkey, (c_custkey % 180) - 90.0 AS la, (c_custkey * 7 % 360) - 180.0 AS lo FROM customer)
SELECT c_custkey, round(round(2 * asin(sqrt(pow(sin((radians(la) - radians(30.0)) / 2), 2) + cos(radians(la)) * cos(radians(30.0)) * pow(sin((radians(lo) - radians(120.0)) / 2), 2))) * 6378.137, 4), 3) AS km FROM p""")
def geo_distance(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.round(numbers.distance_km(k % 180 - 90.0, k * 7 % 360 - 180.0, F.lit(30.0), F.lit(120.0)), 3).alias("km"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS ok, NULLIF(regexp_extract('answer: ' || props || ' end', '(?s)\\{.*\\}'), '') AS object FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("props")
    return table(spark, d, "events").select("event_id", F.get_json_object(p, "$.k").cast("long").alias("k"), jsons.is_json(p).alias("ok"), jsons.first_object(F.concat(F.lit("answer: "), p, F.lit(" end"))).alias("object"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS DOUBLE) + 0.5 END AS first_score, event_id % 2 = 0 AS sized FROM events")
def json_array_extract(spark: SparkSession, d: str) -> DataFrame:
    n = F.when(F.col("event_id") % 2 == 0, F.lit(", 2]")).otherwise(F.lit("]"))
    found = jsons.numbers(F.concat(F.lit("scores: ["), F.col("event_id").cast("string"), F.lit(".5"), n, F.lit(" done")), F.lit(2))
    return table(spark, d, "events").select("event_id", F.get(found, F.lit(0)).alias("first_score"), found.isNotNull().alias("sized"))


@query("""SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS positive, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 6) AS norm2,
CAST(len(list_distinct(list_transform(embedding, lambda x: CAST(floor(x * 2) AS INTEGER)))) AS BIGINT) AS bins FROM embeddings""")
def array_hofs(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    norm = F.aggregate(F.transform(e, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return table(spark, d, "embeddings").select("vec_id", F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"), F.round(norm, 6).alias("norm2"), F.size(F.array_distinct(F.transform(e, lambda x: F.floor(x * 2)))).cast("long").alias("bins"))


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) || ',' || CAST(o_orderkey % 7 AS VARCHAR) AS listed, CAST(o_custkey + o_orderkey % 7 AS BIGINT) AS summed FROM orders")
def list_codec(spark: SparkSession, d: str) -> DataFrame:
    listed = codecs.encode_list(F.array(F.col("o_custkey"), F.col("o_orderkey") % 7))
    return table(spark, d, "orders").select("o_orderkey", listed.alias("listed"), F.aggregate(codecs.decode_list(listed), F.lit(0).cast("long"), lambda a, x: a + x).alias("summed"))


_PAIRS = "p AS (SELECT a.item_id AS a_id, b.item_id AS b_id, a.text AS a, b.text AS b FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "benchmark").select(F.col("item_id").alias("a_id"), F.col("text").alias("a"))
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("b_id"), F.col("text").alias("b"))
    return a.join(b, F.col("b_id") == F.col("a_id") + 1)


@query(f"""WITH {_PAIRS}, n AS (SELECT a_id, b_id, lower(regexp_replace(a, '\\s+', '', 'g')) AS a, lower(regexp_replace(b, '\\s+', '', 'g')) AS b FROM p),
x AS (SELECT a_id, b_id, c, count(*) AS n FROM (SELECT a_id, b_id, unnest(string_split(a, '')) AS c FROM n) GROUP BY ALL), y AS (SELECT a_id, b_id, c, count(*) AS n FROM (SELECT a_id, b_id, unnest(string_split(b, '')) AS c FROM n) GROUP BY ALL),
s AS (SELECT x.a_id, x.b_id, sum(least(x.n, y.n)) AS n FROM x JOIN y USING (a_id, b_id, c) GROUP BY ALL)
SELECT a_id, b_id, round(2.0::DOUBLE * coalesce(s.n, 0) / (length(a) + length(b)), 6) AS similarity FROM n LEFT JOIN s USING (a_id, b_id)""")
def char_similarity(spark: SparkSession, d: str) -> DataFrame:
    return similarity.multiset(_pairs(spark, d), ["a_id", "b_id"], "a", "b").select("a_id", "b_id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_PAIRS}, s AS (SELECT a_id, b_id, list_distinct(string_split(a, '')) AS x, list_distinct(string_split(b, '')) AS y FROM p)
SELECT a_id, b_id, round(CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(list_concat(x, y))), 6) AS similarity FROM s""")
def char_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("a_id", "b_id", F.round(similarity.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("""WITH s AS (SELECT event_id, user_id, greatest(coalesce(value - 5, 0), 0) AS v FROM events), w AS (SELECT *, min(v) OVER (PARTITION BY user_id) AS lo, max(v) OVER (PARTITION BY user_id) AS hi FROM s)
SELECT event_id, round(CASE WHEN hi - lo < 1e-9 THEN 1.0 ELSE (v - lo) / (hi - lo) END, 6) AS score FROM w""")
def minmax_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(similarity.min_max(F.col("value") - 5, ["user_id"]), 6).alias("score"))


@query("""SELECT o_orderkey, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS quarter, strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end, list_aggregate(list_transform(range(0, 7), lambda i: strftime(CAST(o_orderdate AS DATE) - CAST(6 - i AS INTEGER), '%m%d')), 'string_agg', ',') AS week,
o_orderdate <= TIMESTAMP '1996-06-30' AND o_orderdate + INTERVAL 60 DAY >= TIMESTAMP '1996-01-01' AS meets FROM orders""")
def date_helpers(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.functions import dates

    at = F.col("o_orderdate").cast("timestamp")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    week = F.array_join(F.transform(dates.latest_days(F.to_date(at), 7), lambda x: F.date_format(x, "MMdd")), ",")
    meets = dates.overlap(at, at + F.expr("INTERVAL 60 DAYS"), F.lit("1996-01-01").cast("timestamp"), F.lit("1996-06-30").cast("timestamp"))
    return table(spark, d, "orders").select("o_orderkey", day(dates.quarter_start(at)).alias("quarter"), day(dates.month_end(at)).alias("month_end"), week.alias("week"), meets.alias("meets"))
