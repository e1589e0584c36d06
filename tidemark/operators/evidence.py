"""Evidence: near-duplicates, conflict candidates, sufficiency, claims, citations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.similarity import min_max, multiset, normalized
from tidemark.session import checkpointed


def raw_score(rerank: Column, fused: Column) -> Column:
    return F.when(rerank >= 0, rerank).otherwise(fused)


def assemble(results: DataFrame, k: int = 8) -> DataFrame:
    """The first k of each query's results(query_id, rank, rerank, fused, ...), with raw_score, score and place.

    The raw score is the reranker's, or the fused one where that is null or negative; scores are the
    raw ones of the k on 0 .. 1 (``min_max``), and places go by falling score, ties by rank.
    """
    first = results.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("_n") <= k).drop("_n")
    scored = first.withColumn("raw_score", raw_score(F.col("rerank"), F.col("fused"))).withColumn("score", min_max(F.col("raw_score"), ["query_id"]))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")))


def alike_pairs(evidence: DataFrame, keys: list[str], least: float) -> DataFrame:
    """keys, a, b, similarity (by shared characters) of the evidence(keys, pos, content) a before b that is at least so much alike.

    Texts meet only where their lengths allow it: lengths are cut into bands so wide that texts alike
    enough lie in one band or in neighbouring ones.
    """
    size = F.length(normalized(F.coalesce("content", F.lit(""))))
    reach = (2 - least) / least + 1e-6  # the longest text that may be as alike, by the shorter one's length
    band = F.floor(F.log(F.greatest(size, F.lit(1))) / F.lit(math.log(reach))).cast("long")
    e = evidence.select(*keys, "pos", "content", size.alias("_n"), band.alias("_band"))
    one = e.select(*keys, F.col("pos").alias("a"), F.col("content").alias("x"), F.col("_n").alias("_na"), F.explode(F.array(F.col("_band") - 1, F.col("_band"), F.col("_band") + 1)).alias("_band"))
    other = e.select(*keys, F.col("pos").alias("b"), F.col("content").alias("y"), F.col("_n").alias("_nb"), "_band")
    pairs = one.join(other, [*keys, "_band"]).where("a < b").where(2 * F.least("_na", "_nb") >= (least - 1e-6) * (F.col("_na") + F.col("_nb"))).drop("_band", "_na", "_nb")
    return multiset(pairs, [*keys, "a", "b"], "x", "y").where(F.col("similarity") >= least - 1e-6)


def deduplicate(evidence: DataFrame, keys: list[str], threshold: float = 0.85) -> DataFrame:
    """keys, pos, chunk_id, score, channels of the evidence that is kept: in order (pos), each compared with what was kept before it.

    One that is at least ``threshold`` like a kept one merges into the first such: the largest score
    and the union of channels stay.  Rounds over all keys at once: what has no undecided neighbour
    before it is kept, what is like something kept is merged.  keys and pos name a row: rows that
    share both are one.  A null key is a key of its own, a row without a pos comes after all others
    of its key, and null contents count as empty.
    """
    # Structs are never null themselves, so that rows with a null key or pos meet in joins like all others.
    pos = F.struct(F.col("pos").isNull().alias("none"), F.col("pos").alias("pos"))
    item = evidence.select(F.struct(*keys).alias("_g"), pos.alias("pos"), "chunk_id", F.col("score").cast("double").alias("score"), "channels", "content")
    g = ["_g"]
    edges = checkpointed(alike_pairs(item, g, threshold).where(F.col("similarity") >= threshold).select("_g", "a", "b"))
    undecided, kept = checkpointed(item.select("_g", "pos").distinct()), None
    as_ = lambda df, name: df.withColumnRenamed("pos", name)
    while not undecided.isEmpty():
        live = edges.join(as_(undecided, "a"), ["_g", "a"], "left_semi").join(as_(undecided, "b"), ["_g", "b"], "left_semi")
        new = checkpointed(undecided.join(live.select("_g", F.col("b").alias("pos")), ["_g", "pos"], "left_anti"))
        gone = live.join(as_(new, "a"), ["_g", "a"], "left_semi").select("_g", F.col("b").alias("pos"))
        kept = new if kept is None else kept.unionByName(new)
        undecided = checkpointed(undecided.join(new, ["_g", "pos"], "left_anti").join(gone, ["_g", "pos"], "left_anti"))
    named = [F.col(f"_g.{k}").alias(k) for k in keys]
    if kept is None:
        return item.select(*named, "pos.pos", "chunk_id", "score", "channels")
    into = edges.join(as_(kept, "a"), ["_g", "a"], "left_semi").join(as_(kept, "b"), ["_g", "b"], "left_anti").groupBy("_g", "b").agg(F.min("a").alias("_into"))
    placed = item.drop("content").join(into.withColumnRenamed("b", "pos"), ["_g", "pos"], "left").withColumn("_into", F.coalesce("_into", "pos"))
    listed = placed.select("_g", "_into", "pos", F.posexplode_outer("channels").alias("_i", "_c")).groupBy("_g", "_into", "_c").agg(F.min(F.struct("pos", "_i")).alias("_at"))
    channels = listed.groupBy("_g", "_into").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("_c").isNotNull(), F.struct("_at", "_c")))), lambda x: x["_c"]).alias("channels"))
    scores = placed.groupBy("_g", "_into").agg(F.max("score").alias("score"), F.min_by("chunk_id", "pos").alias("chunk_id"))
    return scores.join(channels, ["_g", "_into"]).select(*named, F.col("_into.pos").alias("pos"), "chunk_id", "score", "channels")


def conflict_pairs(evidence: DataFrame, key: str, least: float = 0.5, most: int = 10) -> DataFrame:
    """key, a, b, similarity: pairs of a query's evidence that are alike enough, the most alike ``most`` of each query; blank texts aside."""
    pairs = alike_pairs(evidence.where("trim(content) <> ''"), [key], least)
    scored = pairs.withColumn("similarity", F.round("similarity", 6)).where(F.col("similarity") >= least)
    w = Window.partitionBy(key).orderBy(F.desc("similarity"), "a", "b")
    return scored.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def parse_conflicts(answer: Column, candidates: Column) -> Column:
    """array<struct<a, b>>: the pairs that a judge's answer (JSON in free text) calls conflicts, smaller first, if they were candidates; each once."""
    from tidemark.functions.jsons import first_array

    told = F.coalesce(F.from_json(first_array(answer), "array<struct<a: int, b: int, conflict: boolean>>"), F.array().cast("array<struct<a: int, b: int, conflict: boolean>>"))
    pairs = F.transform(F.filter(told, lambda x: F.coalesce(x["conflict"], F.lit(False))), lambda x: F.struct(F.least(x["a"], x["b"]).alias("a"), F.greatest(x["a"], x["b"]).alias("b")))
    return F.array_intersect(F.array_distinct(pairs), candidates)


def confidence(top: Column, n: Column, coverage: Column, at_least: int = 2, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> Column:
    """Weighted mean of the top score, the count metric and entity coverage, clamped to 0 .. 1."""
    w = [max(x, 0.0) for x in weights]
    w = [x / sum(w) for x in w] if sum(w) > 0 else [0.5, 0.3, 0.2]
    enough = F.least(F.lit(1.0), 0.7 + 0.15 * (n - at_least))
    count = F.when(n == 0, 0.0).when(n >= at_least, enough).otherwise(F.least(F.lit(0.65), 0.65 * n / at_least))
    return F.least(F.greatest(w[0] * F.greatest(top, F.lit(0.0)) + w[1] * count + w[2] * coverage, F.lit(0.0)), F.lit(1.0))


def verdict(confidence_: Column, blocked: Column, n: Column, conflicts: Column, products: Column, coverage: Column, at_least: int = 2) -> tuple[Column, Column]:
    """(answer, consult or refuse; reasons joined by ";"): the gates come before the thresholds."""
    reasons = F.concat_ws(";", F.when(blocked, F.lit("retrieval blocked")), F.when(n < at_least, F.lit("too little evidence")), F.when(conflicts, F.lit("conflicting evidence")), F.when(products & (coverage <= 0), F.lit("product not covered")))
    level = F.when(reasons != "", "refuse").when(confidence_ >= 0.75, "answer").when(confidence_ >= 0.5, "consult").otherwise("refuse")
    return level, reasons


def clamp_claims(claims: Column, n: Column) -> Column:
    """Claims with verdict in upper case (unknown ones unsupported) and indexes out of range as -1; a supported one without evidence is unsupported."""

    def fix(c: Column) -> Column:
        i = F.when((c["evidence"] < 0) | (c["evidence"] >= n) | c["evidence"].isNull(), F.lit(-1)).otherwise(c["evidence"])
        v = F.upper(F.trim(c["verdict"]))
        v = F.when((v == "SUPPORTED") & (i >= 0), "SUPPORTED").otherwise("UNSUPPORTED")
        return F.struct(v.alias("verdict"), i.alias("evidence"))

    return F.transform(claims, fix)


def all_supported(claims: Column) -> Column:
    return (F.size(claims) > 0) & F.forall(claims, lambda c: c["verdict"] == "SUPPORTED")


def citations(claims: Column, chunks: Column) -> Column:
    """Distinct chunk ids of supported claims with an index in range, in order."""
    good = F.filter(claims, lambda c: (c["verdict"] == "SUPPORTED") & (c["evidence"] >= 0) & (c["evidence"] < F.size(chunks)))
    return F.array_distinct(F.transform(good, lambda c: F.get(chunks, c["evidence"])))


def evidence_verdict(in_conflict: Column, answered: Column, cited: Column) -> Column:
    return F.when(in_conflict, "WARN").when(answered & cited, "SUPPORTED").otherwise("WARN")


def render(evidence: Column, limit: int = 300) -> Column:
    """[C1] name; text of each (name, content) struct, one per line, texts cut at limit."""
    cut = lambda c: F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)
    return F.array_join(F.transform(evidence, lambda e, i: F.concat(F.lit("[C"), (i + 1).cast("string"), F.lit("] "), e["name"], F.lit("; "), cut(e["content"]))), "\n")
