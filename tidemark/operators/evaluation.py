"""Retrieval and answer metrics, gates and task reports.

A case has gold and result (arrays of ids, best first) and claims: array of (verdict, evidence).
Null ids are dropped; ratios are clamped to 0 .. 1 and rounded half up to four decimals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: What a metric must reach (or, for hallucination, not exceed).
GATES = {"recall5": 0.90, "mrr": 0.80, "ndcg5": 0.80, "faithfulness": 0.95, "hallucination": 0.02, "citation": 0.97}


def _clamp(c: Column) -> Column:
    good = F.when(F.isnan(c) | c.isNull(), 0.0).otherwise(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
    return F.round(good.cast("decimal(20,12)"), 4).cast("double")


def raw_metrics(cases: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the unrounded metrics of cases(gold, result, claims).

    NDCG's ideal counts the hits in the whole result, not the gold ids; a repeated id counts each
    time.  Without gold ids the retrieval metrics are 1, without claims the others are 0.  Lists are
    walked once: what is hit is noted first, and the rest reads these notes.
    """
    noted = cases.select(*keys, F.array_distinct(F.array_compact("gold")).alias("_g"), F.array_compact("result").alias("_r"), F.transform("claims", lambda c: c["verdict"]).alias("_v"), F.col("claims").alias("_c"))
    noted = noted.withColumns({"_hit": F.transform("_r", lambda x: F.array_contains("_g", x)), "_top": F.array_intersect(F.slice("_r", 1, 5), "_g")})
    cited = F.transform(F.filter("_c", lambda c: (c["verdict"] == "SUPPORTED") & (c["evidence"] >= 0) & (c["evidence"] < F.size("_r"))), lambda c: F.get("_r", c["evidence"]))
    count = lambda c, x: F.size(c) - F.size(F.array_remove(c, x))
    noted = noted.withColumns({"_first": F.array_position("_hit", True), "_hits": F.least(count("_hit", True), F.lit(5)), "_good": count("_v", "SUPPORTED"), "_bad": count("_v", "UNSUPPORTED"), "_cited": F.array_distinct(cited)})
    g, n = F.size("_g"), F.size("_v")
    total = lambda parts: sum(parts[1:], parts[0])
    gains = total([F.when(F.coalesce(F.get("_hit", F.lit(i)), F.lit(False)), 1.0 / math.log2(i + 2)).otherwise(0.0) for i in range(5)])
    ideal = total([F.when(F.col("_hits") > i, 1.0 / math.log2(i + 2)).otherwise(0.0) for i in range(5)])
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / F.when(b > 0, b))
    return noted.select(
        *keys,
        F.when(g == 0, 1.0).otherwise(ratio(F.size("_top"), g)).alias("recall5"),
        F.when(g == 0, 1.0).when(F.coalesce("_first", F.lit(0)) == 0, 0.0).otherwise(1.0 / F.when(F.col("_first") > 0, F.col("_first"))).alias("mrr"),
        F.when(g == 0, 1.0).when(F.col("_hits") == 0, 0.0).otherwise(gains / F.when(F.col("_hits") > 0, ideal)).alias("ndcg5"),
        ratio(F.col("_good"), n).alias("faithfulness"),
        ratio(F.col("_bad"), n).alias("hallucination"),
        ratio(F.size(F.array_intersect("_cited", "_g")), F.size("_cited")).alias("citation"),
    )


def without_failed(results: DataFrame, reason: str = "fail_reason") -> DataFrame:
    """Results whose run told no reason of failure: those that have one keep it and get no metrics."""
    return results.where(F.trim(F.coalesce(F.col(reason), F.lit(""))) == "")


def metrics(cases: DataFrame, keys: list[str]) -> DataFrame:
    return raw_metrics(cases, keys).select(*keys, *[_clamp(F.col(k)).alias(k) for k in GATES])


def gate(cases: DataFrame, keys: list[str], gates: dict[str, float] = GATES, enabled: bool = True) -> DataFrame:
    """keys, passed, reasons ("; " between): unrounded metrics against their thresholds."""
    if not enabled:
        return cases.select(*keys, F.lit(True).alias("passed"), F.lit("").alias("reasons"))
    failed = [F.when((F.col(k) > limit) if k == "hallucination" else (F.col(k) < limit), F.lit(k)) for k, limit in gates.items()]
    reasons = F.concat_ws("; ", *failed)
    return raw_metrics(cases, keys).select(*keys, (reasons == "").alias("passed"), reasons.alias("reasons"))


def task_report(results: DataFrame, task: str, names: list[str]) -> DataFrame:
    """Per task: cases, pass_rate, mean of each metric (nulls aside, none gives 0), gate_pass (all passed)."""
    mean = lambda c: F.round(F.coalesce(F.avg(c).cast("decimal(20,12)"), F.lit(0)), 4).cast("double")
    return results.groupBy(task).agg(F.count("*").alias("cases"), mean(F.col("passed").cast("int")).alias("pass_rate"), *[mean(F.col(k)).alias(k) for k in names], F.every("passed").alias("gate_pass"))
