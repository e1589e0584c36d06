"""Call metering: summaries, daily trends and groupings with prices.

A call log has tenant, scenario, model, status, prompt_tokens, completion_tokens, elapsed_ms and
create_time; a price list has model_name, in_per_mtok, out_per_mtok and status (1 is enabled).
Costs are rounded half up to four decimals per row and side before they are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed value: how calls of a model without prices are named.
UNPRICED = "(未配置单价)"
_SUCCESS = ("SUCCESS", "DEGRADED")


def side_cost(tokens: Column, per_mtok: Column) -> Column:
    exact = F.coalesce(tokens, F.lit(0)).cast("decimal(20,0)") * per_mtok.cast("decimal(10,4)") / F.lit(1_000_000)
    return F.round(exact, 4).cast("decimal(20,4)")


def prices(models: DataFrame) -> DataFrame:
    """Enabled models with both prices, one row per name (the one with the largest id)."""
    usable = models.where("status = 1 AND in_per_mtok IS NOT NULL AND out_per_mtok IS NOT NULL")
    return usable.groupBy("model_name").agg(F.max_by("in_per_mtok", "id").alias("in_per_mtok"), F.max_by("out_per_mtok", "id").alias("out_per_mtok"))


def row_cost() -> Column:
    return side_cost(F.col("prompt_tokens"), F.col("in_per_mtok")) + side_cost(F.col("completion_tokens"), F.col("out_per_mtok"))


def _counts() -> list[Column]:
    prompt, completion = (F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).cast("long") for c in ("prompt_tokens", "completion_tokens"))
    n, good = F.count("*"), F.count_if(F.col("status").isin(*_SUCCESS))
    rate = F.when(n == 0, F.lit(0.0)).otherwise(F.round((good * 100).cast("decimal(20,4)") / F.when(n > 0, n).cast("decimal(20,0)"), 1).cast("double"))
    spent = F.coalesce(F.sum(F.coalesce("elapsed_ms", F.lit(0))), F.lit(0)).cast("long")
    mean = F.when(n == 0, F.lit(0)).otherwise(F.floor(spent / F.when(n > 0, n))).cast("long")
    return [n.alias("calls"), prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), (prompt + completion).alias("total_tokens"), rate.alias("success_rate"), mean.alias("avg_elapsed_ms")]


def summary(calls: DataFrame, models: DataFrame) -> DataFrame:
    """One row over all calls; calls of unpriced models cost nothing."""
    priced = calls.join(prices(models), F.col("model") == F.col("model_name"), "left")
    cost = F.coalesce(F.sum(row_cost()), F.lit(0)).cast("decimal(20,4)").alias("cost")
    return priced.agg(*_counts(), cost)


def trend(calls: DataFrame, default_in: Column, default_out: Column, now: DataFrame, days: int = 30) -> DataFrame:
    """A row per day from now - days to today, with zeros where nothing was called; now has one row and a column now."""
    days = min(days, 365)
    recent = calls.crossJoin(F.broadcast(now)).where(F.col("create_time") >= F.col("now") - F.expr(f"INTERVAL {days} DAYS"))
    cost = side_cost(F.col("prompt_tokens"), default_in) + side_cost(F.col("completion_tokens"), default_out)
    daily = recent.groupBy(F.to_date("create_time").alias("day")).agg(F.count("*").alias("calls"), F.sum(F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))).cast("long").alias("tokens"), F.sum(cost).alias("cost"))
    calendar = now.select(F.explode(F.sequence(F.to_date(F.col("now") - F.expr(f"INTERVAL {days} DAYS")), F.to_date("now"))).alias("day"))
    return calendar.join(daily, "day", "left").select("day", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("cost", F.lit(0)).cast("decimal(20,4)").alias("cost"))


#: What blank keys are named.
DEFAULTS = {"tenant": "*", "scenario": "*", "model": UNPRICED, "status": "UNKNOWN"}


def by(calls: DataFrame, dimension: str) -> DataFrame:
    """Calls per value of a dimension; blank values are named by DEFAULTS, and a group's cost is always 0."""
    key = F.coalesce(F.nullif(F.trim(F.col(dimension).cast("string")), F.lit("")), F.lit(DEFAULTS[dimension])).alias("key")
    return calls.groupBy(key).agg(*_counts()).withColumn("cost", F.lit(0).cast("decimal(20,4)"))


def all_dimensions(calls: DataFrame) -> DataFrame:
    """The four groupings in one pass."""
    keyed = calls.select(*[F.coalesce(F.col(c).cast("string"), F.lit(v)).alias(f"{c}_key") for c, v in DEFAULTS.items()], "prompt_tokens", "completion_tokens", "elapsed_ms", "status")
    keys = [F.col(f"{c}_key") for c in DEFAULTS]
    sets = [[k] for k in keys]
    grouped = keyed.groupingSets(sets, *keys).agg(F.count("*").alias("calls"), F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 7, "tenant").when(F.col("g") == 11, "scenario").when(F.col("g") == 13, "model").otherwise("status")
    return grouped.select(name.alias("dimension"), F.coalesce(*keys).alias("key"), "calls")
