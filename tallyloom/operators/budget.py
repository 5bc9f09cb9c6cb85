"""Budget allocation over slots, for any number of contexts at once, as ranked window waterfalls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

SLOT_SCHEMA = "slot string, priority int, budget_kind string, fixed bigint, percent double, min bigint, max bigint, overflow string, position string, ord double, max_items int, protected boolean, default_role string"
UNBOUNDED = (1 << 53) - 1
DEFAULT_MAX_TOKENS = 8192


def _slot(name, priority, kind, amount, overflow, position, role, order=None):
    return (name, priority, kind, amount if kind == "fixed" else None, amount if kind == "percent" else None, None, None, overflow, position, order, None, False, role)


# Slot presets.
PRESETS = {
    "chat": [_slot("system", 100, "fixed", 2000, "error", "before", "system"), _slot("history", 50, "flex", None, "summarize", "after", "user")],
    "rag": [_slot("system", 100, "fixed", 2000, "error", "before", "system"), _slot("rag", 80, "flex", None, "truncate", "before", "user"), _slot("history", 50, "flex", None, "summarize", "after", "user"), _slot("output", 40, "flex", None, "truncate", "after", "assistant")],
    "agent": [_slot("system", 100, "fixed", 2000, "error", "before", "system"), _slot("tools", 85, "flex", None, "truncate", "before", "tool"), _slot("scratchpad", 65, "flex", None, "truncate", "interleave", "user", 10.0), _slot("history", 50, "flex", None, "summarize", "after", "user")],
}


def preset(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(PRESETS[name], SLOT_SCHEMA)


def merged_slots(base: DataFrame, override: DataFrame) -> DataFrame:
    """Slots of both; a slot of ``override`` replaces the one of ``base``."""
    return base.join(override.select("slot"), "slot", "left_anti").unionByName(override, allowMissingColumns=True)


def total_budget(max_tokens, reserve):
    return F.greatest(F.lit(0), F.coalesce(max_tokens, F.lit(DEFAULT_MAX_TOKENS)) - F.coalesce(reserve, F.lit(0)))


def allocate(slots: DataFrame) -> DataFrame:
    """``slots`` (ctx_id, total, slot, priority, budget_kind, fixed, percent, min, max) with ``allocated`` and ``error``.

    Fixed slots get their amount, percent slots a floor share of what is left, flex slots their minimum, an even part
    up to their maximum, and the leftover in order of priority. Without flex slots the whole rest is dealt to the percent slots
    one by one. ``error`` names what can't be satisfied (then ``allocated`` is null): fixed_exceeds_total,
    percent_exceeds_100, min_exceeds_pool.
    """
    ctx = W.partitionBy("ctx_id")
    ranked = W.partitionBy("ctx_id", "budget_kind").orderBy(F.desc("priority"), "slot")
    kind = lambda k: F.col("budget_kind") == k
    s = slots.withColumns({"rn": F.row_number().over(ranked), "n_flex": F.count_if(kind("flex")).over(ctx), "n_percent": F.count_if(kind("percent")).over(ctx), "sum_fixed": F.coalesce(F.sum(F.when(kind("fixed"), F.col("fixed"))).over(ctx), F.lit(0)), "sum_percent": F.coalesce(F.sum(F.when(kind("percent"), F.col("percent"))).over(ctx), F.lit(0.0))})
    s = s.withColumn("after_fixed", F.col("total") - F.col("sum_fixed"))
    s = s.withColumn("base", F.when(kind("percent"), F.floor(F.col("after_fixed") * F.col("percent") / 100)).cast("bigint"))
    s = s.withColumn("pool", F.col("after_fixed") - F.coalesce(F.sum("base").over(ctx), F.lit(0)))
    low, high = F.coalesce("min", F.lit(0)), F.coalesce("max", F.lit(UNBOUNDED))
    s = s.withColumn("sum_min", F.coalesce(F.sum(F.when(kind("flex"), low)).over(ctx), F.lit(0)))
    even = F.floor((F.col("pool") - F.col("sum_min")) / F.greatest(F.col("n_flex"), F.lit(1)))
    s = s.withColumn("first_part", F.when(kind("flex"), F.least(high, low + even)).cast("bigint"))
    s = s.withColumn("rest", F.col("pool") - F.coalesce(F.sum("first_part").over(ctx), F.lit(0)))
    s = s.withColumn("room", F.when(kind("flex"), F.least(high - F.col("first_part"), F.greatest(F.col("rest"), F.lit(0)))))
    earlier = F.coalesce(F.sum("room").over(ranked.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    flex = F.col("first_part") + F.greatest(F.lit(0), F.least(F.col("room"), F.col("rest") - earlier))
    bonus, n = F.col("pool"), F.greatest(F.col("n_percent"), F.lit(1))
    percent = F.col("base") + F.when((F.col("n_flex") == 0) & (bonus > 0), F.floor(bonus / n) + F.when(F.col("rn") <= bonus % n, 1).otherwise(0)).otherwise(0)
    error = F.when(F.col("sum_fixed") > F.col("total"), "fixed_exceeds_total").when(F.col("sum_percent") > 100, "percent_exceeds_100").when((F.col("n_flex") > 0) & (F.col("sum_min") > F.col("pool")), "min_exceeds_pool")
    amount = F.when(kind("fixed"), F.col("fixed")).when(kind("percent"), percent).when(kind("flex"), flex).otherwise(0).cast("bigint")
    return s.withColumn("error", error).withColumn("allocated", F.when(F.col("error").isNull(), amount)).select(*slots.columns, "allocated", "error")


def utilisation(used, budget, factor=1.0):
    """What-if utilisation in per cent, one decimal."""
    return F.round(F.least(F.lit(1.0), used / F.greatest(F.lit(1.0), budget * factor)) * 100, 1)


def share(budget, total):
    """A slot's part of the whole in per cent, as a waterfall shows it."""
    return budget / F.greatest(F.lit(1), total) * 100
