"""Overflow policies: which items of a slot stay within its budget.

Items have ctx_id, slot, seq, tokens, pinned; budgets come as a column. A slot's items are bounded by its max_items (10 000
by default), so that windows and folds over one slot stay small at any number of contexts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SLOT = ("ctx_id", "slot")
DEFAULT_WINDOW = 10
PROACTIVE = ("compress", "summarize", "semantic")


def _slot() -> W:
    return W.partitionBy(*SLOT)


def _tokens() -> Column:
    return F.coalesce("tokens", F.lit(0))


def _free() -> Column:
    return F.when(~F.coalesce("pinned", F.lit(False)), _tokens()).otherwise(0)


def _pinned() -> Column:
    return F.sum(F.when(F.coalesce("pinned", F.lit(False)), _tokens()).otherwise(0)).over(_slot())


def truncate_keep(budget: Column) -> Column:
    """Oldest first out: an item stays if the pinned ones, itself and all younger ones fit."""
    younger = F.sum(_free()).over(_slot().orderBy("seq").rowsBetween(0, W.unboundedFollowing))
    return F.coalesce("pinned", F.lit(False)) | (_pinned() + younger <= budget)


def truncate_latest_keep(budget: Column) -> Column:
    """Newest first out."""
    older = F.sum(_free()).over(_slot().orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    return F.coalesce("pinned", F.lit(False)) | (_pinned() + older <= budget)


def truncate(items: DataFrame, budget: Column) -> DataFrame:
    return items.withColumn("__keep", truncate_keep(budget)).filter("__keep").drop("__keep")


def truncate_latest(items: DataFrame, budget: Column) -> DataFrame:
    return items.withColumn("__keep", truncate_latest_keep(budget)).filter("__keep").drop("__keep")


def sliding_window(items: DataFrame, budget: Column, size: int | Column | None = None) -> DataFrame:
    """Pinned items and the last ``size`` others, then oldest first out."""
    size = size if isinstance(size, Column) else F.lit(max(1, int(size if size is not None else DEFAULT_WINDOW)))
    back = F.sum(F.when(F.coalesce("pinned", F.lit(False)), 0).otherwise(1)).over(_slot().orderBy("seq").rowsBetween(0, W.unboundedFollowing))
    return truncate(items.withColumn("__back", back).filter(F.coalesce("pinned", F.lit(False)) | (F.col("__back") <= size)).drop("__back"), budget)


def violations(items: DataFrame, budget: Column) -> DataFrame:
    """The error policy: slots over their budget, with both figures."""
    return items.groupBy(*SLOT).agg(F.sum(_tokens()).alias("used"), F.max(budget).alias("budget")).filter("used > budget")


def compress_text(items: DataFrame, rewrite: Callable[[Column], Column]) -> DataFrame:
    """The lossless policy: texts are rewritten, whatever the budget; token counts stay as they were."""
    return items.withColumn("text", rewrite(F.col("text")))


def custom(items: DataFrame, policy: Callable, schema: str | None = None) -> DataFrame:
    """A user's policy over each slot's items (pandas in, pandas out)."""
    return items.groupBy(*SLOT).applyInPandas(policy, schema or items.schema)


class ContextOverflow(RuntimeError):
    """A slot is over its budget and its policy allows no more."""


def demand(items: DataFrame, budget: Column) -> DataFrame:
    """``items`` as they are; raises if a slot is over its budget. A job that reads two figures of each slot."""
    if (over := violations(items, budget).first()) is not None:
        raise ContextOverflow(f"slot {over['slot']!r} of context {over['ctx_id']} has {over['used']} of {over['budget']} tokens")
    return items


def fallback_chain(items: DataFrame, budget: Column, steps: list[Callable[[DataFrame], DataFrame]], strict: bool = False) -> DataFrame:
    """Steps in order until a slot fits; slots that fit already pass by, and truncation comes last.

    A slot that truncation can't bring to its budget, for its pinned items, is an error: ``strict`` raises it, else such slots
    pass and ``violations`` tells them.
    """
    rest, done = items, None
    for step in steps:
        fits = F.sum(_tokens()).over(_slot()) <= budget
        rest = rest.withColumn("__fits", fits)
        passed = rest.filter("__fits").drop("__fits")
        done = passed if done is None else done.unionByName(passed)
        rest = step(rest.filter("NOT __fits").drop("__fits"))
    last = truncate(rest, budget)
    out = last if done is None else done.unionByName(last)
    return demand(out, budget) if strict else out


def triggers(slots: DataFrame, force: bool = False, threshold: float | None = None, ratio: float = 0.3) -> DataFrame:
    """``slots`` (used, budget, overflow, protected) with ``action`` and ``effective``, the budget the policy works to.

    Actions: none, overflow, force, proactive, protected (over budget, but not to be touched).
    """
    over = F.col("used") > F.col("budget")
    proactive = F.lit(False) if threshold is None else F.col("overflow").isin(*PROACTIVE) & (F.col("used") > F.col("budget") * threshold) & ~over
    forced = F.lit(force) & ~over & (F.col("overflow") != "error")
    action = F.when(F.coalesce("protected", F.lit(False)) & over, "protected").when(F.coalesce("protected", F.lit(False)), "none").when(over, "overflow").when(forced, "force").when(proactive, "proactive").otherwise("none")
    effective = F.when(F.col("action") == "force", F.floor(F.col("used") * 0.5)).when(F.col("action") == "proactive", F.floor(F.col("used") * (1 - ratio))).otherwise(F.col("budget")).cast("bigint")
    return slots.withColumn("action", action).withColumn("effective", effective)


def evicted(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """Items of ``before`` that ``after`` lacks, with the reason."""
    return before.join(after.select(*SLOT, "seq"), [*SLOT, "seq"], "left_anti").withColumn("reason", F.lit(f"overflow:{label}"))


def escalate(items: DataFrame, slots: DataFrame, total: Column) -> DataFrame:
    """Empty whole slots of their unpinned items, lowest priority first, until a context fits in ``total``.

    ``slots``: ctx_id, slot, priority, protected. ``total`` is a column of ``slots``. Valid after policies that are
    stable when repeated (truncation, windows), as these are.
    """
    sums = items.groupBy(*SLOT).agg(F.sum(_tokens()).alias("__used"), F.sum(_free()).alias("__free"))
    known = slots.select("ctx_id", "slot", "priority", "protected", total.alias("__total")).join(sums, [*SLOT], "left").fillna(0, ["__used", "__free"])
    gain = F.when(F.coalesce("protected", F.lit(False)), 0).otherwise(F.col("__free"))
    order = W.partitionBy("ctx_id").orderBy("priority", "slot")
    before = F.coalesce(F.sum(gain).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    emptied = known.withColumn("__emptied", ~F.coalesce("protected", F.lit(False)) & (F.sum("__used").over(W.partitionBy("ctx_id")) - before > F.col("__total")))
    out = items.join(emptied.select(*SLOT, "__emptied"), [*SLOT], "left")
    return out.filter(F.coalesce("pinned", F.lit(False)) | ~F.coalesce("__emptied", F.lit(False))).drop("__emptied")


def escalation_warnings(items: DataFrame, totals: DataFrame) -> DataFrame:
    """Contexts that are still over their total: nothing was left to empty."""
    return items.groupBy("ctx_id").agg(F.sum(_tokens()).alias("used")).join(totals, "ctx_id").filter("used > total").withColumn("warning", F.lit("ESCALATION_EXHAUSTED"))


def greedy_fit(items: DataFrame, budget: int | Column, by: list[str], group: list[str]) -> DataFrame:
    """In order ``by``, each item that still fits is taken; one that doesn't is skipped.

    A fold over a group's sorted counts alone; the rows are joined back by their place. Where an item of some count doesn't fit, none of
    that count fits later, so that of each count only the first ones that could fill the budget take part: the fold is bounded by the budget, whatever a
    group's size. Counts are not negative.
    """
    budget = F.lit(budget) if isinstance(budget, int) else budget
    count = _tokens().cast("bigint")
    ranked = items.withColumns({"__budget": budget.cast("bigint"), "__count": count}).withColumn("__nth", F.row_number().over(W.partitionBy(*group, "__count").orderBy(*by)))
    first = ranked.filter((F.col("__count") <= 0) | (F.col("__nth") * F.col("__count") <= F.col("__budget"))).drop("__nth")
    placed = first.withColumn("__place", F.row_number().over(W.partitionBy(*group).orderBy(*by)))
    grouped = placed.filter("__count <> 0").groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("__place", _tokens().cast("bigint").alias("t")))).alias("__all"), F.max("__budget").alias("__budget"))
    empty = F.struct(F.lit(0).cast("bigint").alias("used"), F.expr("cast(array() as array<int>)").alias("kept"))

    def take(s, x):
        fits = s["used"] + x["t"] <= F.col("__budget")
        return F.struct(F.when(fits, s["used"] + x["t"]).otherwise(s["used"]).alias("used"), F.when(fits, F.array_append(s["kept"], x["__place"])).otherwise(s["kept"]).alias("kept"))

    kept = grouped.select(*group, F.explode(F.aggregate("__all", empty, take)["kept"]).alias("__place"), F.lit(True).alias("__taken"))
    free = (F.col("__count") == 0) & (F.col("__budget") >= 0)  # fits at any time
    return placed.join(kept, [*group, "__place"], "left").filter(F.coalesce("__taken", free)).select(*items.columns)
