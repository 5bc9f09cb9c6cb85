"""Evaluation runs: matrices, accuracy tables, traces, latency statistics and regression reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def matrix(questions: DataFrame, strategies: list[str], budgets: list[int], done: DataFrame | None = None) -> DataFrame:
    """Each question with each strategy and budget; what is ``done`` already is left out."""
    out = questions.withColumn("strategy", F.explode(F.array(*map(F.lit, strategies)))).withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    return out if done is None else out.join(done, ["question_id", "strategy", "budget"], "left_anti")


def category(question_id: Column, kind: Column) -> Column:
    return F.when(F.endswith(question_id, F.lit("_abs")), "Abstention").otherwise(kind)


def accuracy_table(runs: DataFrame, budgets: list[int], by: list[str] | None = None) -> DataFrame:
    """Per cent of correct runs, one decimal, a column for each budget."""
    return runs.groupBy(*(by or []), "strategy").pivot("budget", budgets).agg(F.round(100 * F.avg(F.col("correct").cast("int")), 1))


def efficiency(runs: DataFrame) -> DataFrame:
    return runs.groupBy("strategy", "budget").agg(F.round(F.avg("actual_tokens"), 6).alias("avg_tokens"), F.round(F.avg("build_ms"), 6).alias("avg_build_ms"), F.sum("llm_requests").alias("llm_requests"))


def summary(runs: DataFrame) -> DataFrame:
    return runs.agg(F.countDistinct("question_id").alias("questions"), F.count(F.lit(1)).alias("runs"), F.count_if(F.startswith("answer", F.lit("ERROR"))).alias("errors"))


def judged(verdict: Column, answer: Column) -> Column:
    return ~F.startswith(answer, F.lit("ERROR")) & F.startswith(F.upper(F.btrim(verdict)), F.lit("YES"))


def usage(runs: DataFrame) -> DataFrame:
    """Model requests and tokens of each strategy and budget, in all and on average."""
    sums = [f(c).alias(f"{n}_{c}") for c in ("llm_requests", "llm_tokens") for n, f in (("total", F.sum), ("avg", lambda x: F.round(F.avg(x), 6)))]
    return runs.groupBy("strategy", "budget").agg(*sums)


def retained(answers: DataFrame, items: DataFrame) -> DataFrame:
    """ctx_id, exact, part, present: an item is the answer's turn, holds its first 100 characters, or holds the answer in any case.

    ``answers``: ctx_id, answer and optionally turn_text, the text that the answer came from (by default the answer).
    """
    turn = F.col("turn_text") if "turn_text" in answers.columns else F.col("answer")
    both = answers.withColumn("turn_text", turn).join(items.select("ctx_id", "text"), "ctx_id", "left")
    exact = F.col("text") == F.col("turn_text")
    part = exact | F.contains("text", F.substring("turn_text", 1, 100))
    present = F.contains(F.lower("text"), F.lower("answer"))
    return both.groupBy("ctx_id").agg(*[F.coalesce(F.bool_or(x), F.lit(False)).alias(n) for n, x in (("exact", exact), ("part", part), ("present", present))])


def lost_step(steps: DataFrame, flag: str) -> DataFrame:
    """ctx_id, lost: the first step at which ``flag`` is false after it was true before."""
    was = F.max(flag).over(W.partitionBy("ctx_id").orderBy("step").rowsBetween(W.unboundedPreceding, -1))
    rows = steps.withColumn("__was", F.coalesce(was, F.lit(False)))
    return rows.groupBy("ctx_id").agg(F.min(F.when(F.col("__was") & ~F.col(flag), F.col("step"))).alias("lost"))


def trace(items: DataFrame, budget: int) -> DataFrame:
    """A row for each prefix of a context: its tokens, those that a build with oldest-first truncation keeps, and whether it overflows.

    A prefix of S tokens keeps S less the smallest earlier sum that leaves no more than the budget; a context's sums are one bounded array.
    """
    order = W.partitionBy("ctx_id").orderBy("seq")
    out = items.withColumns({"step": F.row_number().over(order), "total": F.sum("tokens").over(order)})
    sums = out.groupBy("ctx_id").agg(F.array_sort(F.collect_list(F.struct("step", "total"))).alias("all"))
    rows = sums.select("ctx_id", "all", F.explode("all").alias("x")).select("ctx_id", "x.step", "x.total", F.concat(F.array(F.lit(0).cast("bigint")), F.transform("all", lambda y: y["total"].cast("bigint"))).alias("before"))
    least = F.array_min(F.filter("before", lambda y: (y <= F.col("total")) & (F.col("total") - y <= budget)))
    rows = rows.withColumn("kept", (F.col("total") - least).cast("bigint")).drop("before")
    return rows.select("ctx_id", "step", "total", "kept", (F.col("total") > budget).alias("overflow"), (F.col("kept") / budget).alias("utilisation"))


def trace_report(steps: DataFrame) -> DataFrame:
    """Figures of each context's steps (step, kept, overflow, utilisation): first overflow, range and mean of utilisation, growth of tokens a step before
    the overflow, variance of utilisation in overflowing steps, and the step with the largest drop of tokens (none if they never drop)."""
    order = W.partitionBy("ctx_id").orderBy("step")
    rows = steps.withColumns({"drop": F.coalesce(F.lag("kept").over(order) - F.col("kept"), F.lit(0)), "first": F.min(F.when(F.col("overflow"), F.col("step"))).over(W.partitionBy("ctx_id"))})
    early, late = F.col("first").isNull() | (F.col("step") < F.col("first")), F.col("overflow")
    n_early = F.count_if(early)
    rise = F.max_by("kept", F.when(early, F.col("step"))) - F.min_by("kept", F.when(early, F.col("step")))
    out = rows.groupBy("ctx_id").agg(
        F.min("first").alias("first_overflow"), F.round(F.min("utilisation"), 6).alias("low"), F.round(F.max("utilisation"), 6).alias("high"), F.round(F.avg("utilisation"), 6).alias("mean"), F.round(F.max_by("utilisation", "step"), 6).alias("final"),
        F.when(n_early >= 2, F.round(rise / (n_early - 1), 6)).otherwise(F.lit(0.0)).alias("growth"), F.when(F.count_if(late) >= 2, F.round(F.var_pop(F.when(late, F.col("utilisation"))), 6)).otherwise(F.lit(0.0)).alias("variance"),
        F.max("drop").alias("largest_drop"), F.max_by("step", F.when(F.col("drop") > 0, F.struct("drop", -F.col("step")))).alias("drop_step"), F.count(F.lit(1)).alias("steps"),
    )
    return out.withColumn("largest_drop", F.greatest(F.lit(0), "largest_drop").cast("bigint")).withColumn("position", position(F.col("first_overflow"), F.col("steps")))


def build_times(steps: DataFrame, value: str = "build_ms") -> DataFrame:
    """Least, most, mean (whole) and sum of the times of a context's builds."""
    return steps.groupBy("ctx_id").agg(F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value)).cast("bigint").alias("mean"), F.sum(value).alias("total"))


def position(step: Column, steps: Column) -> Column:
    ratio = step / steps
    return F.when(ratio.isNull(), "never").when(ratio < 0.25, "early").when(ratio < 0.5, "first half").when(ratio < 0.75, "second half").otherwise("late")


def latencies(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Count, mean and interpolated and nearest-rank percentiles."""
    col = F.col(value)
    return rows.groupBy(*group).agg(F.count(col).alias("n"), F.round(F.avg(col), 6).alias("mean"), *[F.round(F.percentile(col, F.lit(p / 100)), 6).alias(f"p{p}") for p in (50, 95, 99)], F.round(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY `{value}`)"), 6).alias("p95_rank"))


def regressions(baseline: DataFrame, current: DataFrame, factor: float = 1.2) -> DataFrame:
    """``key``, ratio and status of means against a baseline: alert, faster, ok, new or removed."""
    both = baseline.select("key", F.col("mean").alias("old")).join(current.select("key", F.col("mean").alias("new")), "key", "full")
    ratio = F.try_divide("new", "old")
    status = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed").when(ratio > factor, "alert").when(ratio < 1 / factor, "faster").otherwise("ok")
    return both.select("key", F.round(ratio, 6).alias("ratio"), status.alias("status"))
