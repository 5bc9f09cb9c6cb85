"""Selection by vector similarity to an anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyloom.functions.vectors import cosine
from tallyloom.operators.overflow import greedy_fit


def scored(items: DataFrame, anchors: DataFrame) -> DataFrame:
    """``items`` (ctx_id, vector) with sim to their context's anchor (ctx_id, anchor); 0 without one or without a vector."""
    sim = F.coalesce(cosine(F.col("vector"), F.col("anchor")), F.lit(0.0))
    return items.join(anchors.select("ctx_id", "anchor"), "ctx_id", "left").withColumn("sim", sim).drop("anchor")


def _group(items: DataFrame) -> list[str]:
    return [c for c in ("ctx_id", "slot") if c in items.columns]


def with_threshold(items: DataFrame, fixed: float | None = None, k: float | None = 1.0) -> DataFrame:
    """``threshold``: the fixed one (0 by default), or where ``k`` is given the mean plus k deviations of a slot's unpinned items if that is higher."""
    low = F.lit(float(fixed or 0.0))
    if k is None:
        return items.withColumn("threshold", low)
    slot, free = W.partitionBy(*_group(items)), F.when(~F.col("pinned"), F.col("sim"))
    adaptive = F.coalesce(F.avg(free).over(slot) + k * F.stddev_pop(free).over(slot), F.lit(0.0))
    return items.withColumn("threshold", adaptive if fixed is None else F.greatest(low, adaptive))


def select(items: DataFrame, anchors: DataFrame, budget: int | Column, fixed: float | None = None, k: float | None = None) -> DataFrame:
    """Pinned items, and of the others that reach the threshold the most similar ones that still fit their slot, each by its turn."""
    group = _group(items)
    ready = with_threshold(scored(items, anchors), fixed, k)
    used = F.coalesce(F.sum(F.when(F.col("pinned"), F.col("tokens"))).over(W.partitionBy(*group)), F.lit(0))
    ready = ready.withColumn("room", ((F.lit(budget) if isinstance(budget, int) else budget) - used).cast("bigint")).withColumn("order", -F.col("sim"))
    fitting = greedy_fit(ready.filter((~F.col("pinned")) & (F.col("sim") >= F.col("threshold"))), F.col("room"), ["order", "created_at", "seq"], group)
    return ready.filter("pinned").unionByName(fitting).drop("order", "room")


def anchors_of(items: DataFrame, vector: str, to: str = "last_user", seq: int | None = None) -> DataFrame:
    """(ctx_id, anchor): the vector of the last user message, of the first system message, or of the item of a given seq."""
    if to == "last_user":
        return last_user_anchor(items, vector)
    if to == "system":
        return items.filter("role = 'system'").groupBy("ctx_id").agg(F.min_by(vector, F.struct("created_at", "seq")).alias("anchor"))
    if to == "item" and seq is not None:
        return items.filter(F.col("seq") == seq).groupBy("ctx_id").agg(F.any_value(vector).alias("anchor"))
    raise ValueError(f"unknown anchor {to!r}")


def literal_anchor(contexts: DataFrame, function, text: str) -> DataFrame:
    """(ctx_id, anchor): one text's vector for all contexts; an empty text has none."""
    vector = [float(x) for x in function([text.strip()])[0]] if text.strip() else []
    return contexts.select("ctx_id").distinct().withColumn("anchor", F.array(*map(F.lit, vector)) if vector else F.expr("cast(array() as array<double>)"))


def last_user_anchor(items: DataFrame, vector: str) -> DataFrame:
    return items.filter("role = 'user'").groupBy("ctx_id").agg(F.max_by(vector, F.struct("created_at", "seq")).alias("anchor"))


def embed(items: DataFrame, function) -> DataFrame:
    """``items`` with vector by a user's function from a list of texts to a list of vectors (an Arrow batch at a time)."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(function(texts.fillna("").tolist()))

    return items.withColumn("vector", run("text"))
