"""The content store: item tables and what changes them, checkpoints, JSON lines and memory tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tallyloom.operators.snapshot import slot_signatures

KEY = ["ctx_id", "slot", "seq"]
MAX_ITEMS = 10_000


def append(items: DataFrame, more: DataFrame, slots: list[str], max_items: int = MAX_ITEMS) -> tuple[DataFrame, DataFrame]:
    """Both tables' rows, renumbered behind those there are, and the rows refused: unknown slot or a full one."""
    last = items.groupBy("ctx_id", "slot").agg(F.max("seq").alias("__last"), F.count(F.lit(1)).alias("__n"))
    at = F.row_number().over(W.partitionBy("ctx_id", "slot").orderBy("seq"))
    new = more.withColumn("__at", at).join(last, ["ctx_id", "slot"], "left")
    reason = F.when(~F.col("slot").isin(*slots), "unknown_slot").when(F.coalesce("__n", F.lit(0)) + F.col("__at") > max_items, "max_items")
    new = new.withColumn("reason", reason).withColumn("seq", (F.coalesce("__last", F.lit(-1)) + F.col("__at")).cast("bigint"))
    return items.unionByName(new.filter("reason is null").select(*items.columns)), new.filter("reason is not null").select(*more.columns, "reason")


def remove(items: DataFrame, keys: DataFrame) -> DataFrame:
    return items.join(keys.select(*KEY), KEY, "left_anti")


def _flag(items: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    marked = keys.select(*KEY).distinct().withColumn("__m", F.lit(True))
    old = F.col(name) if name in items.columns else F.lit(False)
    return items.join(marked, KEY, "left").withColumn(name, F.coalesce(F.col("__m"), old)).drop("__m")


def pin(items: DataFrame, keys: DataFrame) -> DataFrame:
    return _flag(items, keys, "pinned")


def mark_ephemeral(items: DataFrame, keys: DataFrame) -> DataFrame:
    return _flag(items, keys, "ephemeral")


def clear_ephemeral(items: DataFrame) -> DataFrame:
    return items.filter(~F.coalesce("ephemeral", F.lit(False)))


def write_back_tokens(items: DataFrame, counted: DataFrame) -> DataFrame:
    new = counted.select(*KEY, F.col("tokens").alias("__t"))
    return items.join(new, KEY, "left").withColumn("tokens", F.coalesce("__t", "tokens")).drop("__t")


def checkpoint(items: DataFrame, path: str, version: int) -> DataFrame:
    """Write a version of all items; returns the slots that changed since the version before."""
    spark = items.sparkSession
    items.write.mode("overwrite").parquet(f"{path}/version={version}")
    now = slot_signatures(spark.read.schema(items.schema).parquet(f"{path}/version={version}"))
    if version == 0:
        return now.select("ctx_id", "slot")
    then = slot_signatures(spark.read.schema(items.schema).parquet(f"{path}/version={version - 1}"))
    both = now.join(then.withColumnRenamed("signature", "old"), ["ctx_id", "slot"], "full")
    return both.filter(~F.col("signature").eqNullSafe(F.col("old"))).select("ctx_id", "slot")


def read_slot(items: DataFrame, slot: str) -> DataFrame:
    """A slot's items in their order."""
    return items.filter(F.col("slot") == slot).orderBy("ctx_id", "seq")


def read_item(items: DataFrame, ctx_id, slot: str, seq: int) -> DataFrame:
    return items.filter((F.col("ctx_id") == ctx_id) & (F.col("slot") == slot) & (F.col("seq") == seq))


class StoreError(ValueError):
    """Items that can't be restored or changed."""


def known(items: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` as they are; raises if one of them names no item."""
    if (lost := keys.join(items.select(*KEY), KEY, "left_anti").first()) is not None:
        raise StoreError(f"no item {lost['seq']} in slot {lost['slot']!r} of context {lost['ctx_id']}")
    return keys


def replace_all(items: DataFrame, slots: list[str], max_items: int = MAX_ITEMS) -> DataFrame:
    """Items that take the place of all there were; unknown slots and slots over their bound raise."""
    sizes = items.groupBy("ctx_id", "slot").agg(F.count(F.lit(1)).alias("n"))
    if (bad := sizes.filter(~F.col("slot").isin(*slots) | (F.col("n") > max_items)).first()) is not None:
        raise StoreError(f"slot {bad['slot']!r} of context {bad['ctx_id']} is unknown or has {bad['n']} items, over {max_items}")
    return items


def restore(spark: SparkSession, path: str, version: int, slots: list[str] | None = None) -> DataFrame:
    """A checkpoint's items; with ``slots`` they are validated as in ``replace_all``. A version that isn't there raises."""
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={version}/_SUCCESS")
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        raise StoreError(f"no version {version} at {path}")
    items = spark.read.parquet(f"{path}/version={version}")
    return items if slots is None else replace_all(items, slots)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Data rows of a JSON-lines file; rows with a _type are headers."""
    return spark.read.schema(f"{schema}, _type string").json(path).filter("_type is null").drop("_type")


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a run that resumes has still to do."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")
