"""Relations that the registered queries share, in Spark and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.functions.tokens import char_estimate


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chat_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as items: system turns are pinned and have a slot of their own."""
    system = F.col("role") == "system"
    return load(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("ctx_id"), F.when(system, "system").otherwise("history").alias("slot"), F.col("turn").alias("seq"), "role", F.coalesce("text", F.lit("")).alias("text"),
        char_estimate(F.length("text")).alias("tokens"), system.alias("pinned"), (F.col("turn") * 1000).alias("created_at"),
    )


ITEMS = """items AS (SELECT conv_id AS ctx_id, CASE WHEN role = 'system' THEN 'system' ELSE 'history' END AS slot, turn AS seq, role, coalesce(text, '') AS text,
  CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens, role = 'system' AS pinned, turn * 1000 AS created_at FROM conversations)"""


def rag_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as retrieved chunks of 20 contexts, scored by label and length."""
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    return load(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        (F.col("doc_id") % 20).alias("ctx_id"), F.lit("rag").alias("slot"), F.col("doc_id").alias("seq"), "text", (F.coalesce("quality", F.lit(0)) + F.round(F.col("n_chars") / 1e6, 6)).alias("score"),
        char_estimate(F.length("text")).alias("tokens"), F.lit(False).alias("pinned"), (F.col("doc_id") * 1000).alias("created_at"), (F.col("doc_id") % 10 == 0).alias("definition"),
    )


RAG = """rag AS (SELECT doc_id % 20 AS ctx_id, 'rag' AS slot, doc_id AS seq, text, coalesce(quality, 0) + round(n_chars / 1e6, 6) AS score,
  CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, false AS pinned, doc_id * 1000 AS created_at, doc_id % 10 = 0 AS definition FROM documents LEFT JOIN labels USING (doc_id))"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("subject"), F.col("event_type").alias("predicate"), F.col("props").alias("value"), F.round(0.1 + 0.9 * (F.col("event_id") % 10) / 9, 6).alias("confidence"),
        F.floor(F.col("event_id") / 7).cast("bigint").alias("created_at"), F.col("event_id").alias("seq"),
    )


FACTS = """facts AS (SELECT CAST(user_id AS VARCHAR) AS subject, event_type AS predicate, props AS value, round(0.1 + 0.9 * (event_id % 10) / 9, 6) AS confidence,
  event_id // 7 AS created_at, event_id AS seq FROM events)"""


def budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of every conversation with a total that varies from one to the next."""
    totals = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("ctx_id")).distinct().withColumn("total", F.lit(900) + F.col("ctx_id") % 7 * 100)
    slots = spark.createDataFrame(
        [("system", 100, "fixed", 100, None, None, None), ("tools", 80, "percent", None, 20.0, None, None), ("memory", 60, "flex", None, None, 10, 55), ("scratch", 60, "flex", None, None, 10, 15), ("history", 50, "flex", None, None, None, None)],
        "slot string, priority int, budget_kind string, fixed bigint, percent double, min bigint, max bigint",
    )
    return totals.join(F.broadcast(slots), how="cross")  # five literal slots for each context


def with_query(sql_ctes: str, rest: str) -> str:
    return f"WITH {sql_ctes}\n{rest}"
