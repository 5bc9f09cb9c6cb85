"""Streaming operators run over the tables as streams until all rows are read, with the SQL of the same rows in batch."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F, types as T

from tallyloom.plans.base import ITEMS, with_query
from tallyloom.registry import register
from tallyloom.streaming import context_stream as cs


def _drained(spark, stream, keys: list[str]):
    """The latest row of each key in a table that the stream's batches are written to, once it has read everything there is."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local[") and spark.conf.get("spark.master", "local") != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/tallyloom-shared"
    path = f"{root.rstrip('/')}/tallyloom/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def write(batch, number: int) -> None:  # a batch that is run again replaces its folder
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").outputMode("update").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{path}/rows")
    others = [f.name for f in schema if f.name not in keys and f.name != "batch"]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in others])


def _as_stream(spark, sf_dir, name):
    path = f"{sf_dir}/{name}.parquet"
    reader, at = spark.readStream.schema(spark.read.parquet(path).schema), spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)  # a stream's source is a folder


@register("str_windowed", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def str_windowed(spark, sf_dir):
    events = _as_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rolled = cs.windowed_roll_up(events, "1 day", "1 hour")
    return _drained(spark, rolled, ["start", "event_type"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("str_running_window", with_query(ITEMS + ", r AS (SELECT ctx_id, tokens, sum(tokens) OVER (PARTITION BY ctx_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS back FROM items)", "SELECT ctx_id, count(*) FILTER (back <= 150) AS kept, CAST(coalesce(sum(tokens) FILTER (back <= 150), 0) AS BIGINT) AS tokens FROM r GROUP BY ctx_id"))
def str_running_window(spark, sf_dir):
    """The newest items of each context that fit, as state. The table is one batch here, so that each context reports once."""
    from tallyloom.functions.tokens import char_estimate

    items = _as_stream(spark, sf_dir, "conversations").select(F.col("conv_id").alias("ctx_id"), F.col("turn").alias("seq"), char_estimate(F.length("text")).alias("tokens"))
    return _drained(spark, cs.running_window(items, 150), ["ctx_id"])
