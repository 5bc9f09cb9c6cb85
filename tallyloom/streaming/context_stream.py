"""Structured Streaming over context events and items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_roll_up(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts and sums by type and tumbling window, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def rebuild_on_change(items: DataFrame, checkpoint: str, build: Callable[[DataFrame, int], None], once: bool = True):
    """Call ``build`` with each micro-batch's latest rows by key: many changes in a batch make one rebuild."""
    def latest(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("ctx_id").agg(F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("changes"), F.sum("tokens").alias("tokens"))
        build(newest, number)

    writer = items.writeStream.option("checkpointLocation", checkpoint).foreachBatch(latest)
    return (writer.trigger(availableNow=True) if once else writer).start()


def build_stream(plan, items: DataFrame, checkpoint: str, path: str, once: bool = True):
    """Build the contexts of each micro-batch of items; their slots go to ``path``/slots in reading order, finished contexts to ``path``/complete.

    Each micro-batch writes folders of its own number, so that a batch that is run again replaces what it wrote. Returns the running query,
    the handle to await or stop.
    """
    def run(batch: DataFrame, number: int) -> None:
        built = plan.build(batch)
        built.ready().write.mode("overwrite").parquet(f"{path}/slots/batch={number}")
        built.events().filter("type = 'build:complete'").write.mode("overwrite").parquet(f"{path}/complete/batch={number}")

    writer = items.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_window(items: DataFrame, budget: int) -> DataFrame:
    """ctx_id, kept, tokens after each batch: a state of each context's newest items that fit, oldest out first.

    A batch's items of a context are put in order of seq as a whole; its state holds no more than the items within its budget.
    """
    import pandas as pd

    def update(key, batches, state):
        held = list(state.get[0]) if state.exists else []
        rows = [(int(s), int(t)) for pdf in batches for s, t in zip(pdf["seq"], pdf["tokens"])]
        held += [t for _, t in sorted(rows)]
        total, at = sum(held), 0
        while at < len(held) and total > budget:
            total -= held[at]
            at += 1
        held = held[at:]
        state.update((held,))
        yield pd.DataFrame({"ctx_id": [key[0]], "kept": [len(held)], "tokens": [total]})

    return items.groupBy("ctx_id").applyInPandasWithState(update, "ctx_id bigint, kept bigint, tokens bigint", "held array<bigint>", "update", "NoTimeout")
