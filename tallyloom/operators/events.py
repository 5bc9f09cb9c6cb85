"""Pipeline events: roll-ups, ratios, span pairing, ring buffers, histograms and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def last_n(events: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` events: a ring buffer's content."""
    return events.orderBy(F.desc("event_seq")).limit(n)


def roll_up(events: DataFrame) -> DataFrame:
    return events.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("top"))


def compression_ratio(before: Column, after: Column) -> Column:
    return F.when(before > 0, 1 - after / before).otherwise(F.lit(0.0))


def spans(events: DataFrame, start: str, end: str) -> DataFrame:
    """Each ``end`` event with the last ``start`` of its key before it: key, start_seq, end_seq, duration."""
    order = W.partitionBy("key").orderBy("event_seq").rowsBetween(W.unboundedPreceding, -1)
    opened = F.last(F.when(F.col("type") == start, F.struct("event_seq", "ts_ms")), ignorenulls=True).over(order)
    rows = events.filter(F.col("type").isin(start, end)).withColumn("opened", opened)
    return rows.filter((F.col("type") == end) & F.col("opened").isNotNull()).select("key", F.col("opened.event_seq").alias("start_seq"), F.col("event_seq").alias("end_seq"), (F.col("ts_ms") - F.col("opened.ts_ms")).alias("duration"))


def histogram(events: DataFrame, value: Column, width: float) -> DataFrame:
    return events.groupBy("type", F.floor(value / width).cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def near_limit(items: DataFrame, max_items: int = 10_000) -> DataFrame:
    """Slots that hold 80 % of their bound or more."""
    return items.groupBy("ctx_id", "slot").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(1, max_items * 8 // 10))


def latest_per_key(events: DataFrame) -> DataFrame:
    """The last event of each key: what a debounced rebuild sees of a batch."""
    return events.groupBy("key").agg(F.max_by(F.struct("event_seq", "type", "value"), "event_seq").alias("x")).select("key", "x.*")


def summary_text(kind: Column, key: Column, value: Column) -> Column:
    return F.format_string("%s %s: %.2f", kind, key.cast("string"), value)


# A line of a timeline for each type of event; {slot} and {detail} stand for the event's own.
_LINES = {
    "content:added": ("Added to {slot}", ""), "content:evicted": ("Evicted from {slot}", " · {detail}"), "content:pinned": ("Pinned in {slot}", ""), "slot:overflow": ("Overflow {slot}", " · {detail}"), "slot:budget-resolved": ("Budget resolved {slot}", " → {detail} tok"),
    "compression:start": ("Compress start {slot}", " ({detail} items)"), "compression:complete": ("Compress done {slot}", " {detail}"), "build:start": ("Build start", " · budget {detail}"), "build:complete": ("Build complete", ""), "warning": ("Warning", ": {detail}"),
}


def timeline(kind: Column, slot: Column, detail: Column) -> Column:
    """A build's event as a line of text; an unknown slot shows as a question mark, a missing detail is left out."""
    def fill(text: str) -> list[Column]:
        out = []
        for part in text.replace("{slot}", "\0s\0").replace("{detail}", "\0d\0").split("\0"):
            out.append(F.when(F.length(slot) > 0, slot).otherwise("?") if part == "s" else detail if part == "d" else F.lit(part))
        return out

    line = F.when(F.length(slot) > 0, F.concat(kind, F.lit(" · "), slot)).otherwise(kind)
    for name, (head, tail) in _LINES.items():
        rest = F.when(F.length(detail) > 0, F.concat(*fill(tail))).otherwise("") if tail else F.lit("")
        line = F.when(kind == name, F.concat(*fill(head), rest)).otherwise(line)
    return line


def should_redact(redaction: bool = True, level: str = "info") -> bool:
    """On by default; off where redaction is turned off or the log level is trace."""
    return redaction and level != "trace"


def redacted(events: DataFrame, redaction: bool = True, level: str = "info", **how) -> DataFrame:
    """Events whose strings are redacted, also inside structs, arrays and maps; the type and the slot's name stay."""
    from tallyloom.functions.text import redact_all

    if not should_redact(redaction, level):
        return events
    return events.select(*[F.col(f.name) if f.name in ("type", "slot") else redact_all(F.col(f.name), f.dataType, **how).alias(f.name) for f in events.schema])


def as_json(events: DataFrame) -> DataFrame:
    """ctx_id, body: each event as JSON of all its columns but those that are null."""
    return events.select("ctx_id", F.to_json(F.struct(*[F.col(c) for c in events.columns])).alias("body"))
