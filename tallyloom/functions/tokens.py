"""Token counts as column expressions: character estimates, message overheads and conversation totals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

# Overhead tokens of each provider (per message, per conversation, per name).
OVERHEADS = [("anthropic", 3, 1, 0), ("google", 4, 2, 0), ("mistral", 4, 2, 1), ("ollama", 4, 2, 1), ("openai", 4, 2, 1)]
NON_TEXT_UNITS = 64


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def char_estimate(length: Column, per_token: int = 4) -> Column:
    """ceil(length / per_token), 0 for empty or null."""
    return F.when(length > 0, F.ceil(length / F.lit(max(1, per_token)))).otherwise(F.lit(0)).cast("bigint")


def text_estimate(text: Column) -> Column:
    """At least one token, as tool payloads count."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("bigint")


def fast_estimate(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / F.lit(3.5)).cast("bigint")


def parts_estimate(parts: Column) -> Column:
    """Parts (type, text): text lengths plus a fixed size for each other block, then the estimate of the sum."""
    size = F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, p: s + F.when(p["type"] == "text", F.coalesce(F.length(p["text"]), F.lit(0))).otherwise(F.lit(NON_TEXT_UNITS)))
    return char_estimate(size)


def payload_estimate(text: Column, parts: Column) -> Column:
    return F.when(text.isNotNull(), char_estimate(F.length(text))).otherwise(F.coalesce(parts_estimate(parts), F.lit(0).cast("bigint")))


def estimation_text(role: Column, name: Column, body: Column) -> Column:
    """role, name if there is one, and body, a line each."""
    return F.concat_ws("\n", role, F.when(F.length(name) > 0, name), body)


def overhead_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OVERHEADS, "provider string, per_message int, per_conversation int, per_name int")


def _overhead(provider: str) -> tuple[int, int, int]:
    known = {p: rest for p, *rest in OVERHEADS}
    return tuple(known.get(provider, known["openai"]))


def message_units(messages: DataFrame, provider: str) -> DataFrame:
    """``messages`` (role, name, text) with units: the estimate of the text form plus the overhead."""
    per_message, _, per_name = _overhead(provider)
    body = estimation_text(F.col("role"), F.col("name"), F.col("text"))
    named = F.when(F.length("name") > 0, F.lit(per_name)).otherwise(F.lit(0))
    return messages.withColumn("units", (char_estimate(F.length(body)) + per_message + named).cast("bigint"))


def conversation_units(messages: DataFrame, provider: str) -> DataFrame:
    """ctx_id, units: the messages' units and the conversation's overhead once."""
    _, per_conversation, _ = _overhead(provider)
    return message_units(messages, provider).groupBy("ctx_id").agg((F.sum("units") + per_conversation).alias("units"))


def structural_overhead(messages: DataFrame, provider: str) -> DataFrame:
    per_message, per_conversation, per_name = _overhead(provider)
    return messages.groupBy("ctx_id").agg((F.lit(per_conversation) + F.count(F.lit(1)) * per_message + F.count_if(F.length("name") > 0) * per_name).cast("bigint").alias("overhead"))


def truncate_to_tokens(text: Column, limit: int) -> Column:
    """The longest prefix whose estimate fits."""
    return F.substring(text, 1, 4 * max(0, limit))


def counted_once(items: DataFrame) -> DataFrame:
    """``items`` with tokens by counting each distinct text once and joining back: a set-based count cache."""
    counts = items.select("text").distinct().withColumn("counted", char_estimate(F.length("text")))
    return items.join(counts, items["text"].eqNullSafe(counts["text"]), "left").drop(counts["text"]).withColumn("tokens", F.coalesce("counted", F.lit(0))).drop("counted")


_BASIS, _PRIME = 2166136261, 16777619


def _fnv_texts(texts: list[str]) -> np.ndarray:
    """FNV-1a of each text over its UTF-16 code units, position by position over all texts that are long enough."""
    held = [t.encode("utf-16-le", "surrogatepass") for t in texts]
    flat, n = np.frombuffer(b"".join(held), np.uint16), np.array([len(b) // 2 for b in held], np.int64)
    order, start = np.argsort(-n, kind="stable"), np.cumsum(n) - n
    start, size, h = start[order], n[order], np.full(len(n), _BASIS, np.uint32)
    live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")  # texts longer than each position
    few = int(np.searchsorted(-live, -16, "left"))  # from here on so few that plain numbers are faster
    for i in range(few):
        k = live[i]
        h[:k] = (h[:k] ^ flat[start[:k] + i]) * np.uint32(_PRIME)
    for k in range(int(live[few]) if few < len(live) else 0):
        x = int(h[k])
        for c in flat[start[k] + few : start[k] + size[k]].tolist():
            x = (x ^ c) * _PRIME & 0xFFFFFFFF
        h[k] = x
    out = np.empty(len(n), np.int64)
    out[order] = h
    return out


def _fnv_pieces(texts: list[str], per_token: int) -> list[np.ndarray]:
    """FNV-1a of each piece of ``per_token`` characters of each text."""
    held = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    flat, n = np.frombuffer(b"".join(held), np.uint32), np.array([len(b) // 4 for b in held], np.int64)
    pieces, start = -(-n // per_token), np.cumsum(n) - n
    ends, row = np.cumsum(pieces), np.repeat(np.arange(len(n)), pieces)
    at = start[row] + (np.arange(len(row)) - (ends - pieces)[row]) * per_token
    left, h = (start + n)[row] - at, np.full(len(row), _BASIS, np.uint32)
    for i in range(per_token):
        c = flat[np.minimum(at + i, max(0, len(flat) - 1))] if len(flat) else h
        wide = c > 0xFFFF
        one = (h ^ np.where(wide, 0xD7C0 + (c >> np.uint32(10)), c)) * np.uint32(_PRIME)  # a pair of code units for characters beyond 16 bits
        both = np.where(wide, (one ^ (0xDC00 + (c & np.uint32(0x3FF)))) * np.uint32(_PRIME), one)
        h = np.where(i < left, both, h)
    return np.split(h.astype(np.int64), ends[:-1]) if texts else []


def fnv1a32(text: Column) -> Column:
    """FNV-1a over UTF-16 code units, 32 bits."""

    @pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(_fnv_texts(texts.fillna("").tolist()))

    return run(text)


def char_encode(text: Column, per_token: int = 4) -> Column:
    """A token id for each ``per_token`` characters: the FNV-1a hash of the piece. It can't be decoded."""

    @pandas_udf("array<bigint>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(_fnv_pieces(texts.fillna("").tolist(), per_token))

    return run(text)
