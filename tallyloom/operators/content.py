"""Content of items and messages: a text or parts, tool fields, and how items are made and read.

A message has role, text or parts (an array of type, text, url, data, mime), name, tool_call_id and tool_uses (an array of
id, name, input, where input is JSON text). ``complete`` adds the columns that a relation lacks as nulls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyloom.functions.tokens import payload_estimate

PARTS = "array<struct<type:string,text:string,url:string,data:string,mime:string>>"
TOOL_USES = "array<struct<id:string,name:string,input:string>>"
OPTIONAL = {"text": "string", "parts": PARTS, "name": "string", "tool_call_id": "string", "tool_uses": TOOL_USES}


def complete(messages: DataFrame) -> DataFrame:
    return messages.withColumns({c: F.lit(None).cast(kind) for c, kind in OPTIONAL.items() if c not in messages.columns})


def is_text(part: Column) -> Column:
    return part["type"] == "text"


def plain_text(text: Column, parts: Column, sep: str = " ") -> Column:
    """The text, or the text parts with ``sep`` between: a space for compression, a newline for retrieved chunks and messages."""
    texts = F.transform(F.filter(parts, is_text), lambda p: F.coalesce(p["text"], F.lit("")))
    return F.when(parts.isNotNull(), F.array_join(texts, sep)).otherwise(F.coalesce(text, F.lit("")))


def map_texts(items: DataFrame, rewrite: Callable[[Column], Column]) -> DataFrame:
    """``rewrite`` on the text, or on each text part; other parts stay."""
    out = items.withColumn("text", rewrite(F.col("text")))
    if "parts" not in items.columns:
        return out
    return out.withColumn("parts", F.transform("parts", lambda p: F.when(is_text(p), p.withField("text", rewrite(p["text"]))).otherwise(p)))


def compiled(items: DataFrame) -> DataFrame:
    """Items as messages: parts by type with one of text, url or data, and tool fields where they are set."""
    def part(p: Column) -> Column:
        kind = F.when(p["type"].isin("text", "image_url"), p["type"]).otherwise("image_base64")
        keep = lambda name, of: F.when(kind == of, F.coalesce(p[name], F.lit("")))
        return F.struct(kind.alias("type"), keep("text", "text").alias("text"), keep("url", "image_url").alias("url"), keep("data", "image_base64").alias("data"), F.when(kind == "image_base64", p["mime"]).alias("mime"))

    return complete(items).withColumn("parts", F.transform("parts", part)).withColumn("text", F.when(F.col("parts").isNull(), F.coalesce("text", F.lit(""))))


def is_definition(metadata: Column) -> Column:
    """Whether a metadata map (string to string) marks a tool's definition."""
    return F.coalesce((metadata["tools.kind"] == "definition") | (metadata["tools.definition"] == "true"), F.lit(False))


def created(raw: DataFrame, slots: DataFrame, now: int, ephemeral: bool = False) -> DataFrame:
    """Items from pushed rows (ctx_id, slot, at, text or parts, optionally role, tokens, pinned, created_at): what isn't given is filled in.

    ``slots``: slot, default_role. The role is the row's, else the slot's, else user; seq follows ``at``; the time is ``now``.
    """
    out = complete(raw)
    given = lambda c, kind: F.col(c) if c in raw.columns else F.lit(None).cast(kind)
    out = out.join(F.broadcast(slots.select("slot", F.col("default_role").alias("_role"))), "slot", "left")
    seq = F.row_number().over(W.partitionBy("ctx_id", "slot").orderBy("at")) - 1
    return out.select(
        "ctx_id", "slot", seq.cast("bigint").alias("seq"), F.coalesce(given("role", "string"), "_role", F.lit("user")).alias("role"), *OPTIONAL, given("tokens", "bigint").alias("tokens"),
        F.coalesce(given("pinned", "boolean"), F.lit(False)).alias("pinned"), F.coalesce(given("ephemeral", "boolean"), F.lit(ephemeral)).alias("ephemeral"), F.coalesce(given("created_at", "bigint"), F.lit(now).cast("bigint")).alias("created_at"),
    )


#: The role of each helper and the slot that it pushes to.
HELPERS = {"system": ("system", "system"), "user": ("user", "history"), "assistant": ("assistant", "history")}


def said(helper: str, texts: DataFrame) -> DataFrame:
    """Rows (ctx_id, at, text) as pushed by the helper for system, user or assistant texts."""
    role, slot = HELPERS[helper]
    return texts.withColumns({"role": F.lit(role), "slot": F.lit(slot)})


# ---- token counts --------------------------------------------------------------------------------------------


def cached(tokens: Column) -> Column:
    """Missing counts are 0."""
    return F.coalesce(tokens, F.lit(0)).cast("bigint")


def filled(items: DataFrame, tokenizer: Callable[[Column], Column] | None = None) -> DataFrame:
    """``items`` with missing counts filled in, by a tokenizer's column function where a text is given, else by the estimate."""
    items = complete(items)
    guess = payload_estimate(F.col("text"), F.transform("parts", lambda p: F.struct(p["type"].alias("type"), p["text"].alias("text"))))
    counted = guess if tokenizer is None else F.when(F.col("text").isNotNull(), tokenizer(F.col("text"))).otherwise(guess)
    return items.withColumn("tokens", F.coalesce("tokens", counted).cast("bigint"))


class TokenPolicyError(ValueError):
    """Estimated counts where authoritative ones are asked for."""


def counted(items: DataFrame, accountant: Callable[[DataFrame], DataFrame] | None = None, lazy: bool = False, estimate: bool = False, authoritative: bool = False, tokenizer: Callable[[Column], Column] | None = None) -> DataFrame:
    """``items`` with the tokens that a build counts: an accountant's, else filled in (lazy, estimate), else the cached ones with 0 for missing.

    An accountant gets and returns items; counts are by row, so that sums are sums of rows.
    """
    if authoritative and accountant is None:
        raise TokenPolicyError("authoritative counts need an accountant")
    if authoritative and (lazy or estimate):
        raise TokenPolicyError("authoritative counts exclude lazy and estimated ones")
    if accountant is not None:
        return accountant(items)
    if lazy:
        return filled(items, tokenizer).select(*items.columns)
    return filled(items).select(*items.columns) if estimate else items.withColumn("tokens", cached(F.col("tokens")))
