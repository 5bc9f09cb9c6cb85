"""Lossless compression of items: texts by the pack of each item's language, thanks that answer each other, and similar neighbours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions.text import EN, Lossless, comparable, known_packs, resolve_pack
from tallyloom.operators.content import map_texts, plain_text
from tallyloom.operators.similarity import drop_consecutive
from tallyloom.operators.summaries import strip_adjacent_thanks


def tag_of(items: DataFrame, default: str = "en", detect: Callable[[Column], Column] | None = None) -> Column:
    """An item's language tag: its own (``locale``), else the one detected in its text, else the slot's."""
    own = F.nullif(F.btrim("locale"), F.lit("")) if "locale" in items.columns else F.lit(None).cast("string")
    text = plain_text(F.col("text"), F.col("parts")) if "parts" in items.columns else F.coalesce("text", F.lit(""))
    found = F.nullif(F.btrim(detect(text)), F.lit("")) if detect else F.lit(None).cast("string")
    return F.coalesce(own, found, F.lit(default))


def _by_pack(tag: Column, use: Callable) -> Column:
    """``use(pack)`` of each row's pack: exact tag, else its base language, else English."""
    out, low = use(EN), F.lower(tag)
    base = F.split_part(low, F.lit("-"), F.lit(1))
    for name in known_packs():
        out = F.when(base == name, use(resolve_pack(name))).otherwise(out)
    for name in known_packs():
        out = F.when(low == name, use(resolve_pack(name))).otherwise(out)
    return out


def compress_items(items: DataFrame, options: Lossless | None = None, default: str = "en", detect: Callable[[Column], Column] | None = None, adjacent: bool = True, dedupe: float | None = 0.92) -> DataFrame:
    """``items`` (ctx_id, slot, seq, role, text, optionally parts and locale) compressed; similar neighbours of one role are dropped.

    With ``options`` its pack serves all items, else each item's own. Lower-casing for comparison is the same in all packs.
    """
    tagged = items.withColumn("__tag", tag_of(items, default, detect))
    if options is not None:
        out = map_texts(tagged, options)
    else:
        out = map_texts(tagged, lambda t: _by_pack(F.col("__tag"), lambda pack: Lossless(pack=pack)(t)))
    if adjacent:
        packs = [options.pack] if options else [resolve_pack(x) for x in known_packs()]
        for pack in (p for p in packs if p.trailing_thanks != "(?!)"):
            mine = None if options else _by_pack(F.col("__tag"), lambda p, own=pack: F.lit(p is own))
            out = strip_adjacent_thanks(out, pack, mine)
    if dedupe is not None:
        text = plain_text(F.col("text"), F.col("parts")) if "parts" in out.columns else F.coalesce("text", F.lit(""))
        out = drop_consecutive(out.withColumn("comparable", comparable(text)), dedupe).drop("comparable")
    return out.drop("__tag")
