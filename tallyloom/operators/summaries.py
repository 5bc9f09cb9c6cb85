"""Summarising policies: zones, chunking, caps, and the progressive and map-reduce folds over one context."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyloom.functions.text import EN, LanguagePack

SLOT = ("ctx_id", "slot")


def strip_adjacent_thanks(items: DataFrame, pack: LanguagePack = EN, mine: Column | None = None) -> DataFrame:
    """A user's closing thanks and the welcome that the assistant opens with go together; with ``mine`` between rows of the pack's language alone."""
    if mine is not None:
        items = items.withColumn("__mine", mine)
    order = W.partitionBy(*SLOT).orderBy("seq")
    thanks, welcome = f"(?i){pack.trailing_thanks}", f"(?i){pack.leading_welcome}"
    opening = (F.col("role") == "user") & (F.lead("role").over(order) == "assistant") & F.col("text").rlike(thanks) & F.lead("text").over(order).rlike(welcome)
    closing = (F.col("role") == "assistant") & (F.lag("role").over(order) == "user") & F.lag("text").over(order).rlike(thanks) & F.col("text").rlike(welcome)
    if mine is not None:
        opening, closing = opening & F.col("__mine") & F.lead("__mine").over(order), closing & F.col("__mine") & F.lag("__mine").over(order)
    out = items.withColumns({"__o": F.coalesce(opening, F.lit(False)), "__c": F.coalesce(closing, F.lit(False))})
    text = F.when(F.col("__o"), F.btrim(F.regexp_replace("text", thanks, ""))).when(F.col("__c"), F.btrim(F.regexp_replace("text", welcome, ""))).otherwise(F.col("text"))
    return out.withColumn("text", text).drop("__o", "__c", "__mine")


def preserved_tail(items: DataFrame, budget: Column | int) -> DataFrame:
    """ctx_id, slot, keep_last: how many of the newest items stay as they are, four at least, half the budget at most."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    newest = W.partitionBy(*SLOT).orderBy(F.desc("seq"))
    walked = items.withColumns({"__i": F.row_number().over(newest), "__c": F.sum("tokens").over(newest), "__half": F.floor(budget * 0.5)})
    stop = F.min(F.when((F.col("__i") >= 5) & (F.col("__c") > F.col("__half")), F.col("__i")))
    return walked.groupBy(*SLOT).agg(F.greatest(F.lit(4), F.coalesce(stop, F.count(F.lit(1)) + 1) - 1).cast("bigint").alias("keep_last"))


def zones(items: DataFrame, keep_last: int, score: Column | None = None) -> DataFrame:
    """``zone``: recent for pinned items and the last ``keep_last`` others; of the rest the first half old, the others middle."""
    free = ~F.coalesce("pinned", F.lit(False))
    back = F.sum(free.cast("int")).over(W.partitionBy(*SLOT).orderBy(F.desc("created_at"), F.desc("seq")))
    out = items.withColumn("__recent", ~free | (back <= keep_last))
    first = [score, "created_at", "seq"] if score is not None else ["created_at", "seq"]
    group = W.partitionBy(*SLOT, "__recent")
    place, n = F.row_number().over(group.orderBy(*first)), F.count(F.lit(1)).over(group)
    return out.withColumn("zone", F.when(F.col("__recent"), "recent").when(place <= F.floor(n / 2), "old").otherwise("middle")).drop("__recent")


def next_fit(items: DataFrame, limit: int, group: list[str]) -> DataFrame:
    """``chunk``: items in order fill a chunk until the next one would go over ``limit``; a fold over a group's items."""
    entry = F.struct("seq", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"))
    start = F.struct(F.lit(-1).alias("chunk"), F.lit(0).cast("bigint").alias("used"), F.expr("cast(array() as array<struct<seq:bigint,chunk:int>>)").alias("out"))

    def step(s, x):
        fresh = (s["chunk"] < 0) | (s["used"] + x["tokens"] > limit)
        chunk = F.when(fresh, s["chunk"] + 1).otherwise(s["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(fresh, x["tokens"]).otherwise(s["used"] + x["tokens"]).alias("used"), F.array_append(s["out"], F.struct(x["seq"].cast("bigint").alias("seq"), chunk.alias("chunk"))).alias("out"))

    folded = items.groupBy(*group).agg(F.array_sort(F.collect_list(entry)).alias("all")).select(*group, F.explode(F.aggregate("all", start, step)["out"]).alias("x")).select(*group, "x.seq", "x.chunk")
    return items.join(folded, [*group, "seq"])


def caps(budget: Column) -> list[Column]:
    """Summary budgets: all, each layer, and a segment's size."""
    whole = F.greatest(F.lit(64), F.floor(budget * 0.15))
    part = lambda x: F.floor(whole * x)
    return [whole.cast("bigint").alias("summary"), part(0.55).alias("layer2"), part(0.45).alias("layer1"), part(0.15).alias("layer3"), F.least(F.lit(8192), F.greatest(F.lit(2048), F.floor(budget * 0.15))).cast("bigint").alias("segment")]


def split_to_budget(text: Column, tokens: int) -> Column:
    """Slices of at most ``tokens`` estimated tokens."""
    size = max(1, tokens) * 4
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(text) / size).cast("int") - 1)), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def head_summary(texts: list[str], tokens: int) -> str:
    """A stand-in for a model: the texts' first sentences, cut to size."""
    joined = " ".join(t.split(". ")[0].strip() for t in texts if t and t.strip())
    return joined if len(joined) <= tokens * 4 else joined[: max(0, tokens * 4 - 1)] + "…"


def _estimate(text: str) -> int:
    return -(-len(text) // 4)


_SCHEMA = "ctx_id bigint, slot string, seq bigint, text string, tokens bigint, kind string, created_at bigint, pinned boolean, summarizes array<bigint>"
# The least size of a chunk's summary, and what separates texts when they are merged.
LEAST, GAP, MERGE = 64, "\n\n", "\n\n---\n\n"


def cut(text: str, tokens: int) -> str:
    """The last resort for a summary, as ``functions.text.last_resort``."""
    size = max(0, tokens) * 4
    if len(text) <= size:
        return text
    head = text[:size]
    at = head.rfind(" ")
    return (head[:at] if at > size * 0.5 else head) + "…"


def summarised(texts: list[str], tokens: int, summarise: Callable[[list[str], int], str], facts: Callable[[str], list[tuple]] | None, held: dict) -> str:
    """One chunk's summary: facts are extracted first, FACT lines of the answer join them, and without an answer the texts are cut."""
    payload = GAP.join(t for t in texts if t)
    if facts is not None:
        try:
            _remember(held, facts(payload))
        except Exception:  # noqa: BLE001 a user's function; without its facts the summary still counts
            pass
    try:
        answer = summarise([t for t in texts if t], tokens)
    except Exception:  # noqa: BLE001 a user's function; the texts are cut instead
        answer = ""
    found = [(m[1], m[2], m[3], float(m[4] or 0.9)) for m in map(_FACT.match, answer.split("\n")) if m]
    _remember(held, found)
    told = "\n".join(x for x in answer.split("\n") if not _FACT.match(x)).strip()
    return told or cut(payload, tokens)


_FACT = re.compile(r"(?i)^\s*FACT:\s*([^|]+?)\s*\|\s*([^|]+?)\s*\|\s*(.+?)(?:\s*\|\s*([0-9]*\.?[0-9]+))?\s*$")


def _remember(held: dict, facts: list[tuple]) -> None:
    """Of facts on one subject and predicate the surest stays, the later one among equals."""
    for subject, predicate, value, confidence in facts:
        confidence = min(1.0, max(0.1, float(confidence)))
        if (subject, predicate) not in held or confidence >= held[subject, predicate][1]:
            held[subject, predicate] = (value, confidence)


def _told(held: dict, size: int) -> str:
    out, used = [], len("Known facts: ")
    for (subject, predicate), (value, _) in sorted(held.items(), key=lambda x: -x[1][1]):
        piece = f'{subject} {predicate} "{value}"'
        used += len(piece) + (2 if out else 0)
        if used > size:
            break
        out.append(piece)
    return "Known facts: " + "; ".join(out) if out else ""


def _chunks(rows: list[tuple], limit: int) -> list[list[tuple]]:
    out, used = [], 0
    for r in rows:
        if not out or used + r[4] > limit:
            out.append([])
            used = 0
        out[-1].append(r)
        used += r[4]
    return out


def _frame(pdf: pd.DataFrame) -> list[tuple]:
    """Rows of the schema, by time."""
    pdf = pdf.sort_values(["created_at", "seq"], kind="stable")
    ctx, slot = pdf["ctx_id"].iloc[0], pdf["slot"].iloc[0]
    has = "summarizes" in pdf.columns
    return [(ctx, slot, int(r.seq), r.text or "", int(r.tokens), "item", int(r.created_at), bool(r.pinned), [int(x) for x in r.summarizes] if has and r.summarizes is not None else []) for r in pdf.itertuples()]


def _dropped(out: list[tuple], recent: list[tuple], budget: int) -> list[tuple]:
    """The oldest unpinned of ``recent`` until all fit; they leave ``recent``."""
    gone = []
    while sum(r[4] for r in out) + sum(r[4] for r in recent) > budget:
        at = next((i for i, r in enumerate(recent) if not r[7]), None)
        if at is None:
            break
        gone.append(recent.pop(at))
    return gone


def progressive(items: DataFrame, budget: int | Column, keep_last: int = 4, summarise: Callable[[list[str], int], str] = head_summary, facts: Callable[[str], list[tuple]] | None = None, score: Column | None = None) -> DataFrame:
    """Old items become summaries, then middle ones if that doesn't fit, then the summaries of the old one; of recent ones the oldest go, summarised.

    Items that are summaries already (``summarizes`` not empty) pass unchanged. ``summarise`` gets texts and a size in tokens, ``facts`` a text and gives
    (subject, predicate, value, confidence); facts come back as one pinned item. ``score`` orders items by importance before they are cut into zones. One
    context is one group, bounded by its slot's max_items.
    """
    zoned = _ready(zones(items, keep_last, score), budget)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, budget = [x.split()[0] for x in _SCHEMA.split(", ")], int(pdf["__budget"].iloc[0])
        zone = pdf.sort_values(["created_at", "seq"], kind="stable")["zone"].tolist()
        rows = _frame(pdf)
        if sum(r[4] for r in rows) <= budget:
            return pd.DataFrame(rows, columns=names)
        old, middle, recent = ([r for r, z in zip(rows, zone) if z == name] for name in ("old", "middle", "recent"))
        ctx, slot, first = rows[0][0], rows[0][1], min((r[6] for r in recent), default=rows[-1][6] + 1)
        low = min(r[2] for r in rows)
        whole, held = max(64, int(budget * 0.15)), {}
        segment, fact_chars = min(8192, max(2048, int(budget * 0.15))), min(512, int(whole * 0.2)) * 4

        def summary(chunk: list[tuple], tokens: int, tick: int, kind: str) -> list[tuple]:
            if not any(r[3] for r in chunk):
                return []
            text = summarised([r[3] for r in chunk], tokens, summarise, facts, held)
            return [(ctx, slot, low - 1_000_000 + tick, text, _estimate(text), kind, first - 1000 - tick * 1000, False, sorted({s for r in chunk for s in [*r[8], r[2]]}))]

        def told() -> list[tuple]:
            text = _told(held, fact_chars)
            return [(ctx, slot, low - 1_000_001, text, _estimate(text), "facts", first, True, [])] if text else []

        size = lambda rows: sum(r[4] for r in rows)
        split = lambda rows: ([r for r in rows if r[8]], [r for r in rows if not r[8]])
        (done2, fresh2), (done1, fresh1) = split(old), split(middle)
        chunks2, chunks1 = _chunks(fresh2, segment), _chunks(fresh1, segment)
        size2, size1 = (max(LEAST, int(whole * share) // max(1, n)) for share, n in ((0.55, len(chunks2)), (0.45, len(chunks1))))
        layer2 = done2 + [s for i, c in enumerate(chunks2) for s in summary(c, size2, i, "layer2")]
        if size([*told(), *layer2, *middle, *recent]) <= budget:
            layer1 = middle
        else:
            layer1 = done1 + [s for i, c in enumerate(chunks1) for s in summary(c, size1, len(chunks2) + i, "layer1")]
        if size([*told(), *layer2, *layer1, *recent]) > budget and any(r[3] for r in layer2):
            layer2 = summary(layer2, max(LEAST, int(whole * 0.15)), len(chunks2) + len(chunks1), "layer3")
        if gone := _dropped([*told(), *layer2, *layer1], recent, budget):
            layer1 = layer1 + summary(gone, max(LEAST, size1), len(chunks2) + len(chunks1) + 1, "layer1")
        return pd.DataFrame(sorted([*told(), *layer2, *layer1, *recent], key=lambda r: (r[6], r[2])), columns=names)

    return zoned.groupBy(*SLOT).applyInPandas(run, _SCHEMA)


def _ready(zoned: DataFrame, budget: int | Column) -> DataFrame:
    """What a fold over one slot reads, with the slot's budget in each row."""
    columns = ["ctx_id", "slot", "seq", "text", "tokens", "pinned", "created_at", "zone", "__budget", *(["summarizes"] if "summarizes" in zoned.columns else [])]
    out = zoned.withColumn("__budget", (F.lit(budget) if isinstance(budget, int) else budget).cast("bigint"))
    return out.withColumn("pinned", F.coalesce("pinned", F.lit(False))).withColumn("tokens", F.coalesce("tokens", F.lit(0))).select(*columns)


def split_text(text: str, tokens: int) -> list[str]:
    size = max(1, tokens) * 4
    return [text[i : i + size] for i in range(0, len(text), size)] or [""]


def map_chunks(texts: list[str], tokens: int) -> list[list[str]]:
    """Texts in order fill a chunk while they fit with two newlines between; a text over the size is split by itself, empty ones drop out."""
    out, current = [], []
    for text in filter(None, texts):
        if _estimate(text) > tokens:
            out += [current] if current else []
            current = []
            out += [[piece] for piece in split_text(text, tokens)]
        elif current and _estimate(GAP.join([*current, text])) > tokens:
            out.append(current)
            current = [text]
        else:
            current.append(text)
    return out + ([current] if current else [])


def reduced(parts: list[str], tokens: int, merge: Callable[[list[str], int], str], target: int, depth: int = 0) -> str:
    """Summaries merged layer by layer until one is left that fits; a merge that doesn't shrink its texts ends by cutting."""
    while len(parts) > 1:
        layer, batch = [], []
        for p in [*parts, None]:
            if batch and (p is None or _estimate(MERGE.join([*batch, p])) > tokens):
                joined = MERGE.join(batch)
                if _estimate(joined) > tokens and depth < 8:
                    layer.append(reduced([merge([x], target) for x in split_text(joined, tokens)], tokens, merge, target, depth + 1))
                else:
                    layer.append(merge(batch, target))
                batch = []
            if p is not None:
                batch.append(p)
        if len(layer) >= len(parts):
            return cut(MERGE.join(layer), tokens)
        parts = layer
    whole = parts[0] if parts else ""
    if _estimate(whole) > tokens:
        return reduced([merge([x], target) for x in split_text(whole, tokens)], tokens, merge, target, depth + 1) if depth < 8 else cut(whole, tokens)
    return whole


def map_reduce(items: DataFrame, budget: int | Column, keep_last: int = 4, map_tokens: int = 2048, reduce_tokens: int = 2048, summarise: Callable[[list[str], int], str] = head_summary) -> DataFrame:
    """All but recent items become one summary: chunks are summarised, the summaries merged; of recent items the oldest go until all fits, summarised.

    One context is one group, bounded by its slot's max_items.
    """
    zoned = _ready(zones(items, keep_last), budget)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, budget = [x.split()[0] for x in _SCHEMA.split(", ")], int(pdf["__budget"].iloc[0])
        zone = pdf.sort_values(["created_at", "seq"], kind="stable")["zone"].tolist()
        rows = _frame(pdf)
        if sum(r[4] for r in rows) <= budget:
            return pd.DataFrame(rows, columns=names)
        recent, bulk = [r for r, z in zip(rows, zone) if z == "recent"], [r for r, z in zip(rows, zone) if z != "recent"]
        ctx, slot, first, low = rows[0][0], rows[0][1], min((r[6] for r in recent), default=rows[-1][6] + 1), min(r[2] for r in rows)
        whole = max(64, int(budget * 0.15))
        made = lambda text, of, tick, kind: (ctx, slot, low - 1_000_000 + tick, text, _estimate(text), kind, first - 1000 - tick * 1000, False, sorted(r[2] for r in of))
        chunks = map_chunks([r[3] for r in bulk], map_tokens)
        head = []
        if chunks:
            size = max(LEAST, whole // len(chunks))
            head = [made(reduced([summarise(c, size) for c in chunks], reduce_tokens, summarise, size), bulk, 0, "head")]
        if gone := _dropped(head, recent, budget):
            if texts := [r[3] for r in gone if r[3]]:
                recent = [made(summarise(texts, max(LEAST, int(whole * 0.3))), gone, 1, "dropped"), *recent]
        return pd.DataFrame(sorted([*head, *recent], key=lambda r: (r[6], r[2])), columns=names)

    return zoned.groupBy(*SLOT).applyInPandas(run, _SCHEMA)
