"""Duplicate removal inside contexts: against the last kept item, and against every kept one."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyloom.functions.text import comparable, set_similarity, text_similarity
from tallyloom.shipping import ship_package


def drop_consecutive(items: DataFrame, threshold: float = 0.92, key: str = "comparable") -> DataFrame:
    """Drop an item if it has the role of the last *kept* item of its slot and a text as similar as ``threshold``.

    A fold over each slot's items in order; a slot is bounded by its max_items. The fold carries places, texts stay in the sorted array. With ``key``
    a column of that name holds the texts to compare, made comparable already.
    """
    texts = F.col(key) if key in items.columns else comparable(F.col("text"))
    entry = F.struct("seq", "role", texts.alias("t"))
    start = F.struct(F.lit(-1).alias("last"), F.expr("cast(array() as array<int>)").alias("kept"), F.lit(0).alias("at"))

    def step(s, x):
        last = F.get(F.col("all"), s["last"])
        same = (s["last"] >= 0) & F.coalesce(last["role"] == x["role"], F.lit(False)) & F.coalesce(text_similarity(last["t"], x["t"]) >= threshold, F.lit(False))
        return F.struct(F.when(same, s["last"]).otherwise(s["at"]).alias("last"), F.when(same, s["kept"]).otherwise(F.array_append(s["kept"], s["at"])).alias("kept"), (s["at"] + 1).alias("at"))

    folded = items.groupBy("ctx_id", "slot").agg(F.array_sort(F.collect_list(entry)).alias("all")).withColumn("kept", F.aggregate("all", start, step)["kept"])
    kept = folded.select("ctx_id", "slot", F.explode(F.transform("kept", lambda i: F.get(F.col("all"), i)["seq"])).alias("seq"))
    return items.join(kept, ["ctx_id", "slot", "seq"], "left_semi")


def word_hashes(text: Column) -> Column:
    """The distinct lower-case words of a-z and 0-9 as sorted 64-bit hashes."""
    words = F.filter(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")), lambda x: x != "")
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


#: Values of a broadcast filter at most: texts are read again only where the hash of their key, reduced to so many values, is wanted.
_FILTER = 1 << 21


def _levels(threshold: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first size of each level of sizes, parts of each level). Sizes as close as ``threshold`` lie in one level or in neighbours; a set of a level
    and one of the same or next level that are as similar as that differ in fewer words than the level has parts."""
    first, parts = [1], []
    while first[-1] <= most:
        end = int(first[-1] / threshold + 1e-9) + 1
        n = end - 1
        parts.append(int((1 - threshold) / (1 + threshold) * (n + int(n / threshold + 1e-9)) + 1e-9) + 1)
        first.append(end)
    return np.array(first), np.array(parts)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _signed(h: np.ndarray, salt: np.ndarray, n: np.ndarray, words: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(sig, h) of sets in ``words`` one after another, ``n`` of each; the last bit of h tells whether the set is of the signature's own level."""
    first, parts = _levels(threshold, int(n.max(initial=0)))
    level = np.searchsorted(first, n, "right") - 1
    flat = words.view(np.uint64) ^ np.uint64(1 << 63)  # in ascending order, as the signed hashes are
    sigs, ids = [], []
    for own in (1, 0):
        at = level - (1 - own)
        m = np.where((n > 0) & (at >= 0), parts[np.maximum(at, 0)] if len(parts) else 0, 0)
        m = np.where(m > 1, m, 0)  # one part: only equal sets are as similar
        start = np.cumsum(m) - m
        row = np.repeat(np.arange(len(n)), np.where(m > 0, n, 0))
        held = flat[np.repeat(m > 0, n)]
        key = start[row] + (((held >> np.uint64(32)) * m[row].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(int(m.sum()), np.uint64)
        if len(key):
            begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sums[key[begin]] = np.add.reduceat(_mixed(held), begin)
        of = np.repeat(np.arange(len(n)), m)
        part = np.arange(len(of)) - start[of]
        sigs.append(_mixed(_mixed(sums + salt.view(np.uint64)[of]) + (at[of] * (1 << 32) + part).astype(np.uint64)))
        ids.append((h[of] & ~1) | own)
    return np.concatenate(sigs).view(np.int64), np.concatenate(ids)


def signatures(sets: DataFrame, threshold: float) -> DataFrame:
    """(sig, h) of ``sets`` (h, salt, words: sorted hashes): different sets of one salt as similar as ``threshold`` share a sig.

    A set's words are dealt by their hashes into one part more than such sets may differ in words, so that one part at least is
    the same in both: a sig is the hash of a whole part. No word of its own is a key, however common it is. Sets so small that only equal
    ones are as similar have none. The last bit of ``h`` is taken for a mark: of two sets that meet one has it.
    """
    ship_package(sets.sparkSession)

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            h, salt, n = (np.asarray(x.to_numpy(zero_copy_only=False), np.int64) for x in (batch.column(0), batch.column(1), pc.list_value_length(lists)))
            words = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.int64)
            sig, ids = _signed(h, salt, n, words, threshold)
            for i in range(0, len(sig), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(sig[i : i + (1 << 16)]), pa.array(ids[i : i + (1 << 16)])], names=["sig", "h"])

    return sets.select("h", "salt", "words").mapInArrow(run, "sig bigint, h bigint")


def bare(h: Column) -> Column:
    """Without its last bit, which ``signatures`` takes."""
    return F.shiftleft(F.shiftright(h, 1), 1)


def _fewer(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``rows`` whose keys may be among those of ``wanted``: all that are, and few others."""
    bits = F.pmod(F.xxhash64(*keys), F.lit(_FILTER)).alias("__bits")
    return rows.select("*", bits).join(F.broadcast(wanted.select(bits).distinct()), "__bits", "left_semi").drop("__bits")  # _FILTER numbers at most


def similar_classes(items: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(ctx_id, seq, c) and (ctx_id, a, b, similarity) with a < b, of different word sets as similar as ``threshold``. Words are told apart by 64-bit hashes.

    Items of equal word sets, blank ones among them, are one class and aren't paired with each other. Classes are named by their smallest seq. Candidates share a signature;
    words cross the network for candidates' first items alone.
    """
    keyed = items.select("ctx_id", "seq", word_hashes(F.col("text")).alias("words"))
    sets = keyed.select("ctx_id", "seq", "words", bare(F.xxhash64("ctx_id", "words")).alias("h"))
    members = sets.select("ctx_id", "seq", "h", F.hash("words").alias("h2"))
    members = members.select("ctx_id", "seq", "h", F.min("seq").over(W.partitionBy("ctx_id", "h", "h2")).alias("c"))
    met = signatures(sets.withColumn("salt", F.xxhash64("ctx_id")), threshold).repartition("sig").distinct()
    a, b = met.alias("a"), met.alias("b")
    marked = (F.col("a.h").bitwiseOR(F.col("b.h")).bitwiseAND(F.lit(1))) == 1
    pairs = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (bare(F.col("a.h")) < bare(F.col("b.h"))) & marked).select(bare(F.col("a.h")).alias("ha"), bare(F.col("b.h")).alias("hb")).distinct()
    firsts = members.filter("seq = c").select("ctx_id", "seq", "h").join(pairs.select(F.explode(F.array("ha", "hb")).alias("h")), "h", "left_semi")
    read = _fewer(items.select("ctx_id", "seq", "text"), firsts, ["ctx_id", "seq"]).select("ctx_id", "seq", word_hashes(F.col("text")).alias("words"))
    classes = read.join(firsts, ["ctx_id", "seq"]).select("h", F.struct("ctx_id", F.col("seq").alias("c"), "words").alias("x"))
    left, right = classes.select(F.col("h").alias("ha"), F.col("x").alias("p")), classes.select(F.col("h").alias("hb"), F.col("x").alias("q"))
    scored = pairs.join(left, "ha").join(right, "hb").filter(F.col("p.ctx_id") == F.col("q.ctx_id"))
    named = F.least("p.c", "q.c").alias("a"), F.greatest("p.c", "q.c").alias("b")
    scored = scored.select(F.col("p.ctx_id").alias("ctx_id"), *named, set_similarity(F.col("p.words"), F.col("q.words")).alias("similarity"))
    return members.drop("h"), scored.filter(F.col("similarity") >= threshold)


def similar_pairs(items: DataFrame, threshold: float) -> DataFrame:
    """(ctx_id, a, b, similarity) with a < b: each item with the first item of its own word set, and word sets as similar as ``threshold`` by their first items.

    So no link between different texts is lost, and equal ones are told by their class, not by all their pairs.
    """
    members, pairs = similar_classes(items, threshold)
    equal = members.filter("seq <> c").select("ctx_id", F.col("c").alias("a"), F.col("seq").alias("b"), F.lit(1.0).alias("similarity"))
    return pairs.unionByName(equal)


def drop_near_duplicates(items: DataFrame, threshold: float = 0.88) -> DataFrame:
    """In order of seq, drop an item that is as similar as ``threshold`` to any item kept before it.

    Of equal word sets the first decides: if it stays the others fall by it, if it falls by a partner so do they. The pairs of a
    context's classes are folded in order: a class falls if one of its earlier partners stands.
    """
    members, pairs = similar_classes(items, threshold)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        gone, rows = set(), rows.sort_values("b")
        for a, b in zip(rows["a"].tolist(), rows["b"].tolist()):  # a is before b, so that all about a is known
            if a not in gone:
                gone.add(b)
        return pd.DataFrame({"ctx_id": rows["ctx_id"].iloc[0], "seq": sorted(gone)})

    gone = pairs.select("ctx_id", F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).groupBy("ctx_id").applyInPandas(fold, f"ctx_id {pairs.schema['ctx_id'].dataType.simpleString()}, seq bigint")
    again = members.filter("seq <> c").select("ctx_id", F.col("seq").cast("bigint").alias("seq"))
    return items.join(gone.unionByName(again), ["ctx_id", "seq"], "left_anti")
