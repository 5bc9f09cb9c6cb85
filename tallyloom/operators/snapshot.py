"""Compiled messages, snapshots with checksums, and differences between snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

PLACES = {"before": 0, "interleave": 1, "after": 2}


def slot_order(slots: DataFrame) -> DataFrame:
    """``slots`` with slot_pos: before, interleaved by their order, after; then by priority and name."""
    place = F.coalesce(*[F.when(F.coalesce("position", F.lit("after")) == k, v) for k, v in PLACES.items()])
    order = W.partitionBy("ctx_id").orderBy(place, F.when(F.col("position") == "interleave", F.coalesce("ord", F.lit(0.0))), F.desc("priority"), "slot")
    return slots.withColumn("slot_pos", F.row_number().over(order))


def compile_messages(items: DataFrame, slots: DataFrame) -> DataFrame:
    """ctx_id, pos, role, text, slot, seq: all items in the order of their slots."""
    placed = items.join(F.broadcast(slot_order(slots).select("slot", "slot_pos")) if "ctx_id" not in items.columns else slot_order(slots).select("ctx_id", "slot", "slot_pos"), ["ctx_id", "slot"])
    pos = F.row_number().over(W.partitionBy("ctx_id").orderBy("slot_pos", "seq")) - 1
    return placed.withColumn("pos", pos)


def slot_meta(items: DataFrame, slots: DataFrame, evicted: DataFrame | None = None) -> DataFrame:
    """Use, count, evictions and utilisation for each slot of ``slots`` (ctx_id, slot, budget), empty ones included."""
    used = items.groupBy("ctx_id", "slot").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("item_count"))
    out = slots.select("ctx_id", "slot", "budget").join(used, ["ctx_id", "slot"], "left")
    if evicted is not None:
        out = out.join(evicted.groupBy("ctx_id", "slot").agg(F.count(F.lit(1)).alias("evicted")), ["ctx_id", "slot"], "left")
    else:
        out = out.withColumn("evicted", F.lit(0).cast("bigint"))
    out = out.fillna(0, ["used", "item_count", "evicted"])
    return out.withColumn("utilisation", F.when(F.col("budget") > 0, F.col("used") / F.col("budget")).otherwise(F.lit(0.0)))


def build_meta(meta: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """A row for each context: totals, utilisation, waste and evictions, and with ``warnings`` (ctx_id, warning) the distinct ones sorted."""
    out = meta.groupBy("ctx_id").agg(F.sum("used").cast("bigint").alias("used"), F.sum("budget").cast("bigint").alias("budget"), F.sum(F.greatest(F.lit(0), F.col("budget") - F.col("used"))).cast("bigint").alias("waste"), F.sum("evicted").cast("bigint").alias("evicted"))
    out = out.withColumn("utilisation", F.when(F.col("budget") > 0, F.col("used") / F.col("budget")).otherwise(F.lit(0.0)))
    if warnings is None:
        return out
    told = warnings.groupBy("ctx_id").agg(F.sort_array(F.collect_set("warning")).alias("warnings"))
    return out.join(told, "ctx_id", "left").withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))


def serialise(messages: DataFrame, version: str = "1.0") -> DataFrame:
    """ctx_id, body (JSON of the ordered messages) and its SHA-256 checksum."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "role", "text")))
    body = F.to_json(F.struct(F.lit(version).alias("version"), F.col("ctx_id").cast("string").alias("id"), F.transform("all", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages")))
    return messages.groupBy("ctx_id").agg(ordered.alias("all")).select("ctx_id", body.alias("body")).withColumn("checksum", F.sha2("body", 256))


def deserialise(snapshots: DataFrame) -> DataFrame:
    """Messages of snapshots whose checksum and version are right; ``valid_snapshots`` tells which those are."""
    kind = "struct<version:string,id:string,messages:array<struct<role:string,content:string>>>"
    good = snapshots.filter(valid(F.col("body"), F.col("checksum"))).withColumn("s", F.from_json("body", kind)).filter("s.version = '1.0'")
    return good.select("ctx_id", F.posexplode("s.messages").alias("pos", "m")).select("ctx_id", "pos", F.col("m.role").alias("role"), F.col("m.content").alias("text"))


def valid(body: Column, checksum: Column) -> Column:
    return F.coalesce(F.sha2(body, 256) == checksum, F.lit(False))


_LEGACY = "struct<version:string,id:string,model:string,messages:array<struct<role:string,content:string>>,meta:struct<slotStats:map<string,struct<used:bigint,budget:bigint,items:bigint,evicted:bigint>>>>"
MAX_STEPS = 32


def from_0_9(snapshots: DataFrame) -> DataFrame:
    """Bodies of version 0.9 (messages and meta.slotStats) as bodies of version 1.0; a slot's utilisation is held to 0..1."""
    s = F.from_json("body", _LEGACY)

    def slot(_, x):
        used, budget = F.coalesce(x["used"], F.lit(0)), F.coalesce(x["budget"], F.lit(0))
        share = F.when(budget > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), used / budget))).otherwise(F.lit(0.0))
        return F.struct(used.alias("used"), budget.alias("budget"), F.coalesce(x["items"], F.lit(0)).alias("items"), F.coalesce(x["evicted"], F.lit(0)).alias("evicted"), share.alias("utilisation"))

    body = F.struct(F.lit("1.0").alias("version"), F.col("s.id").alias("id"), F.coalesce("s.messages", F.array().cast("array<struct<role:string,content:string>>")).alias("messages"), F.struct(F.transform_values("s.meta.slotStats", slot).alias("slots")).alias("meta"))
    return snapshots.withColumn("s", s).withColumn("body", F.to_json(body)).drop("s")


#: from version -> (to version, step over rows with a body); the last one registered for a version counts.
MIGRATIONS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {"0.9": ("1.0", from_0_9)}


def register_migration(old: str, new: str, step: Callable[[DataFrame], DataFrame]) -> None:
    MIGRATIONS[old] = (new, step)


def migrated(snapshots: DataFrame, target: str = "1.0") -> tuple[DataFrame, DataFrame]:
    """``snapshots`` (ctx_id, body) brought to the target version, sealed anew, and those that no chain of steps brings there.

    Steps are taken version by version, at most ``MAX_STEPS``; rows of one version take a step together.
    """
    version = F.get_json_object("body", "$.version")
    rows, done = snapshots.select("ctx_id", "body"), None
    chains: dict[str, list[Callable]] = {}
    for old in MIGRATIONS:
        at, steps = old, []
        while at != target and at in MIGRATIONS and len(steps) < MAX_STEPS:
            at, step = MIGRATIONS[at]
            steps.append(step)
        if at == target:
            chains[old] = steps
    for old, steps in {target: [], **chains}.items():
        part = rows.filter(version == old)
        for step in steps:
            part = step(part)
        done = part if done is None else done.unionByName(part)
    lost = rows.filter(version.isNull() | ~version.isin(target, *chains))
    return done.withColumn("checksum", F.sha2("body", 256)), lost


def migrate(legacy: DataFrame) -> DataFrame:
    """Slot rows of version 0.9 snapshots, as version 1.0 has them."""
    done, _ = migrated(legacy.filter(F.get_json_object("body", "$.version") == "0.9"))
    kind = "struct<meta:struct<slots:map<string,struct<used:bigint,budget:bigint,utilisation:double>>>>"
    return done.select("ctx_id", F.explode(F.from_json("body", kind)["meta"]["slots"]).alias("slot", "x")).select("ctx_id", "slot", "x.used", "x.budget", "x.utilisation")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """ctx_id, pos, change: added, removed or modified messages by position."""
    b, a = before.select("ctx_id", "pos", F.struct("role", "text").alias("old")), after.select("ctx_id", "pos", F.struct("role", "text").alias("new"))
    both = b.join(a, ["ctx_id", "pos"], "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return both.withColumn("change", change).filter("change is not null").select("ctx_id", "pos", "change")


def shared(before: DataFrame, after: DataFrame) -> DataFrame:
    """Messages of ``after`` with ``unchanged``: the same position holds an equal message before."""
    b = before.select("ctx_id", "pos", F.lit(True).alias("__same"), F.col("role").alias("__r"), F.col("text").alias("__t"))
    out = after.join(b, ["ctx_id", "pos"], "left")
    return out.withColumn("unchanged", F.coalesce(F.col("__same") & F.col("role").eqNullSafe(F.col("__r")) & F.col("text").eqNullSafe(F.col("__t")), F.lit(False))).drop("__same", "__r", "__t")


def slots_modified(before: DataFrame, after: DataFrame) -> DataFrame:
    """Slots in both metas whose figures differ."""
    columns = ["used", "item_count", "evicted"]
    b = before.select("ctx_id", "slot", F.struct(*columns).alias("old"))
    return b.join(after.select("ctx_id", "slot", F.struct(*columns).alias("new")), ["ctx_id", "slot"]).filter(~F.col("old").eqNullSafe(F.col("new"))).select("ctx_id", "slot")


def fingerprint(items: DataFrame) -> DataFrame:
    """A hash of each context's items without their token counts: equal hashes need no new build."""
    rows = F.array_sort(F.collect_list(F.struct("slot", "seq", "role", "text", "pinned")))
    return items.groupBy("ctx_id").agg(F.sha2(F.to_json(rows), 256).alias("fingerprint"))


def slot_signatures(items: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("seq", "role", "text", "tokens", "pinned")))
    return items.groupBy("ctx_id", "slot").agg(F.sha2(F.to_json(rows), 256).alias("signature"))


def slot_lines(meta: DataFrame) -> DataFrame:
    """ctx_id, text: a line for each slot of a context, by name."""
    line = F.concat(F.col("slot"), F.lit(": used "), "used", F.lit(" / budget "), "budget", F.lit(" · items "), "item_count", F.lit(" · evicted "), "evicted", F.lit(" · overflow "), (F.col("evicted") > 0).cast("string"))
    rows = meta.withColumn("line", line)
    return rows.groupBy("ctx_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "line"))), lambda x: x["line"]), "\n").alias("text"))


def slot_union(before: DataFrame, after: DataFrame) -> DataFrame:
    """(ctx_id, slot) of the slots that either side has."""
    return before.select("ctx_id", "slot").unionByName(after.select("ctx_id", "slot")).distinct()
