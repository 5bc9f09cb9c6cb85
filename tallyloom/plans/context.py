"""The driver-side surface: validated configurations, a fluent builder, and plugins around one build plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tallyloom.functions.text import Lossless
from tallyloom.operators import budget as bd, content as ct, overflow as ov, semantic as sm, snapshot as sn, summaries as su
from tallyloom.operators.overflow import ContextOverflow

KINDS, POSITIONS = ("fixed", "percent", "flex"), ("before", "after", "interleave")
BUILT_IN = ("truncate", "truncate-latest", "sliding-window", "compress", "summarize", "semantic", "error", "fallback-chain")
__all__ = ["ContextOverflow", "ContextPlan", "InvalidConfig", "Plugin", "Slot", "summarising"]


class InvalidConfig(ValueError):
    """A slot or context configuration that can't work."""


@dataclass(frozen=True)
class Slot:
    name: str
    priority: int
    budget_kind: str = "flex"
    fixed: int | None = None
    percent: float | None = None
    min: int | None = None
    max: int | None = None
    overflow: str = "truncate"
    position: str = "after"
    ord: float | None = None
    max_items: int = 10_000
    protected: bool = False
    default_role: str = "user"
    window: int | None = None

    def __post_init__(self):
        wrong = [
            (not self.name, "a slot needs a name"), (not 1 <= self.priority <= 100, f"priority {self.priority} is not within 1 and 100"), (self.budget_kind not in KINDS, f"unknown budget {self.budget_kind!r}"), (self.position not in POSITIONS, f"unknown position {self.position!r}"),
            (self.budget_kind == "fixed" and (self.fixed is None or self.fixed < 0), "a fixed budget needs an amount"), (self.budget_kind == "percent" and not 0 <= (self.percent if self.percent is not None else -1) <= 100, "a percent budget needs a share"),
            (self.min is not None and self.max is not None and self.min > self.max, "the minimum is over the maximum"), (self.max_items < 1, "max_items must be positive"), (self.window is not None and self.window < 1, "a window holds one item at least"),
        ]
        for bad, why in wrong:
            if bad:
                raise InvalidConfig(f"slot {self.name!r}: {why}")


Step = Callable[[DataFrame], DataFrame]


@dataclass
class Plugin:
    """Steps of a user's own around a build; each gets and returns a DataFrame, ``install`` and ``destroy`` get the plan."""

    name: str
    install: Callable[[ContextPlan], None] | None = None
    destroy: Callable[[ContextPlan], None] | None = None
    prepare: Callable[[list[Slot]], list[Slot]] | None = None
    slots: Step | None = None
    after_budget: Step | None = None
    content: Step | None = None
    before_overflow: Step | None = None
    after_overflow: Step | None = None
    messages: Step | None = None
    after_build: Callable[[Build], None] | None = None
    events: Step | None = None
    compressor: tuple[str, Callable[[Column], Column]] | None = None
    required: bool = False


@dataclass
class Build:
    """A built relation of contexts: allocations, kept items, evictions, messages, meta rows and warnings, all lazy."""

    slots: DataFrame
    items: DataFrame
    evicted: DataFrame
    messages: DataFrame
    meta: DataFrame
    warnings: DataFrame
    next_items: DataFrame

    def ready(self) -> DataFrame:
        """ctx_id, slot_pos, slot, n, payload: each slot's messages as JSON in the order in which a reader may take them; empty slots too."""
        entry = F.struct("seq", F.struct("role", "text").alias("m"))
        held = self.messages.groupBy("ctx_id", "slot").agg(F.count(F.lit(1)).alias("n"), F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["m"])).alias("payload"))
        order = sn.slot_order(self.slots).select("ctx_id", "slot", "slot_pos")
        return order.join(held, ["ctx_id", "slot"], "left").select("ctx_id", "slot_pos", "slot", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("payload", F.lit("[]")).alias("payload"))

    def events(self) -> DataFrame:
        """ctx_id, type, slot, seq, detail: what happened in the build, a row for each budget, eviction, warning and finished context."""
        none = lambda kind: F.lit(None).cast(kind)
        rows = self.slots.select("ctx_id", F.lit("slot:budget-resolved").alias("type"), "slot", none("bigint").alias("seq"), F.col("budget").cast("string").alias("detail"))
        rows = rows.unionByName(self.evicted.select("ctx_id", F.lit("content:evicted").alias("type"), "slot", F.col("seq").cast("bigint").alias("seq"), F.col("reason").alias("detail")))
        rows = rows.unionByName(self.warnings.select("ctx_id", F.lit("warning").alias("type"), "slot", none("bigint").alias("seq"), F.col("warning").alias("detail")))
        done = self.messages.groupBy("ctx_id").agg(F.count(F.lit(1)).cast("string").alias("detail"))
        return rows.unionByName(done.select("ctx_id", F.lit("build:complete").alias("type"), none("string").alias("slot"), none("bigint").alias("seq"), "detail"))


@dataclass
class ContextPlan:
    """Slots, totals, policies and plugins; ``build`` turns items into a snapshot of every context."""

    slots: list[Slot] = field(default_factory=list)
    max_tokens: int = bd.DEFAULT_MAX_TOKENS
    reserve: int = 0
    plugins: list[Plugin] = field(default_factory=list)
    policies: dict[str, Step] = field(default_factory=dict)
    anchors: DataFrame | None = None
    summarise: Step | None = None
    counting: dict = field(default_factory=dict)
    proactive: float | None = None
    ratio: float = 0.3

    # ---- configuration ----

    def slot(self, name: str, priority: int, **how) -> ContextPlan:
        self.slots = [s for s in self.slots if s.name != name] + [Slot(name, priority, **how)]
        return self

    def update_slot(self, name: str, **how) -> ContextPlan:
        """Change some fields of a slot; fields that are None stay."""
        if name not in {s.name for s in self.slots}:
            raise InvalidConfig(f"unknown slot {name!r}")
        self.slots = [replace(s, **{k: v for k, v in how.items() if v is not None}) if s.name == name else s for s in self.slots]
        return self

    def remove_slot(self, name: str) -> ContextPlan:
        self.slots = [s for s in self.slots if s.name != name]
        return self

    def list_slots(self) -> list[Slot]:
        """By priority, the highest first, then by name."""
        return sorted(self.slots, key=lambda s: (-s.priority, s.name))

    def preset(self, name: str) -> ContextPlan:
        names = bd.SLOT_SCHEMA.split(", ")
        for row in bd.PRESETS[name]:
            values = {k.split()[0]: v for k, v in zip(names, row) if v is not None}
            self.slot(values.pop("slot"), values.pop("priority"), **values)
        return self

    def tokens(self, max_tokens: int, reserve: int = 0) -> ContextPlan:
        self.max_tokens, self.reserve = max_tokens, reserve
        return self

    def model(self, name: str, spark: SparkSession) -> ContextPlan:
        """The context size of a model that the registry knows."""
        from tallyloom.operators import models as md

        size = spark.range(1).select(md.max_tokens(F.lit(name)).alias("n")).first()["n"]
        if size is None:
            raise InvalidConfig(f"unknown model {name!r}")
        self.max_tokens = size
        return self

    def count(self, **how) -> ContextPlan:
        """How tokens are counted; see ``content.counted``."""
        self.counting = how
        return self

    def overridden(self, max_tokens: int | None = None, reserve: int | None = None, slots: dict[str, dict] | None = None) -> ContextPlan:
        """A plan with some values replaced, validated again."""
        out = replace(self, slots=list(self.slots), plugins=list(self.plugins), policies=dict(self.policies))
        out.tokens(self.max_tokens if max_tokens is None else max_tokens, self.reserve if reserve is None else reserve)
        for name, how in (slots or {}).items():
            out.update_slot(name, **how)
        out.validate()
        return out

    # ---- plugins and policies ----

    def use(self, plugin: Plugin) -> ContextPlan:
        """Add a plugin; one of the same name is replaced. If its ``install`` fails, the plan is as it was."""
        before = (list(self.slots), list(self.plugins), dict(self.policies), self.max_tokens, self.reserve)
        self.plugins = [p for p in self.plugins if p.name != plugin.name] + [plugin]
        if plugin.compressor:
            self.compressor(*plugin.compressor)
        try:
            if plugin.install:
                plugin.install(self)
        except Exception:
            self.slots, self.plugins, self.policies, self.max_tokens, self.reserve = before
            raise
        return self

    def drop(self, name: str) -> ContextPlan:
        """Take a plugin out; its ``destroy`` is called."""
        for p in [p for p in self.plugins if p.name == name]:
            self.plugins.remove(p)
            if p.destroy:
                p.destroy(self)
        return self

    def policy(self, name: str, step: Step) -> ContextPlan:
        """A named policy over the items of its slots; they have their slot's ``budget``."""
        self.policies[name] = step
        return self

    def compressor(self, name: str, rewrite: Callable[[Column], Column]) -> ContextPlan:
        """A text compressor as a policy of its own name."""
        return self.policy(name, lambda items: ov.compress_text(items, rewrite))

    def _hook(self, name: str, value, failures: list[tuple[str, str, str]]):
        """The plugins' steps of one hook in order. A step that raises is left out and told, unless its plugin is required."""
        for p in self.plugins:
            if (step := getattr(p, name)) is None:
                continue
            try:
                value = step(value)
            except Exception as e:  # noqa: BLE001 a user's code; one plugin's failure doesn't end the build
                if p.required:
                    raise
                failures.append((p.name, name, str(e)[:200]))
        return value

    # ---- validation ----

    def validate(self) -> None:
        if not self.slots:
            raise InvalidConfig("a context needs a slot")
        if self.max_tokens <= 0 or self.reserve < 0 or self.reserve >= self.max_tokens:
            raise InvalidConfig(f"a reserve of {self.reserve} leaves nothing of {self.max_tokens} tokens")
        total = self.max_tokens - self.reserve
        if (shares := sum(s.percent or 0 for s in self.slots)) > 100:
            raise InvalidConfig(f"percent budgets add up to {shares}")
        if (fixed := sum(s.fixed or 0 for s in self.slots if s.budget_kind == "fixed")) > total:
            raise InvalidConfig(f"fixed budgets of {fixed} are over {total} tokens")
        if (least := sum(s.min or 0 for s in self.slots if s.budget_kind == "flex")) > total - fixed:
            raise InvalidConfig(f"minimum budgets of {least} are over the {total - fixed} tokens that fixed ones leave")
        for s in self.slots:
            if s.overflow not in BUILT_IN and s.overflow not in self.policies:
                raise InvalidConfig(f"slot {s.name!r}: unknown policy {s.overflow!r}")
            if s.overflow == "semantic" and s.overflow not in self.policies and self.anchors is None:
                raise InvalidConfig(f"slot {s.name!r}: semantic selection needs anchors and vectors")

    # ---- build ----

    def _apply(self, overflow: str, items: DataFrame) -> DataFrame:
        budget = F.col("budget")
        summarise = self.summarise or summarising()
        if overflow in self.policies:
            return self.policies[overflow](items)
        if overflow == "truncate-latest":
            return ov.truncate_latest(items, budget)
        if overflow == "sliding-window":
            return ov.sliding_window(items, budget, F.coalesce("window", F.lit(ov.DEFAULT_WINDOW)))
        if overflow == "compress":
            return ov.compress_text(items, Lossless())
        if overflow == "summarize":
            return ov.truncate(summarise(items), budget)
        if overflow == "fallback-chain":
            return ov.fallback_chain(items, budget, [summarise, lambda i: ov.compress_text(i, Lossless())], strict=True)
        if overflow == "error":
            return ov.demand(items, budget)
        if overflow == "semantic":
            return sm.select(items, self.anchors, budget).select(*items.columns)
        return ov.truncate(items, budget)

    def build(self, items: DataFrame, force: bool = False) -> Build:
        """``items``: ctx_id, slot, seq, role, text, tokens, pinned, created_at, optionally ephemeral and others.

        Slots over their budget go to their policy. Before that, slots near it do if ``proactive`` is set, and with ``force`` all do, to a smaller
        budget; protected slots are left alone. Items of unknown slots and slots over their max_items are errors. Ephemeral items take part once: ``next_items`` is what a next build starts from.
        """
        failures: list[tuple[str, str, str]] = []
        plan = replace(self, slots=self._hook("prepare", list(self.slots), failures))
        plan.validate()
        spark: SparkSession = items.sparkSession
        bounds = F.broadcast(spark.createDataFrame([(s.name, s.max_items) for s in plan.slots], "slot string, max_items int"))
        sizes = items.groupBy("ctx_id", "slot").agg(F.count(F.lit(1)).alias("n")).join(bounds, "slot", "left")
        if (bad := sizes.filter("max_items is null or n > max_items").first()) is not None:  # a few figures of each slot
            raise InvalidConfig(f"unknown slot {bad['slot']!r}" if bad["max_items"] is None else f"slot {bad['slot']!r} of context {bad['ctx_id']} has {bad['n']} items, over {bad['max_items']}")
        rows = [(s.name, s.priority, s.budget_kind, s.fixed, float(s.percent) if s.percent is not None else None, s.min, s.max, s.overflow, s.position, s.ord, s.max_items, s.protected, s.default_role, s.window) for s in plan.slots]
        table = F.broadcast(spark.createDataFrame(rows, bd.SLOT_SCHEMA + ", window int"))
        slots = items.select("ctx_id").distinct().withColumn("total", F.lit(plan.max_tokens - plan.reserve).cast("bigint")).join(table, how="cross")  # a few slots for each context
        slots = bd.allocate(plan._hook("slots", slots, failures)).withColumnRenamed("allocated", "budget")
        if any(p.slots for p in plan.plugins) and (bad := slots.filter("error is not null").first()) is not None:
            raise InvalidConfig(f"budgets of context {bad['ctx_id']}: {bad['error']}")
        slots = plan._hook("after_budget", slots, failures)
        ready = ct.counted(plan._hook("content", items, failures), **plan.counting)
        ready = ready.withColumn("role", F.coalesce("role", F.lit(None).cast("string"))) if "role" in ready.columns else ready.withColumn("role", F.lit(None).cast("string"))
        roles = F.broadcast(spark.createDataFrame([(s.name, s.default_role) for s in plan.slots], "slot string, _role string"))
        ready = ready.join(roles, "slot").withColumn("role", F.coalesce("role", "_role")).drop("_role")
        ready = plan._hook("before_overflow", ready, failures)
        # what each slot's policy is called for, and to which budget
        used = F.sum(F.coalesce("tokens", F.lit(0))).over(W.partitionBy("ctx_id", "slot")).alias("used")
        placed = ready.join(slots.select("ctx_id", "slot", "budget", "overflow", "protected", "window"), ["ctx_id", "slot"]).select("*", used)
        placed = ov.triggers(placed, force, plan.proactive, plan.ratio)
        idle = F.col("action").isin("none", "protected")
        kept = placed.filter(idle).select(*ready.columns)
        for overflow in sorted({s.overflow for s in plan.slots if not s.protected}):
            mine = placed.filter((F.col("overflow") == overflow) & ~idle).withColumn("budget", F.col("effective"))
            kept = kept.unionByName(plan._apply(overflow, mine).select(*ready.columns))
        warned = placed.filter("action = 'protected'").select("ctx_id", "slot", F.lit("PROTECTED_OVER_BUDGET").alias("warning")).distinct()
        kept = ov.escalate(kept, slots, F.col("total"))
        kept = plan._hook("after_overflow", kept, failures)
        exhausted = ov.escalation_warnings(kept, slots.select("ctx_id", "total").distinct())
        warned = warned.unionByName(exhausted.select("ctx_id", F.lit(None).cast("string").alias("slot"), "warning"))
        if failures:
            told = spark.createDataFrame([(f"PLUGIN {p} {h}: {e}",) for p, h, e in failures], "warning string")
            warned = warned.unionByName(items.select("ctx_id").distinct().join(F.broadcast(told), how="cross").select("ctx_id", F.lit(None).cast("string").alias("slot"), "warning"))  # a few failures for each context
        messages = plan._hook("messages", sn.compile_messages(kept, slots), failures)
        gone = ov.evicted(ready, kept, "build")
        after = items.filter(~F.coalesce("ephemeral", F.lit(False))) if "ephemeral" in items.columns else items
        built = Build(slots, kept, gone, messages, sn.slot_meta(kept, slots, gone), warned, after)
        for p in plan.plugins:
            if p.after_build:
                p.after_build(built)
        return built


def summarising(step: str = "progressive", budget: int | None = None, **how) -> Step:
    """A policy that puts summaries in place of old items; by default each slot works to its own ``budget``."""
    def run(items: DataFrame) -> DataFrame:
        make = su.progressive if step == "progressive" else su.map_reduce
        made = make(items, F.col("budget") if budget is None else budget, **how).select("ctx_id", "slot", "seq", "text", "tokens", "created_at", "pinned", "kind")
        given = items.select("ctx_id", "slot", "seq", *[c for c in items.columns if c not in made.columns])
        rows = made.join(given, ["ctx_id", "slot", "seq"], "left")
        return rows.withColumn("role", F.coalesce("role", F.when(F.col("kind") != "item", "assistant"))).select(*items.columns)

    return run
