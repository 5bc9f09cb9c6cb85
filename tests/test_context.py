import pytest
from pyspark.sql import functions as F

from tallyloom.plans.context import ContextOverflow, ContextPlan, InvalidConfig, Plugin, Slot, summarising

SCHEMA = "ctx_id bigint, slot string, seq bigint, role string, text string, tokens bigint, pinned boolean, created_at bigint"


def items(spark, n=10, tokens=10):
    return spark.createDataFrame([(c, "history", i, "user", f"m{i}. more words here", tokens, False, i) for c in (1, 2) for i in range(n)], SCHEMA)


@pytest.mark.parametrize("how", [{"priority": 0}, {"priority": 5, "budget_kind": "fixed"}, {"priority": 5, "budget_kind": "percent", "percent": 101}, {"priority": 5, "min": 9, "max": 3}, {"priority": 5, "position": "top"}])
def test_wrong_slots(how):
    with pytest.raises(InvalidConfig):
        Slot("x", **how)


def test_wrong_plans(spark):
    for plan in (ContextPlan(), ContextPlan().slot("a", 5, budget_kind="percent", percent=60).slot("b", 5, budget_kind="percent", percent=60), ContextPlan().tokens(10).slot("a", 5, budget_kind="fixed", fixed=11), ContextPlan().slot("a", 5, overflow="magic")):
        with pytest.raises(InvalidConfig):
            plan.validate()


def test_build_truncates_and_plugins_run(spark):
    seen = Plugin("shout", before_overflow=lambda d: d.withColumn("text", F.upper("text")), messages=lambda d: d.withColumn("tag", F.lit("x")))
    built = ContextPlan().tokens(45).slot("history", 50).use(seen).use(seen).build(items(spark))
    assert built.items.count() == 8 and built.evicted.count() == 12
    rows = built.messages.filter("ctx_id = 1").orderBy("pos").collect()
    assert [r.text[:2] for r in rows] == ["M6", "M7", "M8", "M9"] and rows[0].tag == "x"
    assert built.meta.first().used == 40


def test_error_policy_and_presets(spark):
    with pytest.raises(ContextOverflow):
        ContextPlan().tokens(50).slot("history", 50, overflow="error").build(items(spark))
    assert [s.name for s in ContextPlan().preset("agent").slots] == ["system", "tools", "scratchpad", "history"]


def test_protected_slots_and_summaries(spark):
    assert ContextPlan().tokens(50).slot("history", 50, protected=True).build(items(spark)).items.count() == 20
    plan = ContextPlan().tokens(95).slot("history", 50, overflow="sum").policy("sum", summarising(budget=95))
    built = plan.build(items(spark))
    assert built.items.groupBy("ctx_id").agg(F.sum("tokens").alias("t")).filter("t > 95").isEmpty()
    assert not built.items.filter("role = 'assistant'").isEmpty()
