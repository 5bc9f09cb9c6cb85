import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from tallyloom.operators import budget as bd

SCHEMA = "ctx_id bigint, total bigint, slot string, priority int, budget_kind string, fixed bigint, percent double, min bigint, max bigint"


def allocated(spark, slots, total, ctx=1):
    rows = [(ctx, total, *s) for s in slots]
    return {(r.ctx_id, r.slot): r.allocated for r in bd.allocate(spark.createDataFrame(rows, SCHEMA)).collect()}


def fixed(name, n, p=50):
    return (name, p, "fixed", n, None, None, None)


def percent(name, x, p=50):
    return (name, p, "percent", None, float(x), None, None)


def flex(name, p=50, low=None, high=None):
    return (name, p, "flex", None, None, low, high)


CASES = [
    (1100, [fixed("sys", 100), percent("hist", 50)], {"sys": 100, "hist": 1000}),
    (1000, [fixed("a", 100), percent("b", 33), flex("c")], {"a": 100, "b": 297, "c": 603}),
    (101, [flex("a", 90), flex("b", 10)], {"a": 51, "b": 50}),
    (7, [flex("a", 99), flex("b", 10)], {"a": 4, "b": 3}),
    (100, [flex("a", 90, 10, 15), flex("b", 10)], {"a": 15, "b": 85}),
]


@pytest.mark.parametrize("total,slots,want", CASES)
def test_literal_cases(spark, total, slots, want):
    assert {k[1]: v for k, v in allocated(spark, slots, total).items()} == want


def test_round_robin_gives_everything_away(spark):
    assert sum(allocated(spark, [percent("a", 50), percent("b", 40)], 1003).values()) == 1003


def by_hand(slots, total):
    """The allocation one token at a time."""
    order = sorted(slots, key=lambda s: (-s[1], s[0]))
    out = {s[0]: s[3] for s in order if s[2] == "fixed"}
    pool = total - sum(out.values())
    for s in order:
        if s[2] == "percent":
            out[s[0]] = int(pool * s[4] // 100)
    rest = pool - sum(out[s[0]] for s in order if s[2] == "percent")
    flexes = [s for s in order if s[2] == "flex"]
    if not flexes:
        shares = [s for s in order if s[2] == "percent"]
        i = 0
        while rest > 0 and shares:
            out[shares[i % len(shares)][0]] += 1
            rest, i = rest - 1, i + 1
        return out
    even = (rest - sum(s[5] or 0 for s in flexes)) // len(flexes)
    for s in flexes:
        out[s[0]] = min(s[6] if s[6] is not None else 10**9, (s[5] or 0) + even)
    rest -= sum(out[s[0]] for s in flexes)
    for s in flexes:
        while rest > 0 and out[s[0]] < (s[6] if s[6] is not None else 10**9):
            out[s[0]] += 1
            rest -= 1
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(200, 2000), st.integers(0, 3), st.integers(0, 2), st.lists(st.tuples(st.integers(1, 9), st.integers(0, 20)), max_size=3)), min_size=4, max_size=12))
def test_matches_a_loop(spark, contexts):
    rows, want = [], {}
    for ctx, (total, n_fixed, n_percent, flexes) in enumerate(contexts):
        slots = [fixed(f"f{i}", 30, i) for i in range(n_fixed)] + [percent(f"p{i}", 17, i) for i in range(n_percent)] + [flex(f"x{i}", p, low, low + 25 if i % 2 else None) for i, (p, low) in enumerate(flexes)]
        rows += [(ctx, total, *s) for s in slots]
        want |= {(ctx, k): v for k, v in by_hand(slots, total).items()}
    got = {(r.ctx_id, r.slot): r.allocated for r in bd.allocate(spark.createDataFrame(rows, SCHEMA)).collect()} if rows else {}
    assert got == want
