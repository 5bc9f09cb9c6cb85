"""Builds that can't work, plugins, payloads and compression of items, by small cases."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as tx, tokenizers as tz
from tallyloom.operators import compression as cm, content as ct, formats as fm, snapshot as sn
from tallyloom.plans.context import ContextOverflow, ContextPlan, InvalidConfig, Plugin
from tallyloom.sources import store

SCHEMA = "ctx_id bigint, slot string, seq bigint, role string, text string, tokens bigint, pinned boolean, created_at bigint"


def items(spark, n=6, slot="history", pinned=False):
    return spark.createDataFrame([(1, slot, i, None, f"m{i}", 10, pinned, i) for i in range(n)], SCHEMA)


def test_builds_that_cannot_work_raise(spark):
    with pytest.raises(InvalidConfig):  # the reserve leaves too little for the fixed slot
        ContextPlan().tokens(1000, reserve=900).slot("history", 5, budget_kind="fixed", fixed=500).build(items(spark))
    with pytest.raises(InvalidConfig):
        ContextPlan().tokens(100).slot("history", 5, min=200).build(items(spark))
    with pytest.raises(InvalidConfig, match="unknown slot"):
        ContextPlan().slot("system", 5).build(items(spark))
    with pytest.raises(InvalidConfig, match="over 2"):
        ContextPlan().slot("history", 5, max_items=2).build(items(spark))
    with pytest.raises(InvalidConfig, match="anchors"):
        ContextPlan().slot("history", 5, overflow="semantic").build(items(spark))
    with pytest.raises(ContextOverflow):  # pinned items that truncation can't touch end the chain in an error
        ContextPlan(summarise=lambda i: i).tokens(30).slot("history", 5, overflow="fallback-chain").build(items(spark, pinned=True))
    with pytest.raises(InvalidConfig):
        ContextPlan().slot("history", 5).overridden(slots={"nothing": {"priority": 7}})
    plan = ContextPlan().tokens(1000).slot("history", 5).overridden(max_tokens=50, slots={"history": {"priority": 7}})
    assert plan.max_tokens == 50 and plan.slots[0].priority == 7 and plan.list_slots()[0].name == "history"


def test_plugins_are_apart_from_each_other(spark):
    def fails(_):
        raise RuntimeError("broken")

    told = []
    plan = ContextPlan().slot("history", 5).use(Plugin("bad", before_overflow=fails)).use(Plugin("good", before_overflow=lambda d: d.withColumn("text", F.upper("text")), after_build=told.append))
    built = plan.build(items(spark, 2))
    assert {r.text for r in built.items.collect()} == {"M0", "M1"} and {r.role for r in built.items.collect()} == {"user"}
    assert [r.warning for r in built.warnings.collect()] == ["PLUGIN bad before_overflow: broken"] and told == [built]
    with pytest.raises(RuntimeError):
        ContextPlan().slot("history", 5).use(Plugin("bad", before_overflow=fails, required=True)).build(items(spark, 2))

    def installs(p):
        p.slot("extra", 9)
        raise RuntimeError("no")

    plan = ContextPlan().slot("history", 5)
    with pytest.raises(RuntimeError):
        plan.use(Plugin("half", install=installs))
    assert [s.name for s in plan.slots] == ["history"] and plan.plugins == []
    gone = []
    plan.use(Plugin("c", compressor=("short", lambda t: F.substring(t, 1, 1)), destroy=gone.append)).update_slot("history", overflow="short").tokens(15)
    assert {r.text for r in plan.build(items(spark, 2)).items.collect()} == {"m"} or plan.build(items(spark, 2)).items.isEmpty()
    plan.drop("c")
    assert gone == [plan]


def test_payloads_of_images_and_tools(spark):
    part = lambda kind, text=None, url=None, data=None, mime=None: (kind, text, url, data, mime)
    rows = [
        (1, 0, "system", "Be", None, None, None, None), (1, 1, "user", None, [part("text", "a"), part("text", "b")], None, None, None), (1, 2, "user", "c", None, None, None, None), (1, 3, "assistant", None, [], None, None, [("i", "f", '{"x":[1]}')]),
        (1, 4, "tool", '{"ok": true}', None, "f", "i", None), (1, 5, "function", "out", None, None, None, None), (1, 6, "user", None, [part("image", data="QUJD"), part("text", "see")], None, None, None),
    ]
    m = ct.compiled(spark.createDataFrame(rows, f"ctx_id int, pos int, role string, text string, parts {ct.PARTS}, name string, tool_call_id string, tool_uses {ct.TOOL_USES}"))
    got = {name: fm.format_messages(m, name).first() for name in fm.FORMATS}
    openai = json.loads(got["openai"].payload)
    assert openai[1] == {"role": "user", "content": "ab"} and openai[3] == {"role": "assistant", "content": None}
    assert openai[4] == {"role": "tool", "tool_call_id": "i", "content": '{"ok": true}', "name": "f"} and openai[5] == {"role": "function", "name": "function", "content": "out"}
    assert openai[6]["content"] == [{"type": "image_url", "image_url": {"url": "data:image/png;base64,QUJD"}}, {"type": "text", "text": "see"}]
    claude = json.loads(got["anthropic"].payload)
    assert got["anthropic"].system == "Be" and claude[0] == {"role": "user", "content": "abc"}
    assert claude[1]["content"] == [{"type": "tool_use", "id": "i", "name": "f", "input": {"x": [1]}}]
    assert [b["type"] for b in claude[2]["content"]] == ["tool_result", "text", "image", "text"]
    gemini = json.loads(got["gemini"].payload)
    assert json.loads(got["gemini"].system) == [{"text": "Be"}] and gemini[1] == {"role": "model", "parts": [{"functionCall": {"name": "f", "args": {"x": [1]}}}]}
    assert gemini[2]["parts"][0] == {"functionResponse": {"name": "f", "response": {"ok": True}}} and {"inlineData": {"mimeType": "image/png", "data": "QUJD"}} in gemini[2]["parts"]
    llama = json.loads(got["ollama"].payload)
    assert llama[3]["tool_calls"] == [{"function": {"name": "f", "arguments": {"x": [1]}}}] and llama[4]["tool_name"] == "f" and llama[5]["role"] == "user" and llama[6]["images"] == ["QUJD"]
    assert got["text"].payload.split("\n\n")[-1] == "[image]\nsee"
    fm.register_adapter(fm.Adapter("own", lambda x: x.groupBy("ctx_id").agg(F.count(F.lit(1)).alias("payload"))))
    assert fm.format_messages(m, "own").first().payload == 7


def test_items_are_compressed_by_their_language(spark):
    rows = [(1, "h", 0, "user", "Well, do it. Thanks!", None), (1, "h", 1, "assistant", "You're welcome! For example tea", None), (1, "h", 2, "user", "naja das ist zum Beispiel Tee", "de-AT"), (1, "h", 3, "user", "Das ist z. B. Tee", "de"), (1, "h", 4, "user", "well, more", "minimal")]
    df = spark.createDataFrame(rows, "ctx_id int, slot string, seq int, role string, text string, locale string")
    got = {r.seq: r.text for r in cm.compress_items(df).collect()}
    assert got == {0: "do it.", 1: "e.g. tea", 2: "das ist z. B. Tee", 4: "well, more"}
    assert set(cm.compress_items(df.drop("locale"), tx.Lossless(tx.EN), dedupe=None).toPandas()["seq"]) == {0, 1, 2, 3, 4}
    found = cm.compress_items(df.drop("locale"), detect=lambda t: F.when(F.contains(t, F.lit("das")), "de"), dedupe=None)
    assert {r.seq: r.text for r in found.collect()}[2] == "das ist z. B. Tee"


def test_migrations_chain_and_unknown_versions_are_told(spark):
    old = spark.createDataFrame([(1, '{"version":"0.8"}'), (2, '{"version":"0.9","messages":[{"role":"user","content":"x"}]}'), (3, '{"version":"0.1"}'), (4, "no json")], "ctx_id int, body string")
    sn.register_migration("0.8", "0.9", lambda d: d.withColumn("body", F.lit('{"version":"0.9","messages":[]}')))
    try:
        done, lost = sn.migrated(old)
        assert {r.ctx_id for r in done.collect()} == {1, 2} and {r.ctx_id for r in lost.collect()} == {3, 4}
        assert [r.text for r in sn.deserialise(done).collect()] == ["x"]
    finally:
        del sn.MIGRATIONS["0.8"]


def test_counting_policies(spark):
    df = items(spark, 2).withColumn("tokens", F.lit(None).cast("bigint"))
    assert [r.tokens for r in ct.counted(df).collect()] == [0, 0] and [r.tokens for r in ct.counted(df, estimate=True).collect()] == [1, 1]
    for how in ({}, {"accountant": lambda d: d, "lazy": True}):
        with pytest.raises(ct.TokenPolicyError):
            ct.counted(df, authoritative=True, **how)


def test_restoring_checks_slots_and_versions(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    store.checkpoint(items(spark), path, 0)
    assert store.restore(spark, path, 0, ["history"]).count() == 6
    for how in ({"version": 3}, {"version": 0, "slots": ["other"]}):
        with pytest.raises(store.StoreError):
            store.restore(spark, path, **how)
    with pytest.raises(store.StoreError):
        store.known(items(spark), spark.createDataFrame([(1, "history", 99)], "ctx_id bigint, slot string, seq bigint"))


def test_builds_as_a_stream(spark, tmp_path):
    from tallyloom.streaming import context_stream as cs

    items(spark).withColumn("role", F.lit("user")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    cs.build_stream(ContextPlan().tokens(30).slot("history", 5).slot("system", 9, budget_kind="fixed", fixed=0, position="before"), stream, f"{tmp_path}/check", f"{tmp_path}/out").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out/slots").orderBy("slot_pos").collect()
    assert [(r.slot, r.n) for r in rows] == [("system", 0), ("history", 3)]
    assert spark.read.parquet(f"{tmp_path}/out/complete").count() == 1


def test_token_ids_round_trip(spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([("the ﬁne cat",), ("",)], "t string")
    got = df.select(tz.decode_tokens(tz.encode_tokens(F.col("t"), path, P.PATTERN, normalise=True), path, P.PATTERN).alias("x"), tz.truncate_tokens(F.col("t"), 1, path, P.PATTERN).alias("y")).collect()
    assert [r.x for r in got] == ["the fine cat", ""] and got[0].y == "the"
