from pyspark.sql import functions as F

from tallyloom.operators import facts as fc, retrieval as rt, semantic as sm, snapshot as sn
from tallyloom.sources import store
from tallyloom.streaming import context_stream as cs

SCHEMA = "ctx_id bigint, slot string, seq bigint, role string, text string, tokens bigint, pinned boolean"


def test_checkpoint_tells_changed_slots_and_restores(spark, tmp_path):
    a = spark.createDataFrame([(1, "h", 0, "user", "x", 1, False), (1, "s", 0, "system", "y", 1, True)], SCHEMA)
    b = a.withColumn("text", F.when(F.col("slot") == "h", "z").otherwise(F.col("text")))
    assert store.checkpoint(a, str(tmp_path), 0).count() == 2
    assert [r.slot for r in store.checkpoint(b, str(tmp_path), 1).collect()] == ["h"]
    assert sorted(r.text for r in store.restore(spark, str(tmp_path), 0).collect()) == ["x", "y"]


def test_jsonl_headers_are_left_out(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"_type":"header","v":1}\n{"q":"a","n":1}\n{"q":"b","n":2}\n')
    assert {r.q for r in store.read_jsonl(spark, str(path), "q string, n int").collect()} == {"a", "b"}


def test_semantic_case(spark):
    rows = [(1, 1, [1.0, 0.0], 10, False, 1), (1, 2, [0.0, 1.0], 10, False, 2), (1, 3, [0.9, 0.1], 10, True, 3)]
    items = spark.createDataFrame(rows, "ctx_id bigint, seq bigint, vector array<double>, tokens bigint, pinned boolean, created_at bigint")
    anchors = spark.createDataFrame([(1, [1.0, 0.0])], "ctx_id bigint, anchor array<double>")
    assert {r.seq for r in sm.select(items, anchors, 25, k=0.0).collect()} == {1, 3}


def test_upsert_keeps_what_a_change_leaves_out(spark):
    kind = "id string, content string, created_at bigint, updated_at bigint, metadata string"
    old, new = spark.createDataFrame([("a", "1", 1, 1, "m")], kind), spark.createDataFrame([("a", "2", 9, 9, None)], kind)
    assert tuple(rt.upsert(old, new).first()) == ("a", "2", 1, 9, "m")
    assert rt.upsert(old, new, keep_metadata=False).first().metadata is None


def test_decay_and_diff(spark):
    got = spark.range(1).select(fc.decayed(F.lit(0.8), F.lit(0), F.lit(30 * 60_000)).alias("x")).first().x
    assert abs(got - 0.4) < 1e-9
    kind = "ctx_id int, pos int, role string, text string"
    before = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b")], kind)
    after = spark.createDataFrame([(1, 0, "user", "a!")], kind)
    assert {(r.pos, r.change) for r in sn.diff(before, after).collect()} == {(0, "modified"), (1, "removed")}


def test_streams_equal_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), []
    items = spark.createDataFrame([(c, s, 10) for c in range(3) for s in range(5)], "ctx_id bigint, seq bigint, tokens bigint")
    items.repartition(2).write.parquet(src)
    stream = spark.readStream.schema(items.schema).parquet(src)
    cs.rebuild_on_change(stream, str(tmp_path / "cp"), lambda df, n: out.extend(df.collect())).awaitTermination()
    assert {r.ctx_id: r.tokens for r in out} == {0: 50, 1: 50, 2: 50}
    q = cs.running_window(spark.readStream.schema(items.schema).parquet(src), 30).writeStream.format("memory").queryName("kept").outputMode("update").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.ctx_id, r.tokens) for r in spark.table("kept").collect()} == {(c, 30) for c in range(3)}
