"""Steps whose work must grow with the input: similar texts, folds over large slots, counts of odd texts, hashes of long ones."""

import random

from pyspark.sql import functions as F

from tallyloom.operators import facts as fc


def _sim(a, b):
    return 1.0 if not a and not b else len(a & b) / max(1, len(a | b))


def _near(rng, words, sizes, copies, most):
    """Word sets with others near them."""
    out = []
    for n in sizes:
        base = set(rng.sample(words, n))
        out.append(base)
        for _ in range(copies):
            x = set(base)
            for _ in range(rng.randint(0, most(n))):
                x ^= {rng.choice(words)}
            out.append(x)
    return out


def test_to_remember_matches_all_pairs(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    said = [" ".join(rng.sample(sorted(x), len(x))) for x in _near(rng, words, [6, 13, 20, 30, 60, 120], 12, lambda n: n // 9 + 1)] + ["…!?"]
    told = said[::3] + ["?? ??", "???"]
    found = spark.createDataFrame([(i % 4, i, 0, t) for i, t in enumerate(told + said)], "ctx_id bigint, seq bigint, part int, sentence string")
    memories = spark.createDataFrame([(str(i), t) for i, t in enumerate(said[::2] + ["—"])], "id string, content string")
    sets = lambda t: {w for w in t.split() if w.startswith("w")}
    known = [sets(t) for t in said[::2] + ["—"]]
    want = {i for i, t in enumerate(told + said) if not any(_sim(sets(t), k) >= 0.92 for k in known)}
    assert {r.seq for r in fc.to_remember(found, memories).collect()} == want  # a memory without words says what a sentence without words does
    assert 0 < len(want) < len(told + said)


def test_common_words_are_no_keys(spark):
    from tallyloom.operators.similarity import signatures, word_hashes

    rng = random.Random(12)
    common = [f"c{i}" for i in range(30)]
    texts = [" ".join(common + [f"r{rng.randrange(10**6)}" for _ in range(40)]) for _ in range(300)]
    sets = spark.createDataFrame(list(enumerate(texts)), "i bigint, text string").select((F.col("i") * 2).alias("h"), F.lit(0).cast("bigint").alias("salt"), word_hashes(F.col("text")).alias("words"))
    met = signatures(sets, 0.88).groupBy("sig").agg(F.count_distinct(F.shiftright("h", 1)).alias("n"))
    assert met.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] < 300 * 299 / 2 * 0.02


def test_near_duplicates_of_long_texts_match_a_loop(spark):
    from tallyloom.operators.similarity import drop_near_duplicates

    rng = random.Random(13)
    words = [f"w{i}" for i in range(200)]
    sets = [(c, x) for c in range(3) for x in _near(rng, words, [1, 4, 9, 17, 40, 90], 9, lambda n: n // 8 + 1)]
    rng.shuffle(sets)
    df = spark.createDataFrame([(c, i, " ".join(sorted(x))) for i, (c, x) in enumerate(sets)], "ctx_id bigint, seq bigint, text string")
    want, kept = set(), {}
    for i, (c, x) in enumerate(sets):
        if not any(_sim(x, k) >= 0.88 for k in kept.setdefault(c, [])):
            kept[c].append(x)
            want.add(i)
    out = drop_near_duplicates(df, 0.88)
    assert {r.seq for r in out.collect()} == want and 0 < len(want) < len(sets)
    assert "collect_set" not in out._jdf.queryExecution().toString()  # no array holds a context's pairs


def test_build_semantic_takes_large_slots(spark, tmp_path):
    from tallyloom.operators import overflow as ov
    from tallyloom.registry import queries

    rng = random.Random(14)
    vectors = [(i, [rng.random(), rng.random()], 0) for i in range(10_050)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = queries()["build_semantic"](spark, str(tmp_path)).collect()
    assert {r.seq for r in rows if r.seq % 50 == 0} == set(range(0, 10_050, 50))  # pinned ones stay, and leave no room
    items = [(i % 2, i, rng.choice([0, 0, 3, 7, 7, 11, 40, 200])) for i in range(3000)]
    want = set()
    for c, budget in ((0, 150), (1, -1)):
        used = 0
        for _, i, t in (x for x in items if x[0] == c):
            if used + t <= budget:
                used += t
                want.add(i)
    df = spark.createDataFrame(items, "ctx_id bigint, seq bigint, tokens bigint").withColumn("room", F.when(F.col("ctx_id") == 0, 150).otherwise(-1))
    assert {r.seq for r in ov.greedy_fit(df, F.col("room"), ["seq"], ["ctx_id"]).collect()} == want


def test_results_without_text_count_one_token(spark):
    from tallyloom.operators.retrieval import truncate_results

    rows = [(1, "", 0, False), (2, None, 0, False), (3, None, None, True), (4, "", 0, True), (5, "x" * 2001, 501, False), (6, "x" * 2001, 501, True)]
    df = spark.createDataFrame(rows, "seq bigint, text string, tokens bigint, definition boolean")
    assert {r.seq: (r.truncated, r.tokens) for r in truncate_results(df).collect()} == {1: (False, 1), 2: (False, 1), 3: (False, 1), 4: (False, 1), 5: (True, 499), 6: (False, 501)}


def test_fnv_of_long_texts(spark):
    from tallyloom.functions import tokens as tk

    def fnv(text):
        h, b = 2166136261, text.encode("utf-16-le")
        for i in range(0, len(b), 2):
            h = (h ^ (b[i] | b[i + 1] << 8)) * 16777619 & 0xFFFFFFFF
        return h

    texts = ["", "a", "é😀b中", "abcdefghi", "ab😀" * 100_000, *["xy" * 40] * 30]  # the long one took quadratic time
    df = spark.createDataFrame(list(enumerate([*texts, None])), "i int, text string").select("i", tk.fnv1a32(F.col("text")).alias("h"), tk.char_encode(F.col("text")).alias("ids"))
    got = {r.i: (r.h, r.ids) for r in df.collect()}
    assert got == {i: (fnv(t), [fnv(t[k : k + 4]) for k in range(0, len(t), 4)]) for i, t in enumerate([*texts, ""])}
