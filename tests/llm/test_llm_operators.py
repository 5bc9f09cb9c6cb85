"""The training-data operators against brute force, on a small table with every awkward case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import bpe, decontam, exact_dedup, langid, line_dedup, lm, minhash, pii, token_output, toxicity
from tallyloom.llm.words import shingle_set

#: Extra columns with names that operators use themselves.
EXTRA = {"h1": 1, "hits": 2, "kept": 3, "__row": 4, "row": 5, "place": 6, "t1": 7, "size": 8, "first": 9, "__gone": 10}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{x} int" for x in EXTRA)
WORDS = "the of and to in is it that was for on are as with his they at be this have from or one had by word but not what all were we when your can said there".split()


def rows(seed=1):
    """Plain texts, copies, near copies, shared lines, nulls, empty and long texts, repeated rows, null ids."""
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    out = [(i, f"{text(40)}.\n{text(12)}") for i in range(30)]
    base = [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(200)]
    for i in range(30, 60):  # a chain and a cloud of near copies
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(200)] = "x" + str(rng.randint(0, 10**6))
        out.append((i, " ".join(copy)))
    out += [(i, "Same  text\there" if i % 2 else "Same text here") for i in range(60, 70)]
    out += [(i, f"unique {i} line\n  Shared LINE  \nÉnd {i}\n") for i in range(70, 85)]
    out += [(85, None), (86, ""), (87, " \n\t "), (88, "a"), (89, "A b"), (90, "one two three four five " * 3000), (91, "mail me a.b@c.org or 10.0.0.1, card 4111 1111 1111 1111, +1 (658) 555-4270")]
    out += [(7, out[7][1]), (7, "another text with the same id"), (None, "Same text here"), (None, None), (None, text(30))]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, rows()).cache()


def table(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", 0, *EXTRA.values()) for i, t in pairs], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, pairs=((1, 1, 0), (2, 1, 0), (3, 0, 1))):
    return spark.createDataFrame(list(pairs), "doc_id bigint, quality int, toxic int")


def extras(df):
    """Extra columns keep their names and values."""
    return df.columns[:15] == [*"doc_id text lang source n_chars".split(), *EXTRA] and {tuple(r) for r in df.select("lang", "source", "n_chars", *EXTRA).distinct().collect()} <= {("en", "s", 0, *EXTRA.values())}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    for df in (line_dedup.line_dedup(empty), exact_dedup.exact_dedup(empty), minhash.near_dedup(empty), bpe.encode_table(empty), token_output.token_digests(empty), langid.languages(empty), pii.personal_data(empty), lm.katz_scores(empty), toxicity.severity(empty, labels(spark)), decontam.contamination(empty, bench)):
        assert df.count() == 0
    for df in (line_dedup.drop_hot_lines(empty), minhash.drop_near_copies(empty), toxicity.drop_toxic(empty, labels(spark)), decontam.drop_contaminated(empty, bench), decontam.drop_contaminated(empty, spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string"))):
        assert df.count() == 0 and df.columns == empty.columns


def test_line_dedup(docs):
    strip = " \t\n\x0b\f\r"
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(strip))
    df = Counter(k for _, t in rows() for k in {key(x) for x in (t or "").split("\n")} if k)
    want = Counter()
    for i, t in rows():
        lines = (t or "").split("\n")
        kept = [x for x in lines if df[key(x)] < 10]
        want[(i, len(lines), len(lines) - len(kept), sha("\n".join(kept)))] += 1
    got = Counter(tuple(r[c] for c in ("doc_id", "n_lines", "n_dropped", "kept_sha256")) for r in line_dedup.line_dedup(docs).collect())
    assert got == want
    kept = line_dedup.drop_hot_lines(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() and extras(kept)
    assert kept.filter("doc_id = 70").first().text == "unique 70 line\nÉnd 70\n"
    assert kept.filter("doc_id = 85").first().text is None


def test_line_runs_compact(spark, tmp_path):
    from tallyloom.llm.common import Workspace

    runs = line_dedup.LineRuns(Workspace(spark, "t"), min_docs=3, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(1, 1, 1), (b, 9, 1)], "h1 bigint, h2 bigint, n bigint"))
    assert sum(map(len, runs.levels.values())) <= 3
    assert {tuple(r) for r in runs.hot().collect()} == {(1, 1)}


def test_line_runs_stay_and_take_further_batches(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    made = [table(spark, [(b * 10 + i, f"own {b} {i}\nshared\n{'late' if b > 2 else 'early'}") for i in range(3)]) for b in range(5)]
    for docs in made:
        line_dedup.LineRuns.open(spark, path, min_docs=7, fanout=2).add_documents(docs)
    runs = line_dedup.LineRuns.open(spark, path, min_docs=7, fanout=2)
    assert runs.made == 5 and sum(map(len, runs.levels.values())) <= 3
    # runs that a compaction was about to remove don't count twice
    runs.work.write(runs._read([runs.levels[max(runs.levels)][0]]), "run-0-0-0")
    again = line_dedup.LineRuns.open(spark, path, min_docs=7, fanout=2)
    assert again.levels == runs.levels
    got = {r.doc_id: r.text for r in line_dedup.drop_lines_of(made[0].unionByName(made[4]), again).collect()}
    assert got[0] == "own 0 0" and got[42] == "own 4 2\nlate"


def test_digest_index_stays_and_prunes_by_its_filters(spark, tmp_path):
    path = f"file://{tmp_path}/digests"
    seen = set()
    for b in range(5):
        texts = [f"t{i}" for i in range(b * 300, b * 300 + 400)]
        got = {r.doc_id: (r.seen, r.first_id) for r in exact_dedup.DigestIndex.open(spark, path, fanout=2).add(table(spark, [(b * 1000 + i, t) for i, t in enumerate(texts)])).collect()}
        assert {i for i, (x, _) in got.items() if x} == {b * 1000 + i for i, t in enumerate(texts) if t in seen}
        assert all(got[b * 1000 + i][1] == (b - 1) * 1000 + 300 + i for i, t in enumerate(texts) if t in seen)
        seen.update(texts)
    index = exact_dedup.DigestIndex.open(spark, path, fanout=2)
    assert index.made == 5 and index.rows().count() == 1600
    fresh = spark.range(5000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    for name in index.names():
        held = index._read([name]).select("digest")
        assert index.maybe(held, name).count() == held.count()  # a filter passes all that its run holds
        assert index.maybe(fresh, name).count() < 500  # and few others


def test_exact_dedup(docs):
    norm = lambda t: re.sub("[ \t-\r]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows():
        groups[norm(t)].append(i)
    want = Counter()
    for i, t in rows():
        g = groups[norm(t)]
        keep = min((x for x in g if x is not None), default=None)
        want[(i, keep, len(g), i == keep, sha(norm(t)))] += 1
    got = Counter(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in exact_dedup.exact_dedup(docs).collect())
    assert got == want


def test_exact_dedup_looks_memtables_up_by_the_filters(spark, monkeypatch):
    probed, real = [], exact_dedup.DigestIndex.maybe

    def maybe(self, digests, name):
        passed = real(self, digests, name)
        probed.append((name, digests.count(), passed.count()))
        return passed

    monkeypatch.setattr(exact_dedup.DigestIndex, "maybe", maybe)
    pairs = [(i, f"t{i}" if i < 800 else f"t{i % 40}" if i < 880 else "hot") for i in range(1000)]
    answers = lambda **how: {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(table(spark, pairs), **how).collect()}
    want = {i: (i % 40, 3, i < 40) if i < 40 or 800 <= i < 880 else (i, 1, True) if i < 800 else (880, 120, i == 880) for i in range(1000)}
    assert answers(memtables=5, fanout=2) == want
    # each memtable after the first meets all runs before it, which compaction has merged, then the 41 shared digests the last ones
    assert [x for x, *_ in probed] == ["run-0-0-0", "run-1-0-1", "run-1-0-1", "run-0-2-2", "run-2-0-3", "run-2-0-3", "run-0-4-4"]
    assert [n for _, n, _ in probed[-2:]] == [41, 41]
    asked, passed = (sum(x[i] for x in probed[:-2]) for i in (1, 2))
    assert passed < asked / 2  # the filters leave out most of what a run doesn't hold
    # without what passes the filters, copies of different memtables don't meet
    monkeypatch.setattr(exact_dedup.DigestIndex, "maybe", lambda self, digests, name: digests.limit(0))
    assert answers() != want


def test_exact_dedup_survives_colliding_digests(spark, monkeypatch):
    real = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lpad(F.substring(real(c, n), 1, 1), 64, "0"))
    pairs = [(i, f"t{i % 20}") for i in range(60)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(table(spark, pairs)).collect()}
    assert got == {i: (i % 20, 3) for i in range(60)}


def components_of(pairs, percent):
    """(sets, component of each row) by comparing all pairs of rows."""
    sets = [frozenset(shingle_set((t or "").encode()).tolist()) for _, t in pairs]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    return sets, [root(i) for i in range(len(sets))]


def test_near_dedup(spark, docs):
    pairs = rows()
    sets, root = components_of(pairs, 85)
    name = {r: min((pairs[i][0] for i in range(len(pairs)) if root[i] == r and pairs[i][0] is not None), default=None) for r in root}
    want = Counter((i, len(s), name[r] if s else i, i == (name[r] if s else i)) for (i, _), s, r in zip(pairs, sets, root))
    assert Counter(tuple(r) for r in minhash.near_dedup(docs).collect()) == want
    for extra in ([], [(0, rows()[0][1])] * 3, [(None, "Same text here")] * 2 + [(5000, "lone copy of none"), (5000, "another one of this id here"), (5000, rows()[30][1])]):
        pairs = [*rows(), *extra]
        sets, root = components_of(pairs, 80)
        kept = minhash.drop_near_copies(table(spark, pairs))
        assert kept.columns == docs.columns and extras(kept)
        got = [(r.doc_id, r.text) for r in kept.collect()]
        groups = defaultdict(list)
        for (i, t), s, r in zip(pairs, sets, root):
            groups[r if s else (i, t)].append(i)
        best = Counter(min((i for i in g if i is not None), default=None) for r, g in groups.items() if isinstance(r, int))
        assert Counter(i for i, t in got if t and t.split()) == best
        assert Counter(x for x in got if not (x[1] and x[1].split())) == Counter(x for x, s in zip(pairs, sets) if not s)


def test_bands_fit_the_threshold():
    for percent in (70, 80, 85, 95, 100):
        assert (1 - (percent / 100) ** minhash.rows_of(percent)) ** minhash.BANDS <= 2e-6
    rng = np.random.default_rng(5)
    rows, found = minhash.rows_of(80), 0
    for _ in range(400):  # pairs at 0.8, the least that links
        base = rng.integers(0, 2**63, 540, dtype=np.uint64)
        a, b = (np.unique(np.r_[base[:480], base[k : k + 60]]) for k in (480, 420))
        b = np.unique(np.r_[base[:480], rng.integers(0, 2**63, 60, dtype=np.uint64)])
        keys = minhash.band_hashes(np.stack([minhash.registers(a), minhash.registers(b)]), rows)
        found += bool((keys[0] == keys[1]).any())
    assert found == 400


def test_minhash_estimates():
    rng = np.random.default_rng(3)
    for n in (1, 3, 40, 3000):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = a.copy()
        b[: n // 5] = rng.integers(0, 2**63, n // 5, dtype=np.uint64)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = minhash.estimate((minhash.registers(np.unique(a)) == minhash.registers(np.unique(b))).sum(), n, n)
        assert abs(got - true) < 0.12


def test_bpe_is_exact(spark, docs):
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.load_ranks(P.path(bpe.DEFAULT_RANKS))
    own, library = bpe.codec(P.path(bpe.DEFAULT_RANKS), P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    alphabet = " \n\t  ab.,'stéß漢字\xa0\x1c\x85😀019-_мир"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["abcdefgh" * 3000, "<|endoftext|>"]
    for text in texts:
        assert own.encode(text) == library.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()
    got = bpe.encode_table(docs)
    assert got.columns == [*docs.columns, "token_ids", "decoded"]
    assert all(r.decoded == (r.text or "") and list(r.token_ids) == library.encode_ordinary(r.text or "") for r in got.collect())


def test_token_output(spark, docs, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path(token_output.DEFAULT_TOKENIZER))
    start, want = 0, Counter()
    for i, t in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want[(i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        start += len(ids)
    path = str(tmp_path / "ids")
    got = Counter(tuple(r) for r in token_output.token_digests(docs, path).collect())
    assert got == want
    some = token_output.read_documents(spark, path, [90, 3])
    assert {(r.doc_id, r.start, len(r.token_ids)) for r in some.collect()} == {x[:3] for x in want if x[0] in (3, 90)}
    assert "In(doc_id, [3,90])" in some._jdf.queryExecution().executedPlan().toString()
    meta = token_output.read_metadata(spark, path)
    assert Counter(tuple(r) for r in meta.collect()) == Counter(x[:3] for x in want.elements())
    assert "token_ids" not in meta._jdf.queryExecution().executedPlan().toString()


def test_token_batches_look_distinct_pieces_up_once_and_are_exact(spark, monkeypatch):
    import public_tokenizers as P
    import pyarrow as pa
    from tallyloom.llm import pretoken
    from tokenizers import Tokenizer

    path = P.path(token_output.DEFAULT_TOKENIZER)
    library, encoder = Tokenizer.from_file(path), token_output._Encoder(path)
    end = np.array([2], "<u4").tobytes()

    def check(texts):
        ids, counts = encoder.batch(pa.array(["left out", *texts], pa.string()).slice(1), end)
        want = [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]

    check(["one two, one.\none two### don't", "one one one two two, one###"] * 50)
    # signs after a word and newlines aren't encoded again with each word
    assert set(encoder.cut.pieces) == {b"one", b" one", b" two", b",", b".", b"\n", b"###", b" don", b"'t"}
    rng = random.Random(8)
    atoms = [*" \n\t\r\x0b\x1c\x85\xa0\u2003\u3000'.,;!?#09aZbéß×÷ñĀɿʰѿωªº²中あ가🙂\ufeff\x00", "'s", "'re", "  ", "\n\n", " \n", "\n ", " the", "<|endoftext|>", "<|endo", "12"]
    monkeypatch.setattr(pretoken, "GATHERED", 50)
    for _ in range(40):
        check([None, "", *["".join(rng.choices(atoms, k=rng.randint(0, 14))) for _ in range(100)]])
    check([])
    check([None, ""])


def test_token_files_have_bounded_row_groups_pages_and_page_indexes(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "ids")
    rng = random.Random(2)
    pairs = [(i, " ".join(rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(200))) for i in range(3000)]
    token_output.write_tokens(table(spark, pairs).coalesce(1), path, row_group_bytes=256 << 10, page_bytes=16 << 10)
    files = glob.glob(f"{path}/*.parquet")
    groups, last = 0, -1
    for held in sorted((pq.ParquetFile(f) for f in files), key=lambda f: f.metadata.row_group(0).column(0).statistics.min):
        for g in range(held.metadata.num_row_groups):
            columns = {held.metadata.row_group(g).column(c).path_in_schema: held.metadata.row_group(g).column(c) for c in range(held.metadata.num_columns)}
            ids = columns["doc_id"]
            assert ids.has_offset_index and ids.has_column_index and ids.statistics.min > last  # in order of doc_id, so that statistics select
            last = ids.statistics.max
            assert any("DICTIONARY" in x or "DELTA" in x for x in columns["token_ids.list.element"].encodings + columns["n_tokens"].encodings)
            assert held.metadata.row_group(g).total_byte_size < 4 << 20
            groups += 1
    assert groups > len(files)


def test_pieces_with_another_pattern_or_tokenizer_are_whole(spark):
    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    pattern = r"\S+\s*|\s+"
    ranks = bpe.load_ranks(P.path(bpe.DEFAULT_RANKS))
    own, library = bpe.Bpe(ranks, pattern), tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for text in ("the cat, and  the\ndog .", "a b c " * 50):
        assert own.encode(text) == library.encode_ordinary(text)
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for text in ("The cat, and  the\ndog .", "a b c"):
        assert np.frombuffer(token_output._encoder(path)(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_language(spark):
    rng = random.Random(2)
    en, de = ["the", "of", "and", "with", "thing"], ["der", "und", "nicht", "schön", "für"]
    pairs = [(i, " ".join(rng.choice(en if i % 2 else de) for _ in range(20))) for i in range(200)]
    df = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in pairs] + [(900, None, "en"), (901, "123 !!", "en"), (902, "привет", None), (None, "the thing", None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in langid.languages(df).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") and got[i].score > 0.9 for i, _ in pairs)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[None].lang_pred == "en"
    assert all(r.held_out == (zlib.crc32(str(i or "" if i is None else i).encode()) % 5 == 0) for i, r in got.items())
    assert (got[902].lang_pred, got[902].score) == ("de", 0.0)  # a script that nothing was trained on
    assert [tuple(x) for x in got[1].spans] == [("en", 0, 20)] and got[901].spans == []
    model = langid.train(df)
    assert [s[0] for s in langid.spans(model, "the thing of and with the thing of der und nicht schön für der und")] == ["en", "de"]


def test_language_labels_are_the_best_of_all(spark):
    """Against the score of every labelling; very long texts, ties, repeated rows and clashing columns besides."""
    import itertools

    rng = np.random.default_rng(3)
    for _ in range(40):
        steps, langs = int(rng.integers(1, 7)), int(rng.integers(1, 4))
        scores = rng.normal(0, 3, (steps, langs, 1)).astype(np.float32)
        value = lambda x: sum(float(scores[t, k, 0]) for t, k in enumerate(x)) - 2.5 * sum(a != b for a, b in zip(x, x[1:]))
        best = max(map(value, itertools.product(range(langs), repeat=steps)))
        assert abs(value(langid.viterbi(scores, 2.5)[:, 0].tolist()) - best) < 1e-5
    one = np.zeros((4, 3, 1), np.float32)
    assert langid.viterbi(one)[:, 0].tolist() == [0, 0, 0, 0]  # ties go to the first language
    words = {"en": ["the", "of", "with"], "de": ["der", "und", "nicht"]}
    pick = random.Random(1)
    train = [(i, " ".join(pick.choice(words[x]) for _ in range(9)), x) for i in range(200) for x in [("de", "en")[i % 2]]]
    long = "the of with " * 40_000
    more = [(500, long, None), (501, "the der the der " * 3, None), (501, "the der the der " * 3, None), (None, long + "der und nicht " * 50_000, "en")]
    df = spark.createDataFrame([(*r, "x", 0.5, True) for r in train + more], "doc_id bigint, text string, lang string, lang_pred string, score double, held_out boolean")
    found = langid.languages(df).filter("doc_id >= 500 or doc_id is null").collect()
    got = Counter((r.doc_id, r.lang_pred, r.score > 0.99, len(r.spans)) for r in found)
    assert got[500, "en", True, 1] == 1 and got[None, "de", False, 2] == 1 and sum(n for k, n in got.items() if k[0] == 501) == 2 and len(got) == 3
    model = langid.train(df)
    letters = ["the", "nicht", "öffnen", "мир"]
    alone = [model.words([x]) for x in letters]
    scores, known = model.words(letters)  # words scored together get what each gets alone
    assert known.tolist() == [True, True, True, False] and all((scores[i] == a[0]).all() for i, (a, _) in enumerate(alone))


def test_held_out_accuracy(spark):
    """Of language identification, and of toxicity fitted on half of the labels."""
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    known = docs.select("doc_id", "lang").filter("lang is not null and text is not null")
    right = langid.languages(docs).filter("held_out and lang_pred <> 'und'").join(known, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert right[0] > 0.97 and right[1] > 100
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    half = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2)) == 0
    fresh = toxicity.severity(docs, marks.filter(half)).join(marks.filter(~half), "doc_id").select("rejected", "toxic").collect()
    toxic, clean = ([r.rejected for r in fresh if r.toxic == x] for x in (1, 0))
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.02 and len(toxic) >= 10


def test_pii(docs):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, s):
        digits = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]

    want = lambda t: [(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, t) if good(k, m[0])]
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice("a.b@-+ 1234.5()%_4539578763621486é\n") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == want(text)
    for r in pii.personal_data(docs).filter("doc_id in (85, 86, 90, 91)").collect():
        spans = want(dict(rows())[r.doc_id] or "")
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans)) and r.n_email == sum(k == "email" for k, _, _ in spans)
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r.spans.split(",")) | {""}


def test_pii_model_learns_and_reconciles():
    rng = np.random.default_rng(7)
    model = pii.BiLstmCrf(rng)
    made = [(pii.encode(x), pii.tags_of(0, len(x), s)) for x, s in pii.generated(rng, 800)]
    model.fit(made, rng, steps=150)
    fresh = pii.generated(np.random.default_rng(8), 200)
    tags, _ = model.decode(pii.pad([pii.encode(x) for x, _ in fresh]))
    right = [(tags[i, : len(x)] == pii.tags_of(0, len(x), s)).mean() for i, (x, s) in enumerate(fresh)]
    assert np.mean(right) > 0.85
    spans = [("phone", 0, 9, 0.95), ("ip", 5, 12, 0.99), ("phone", 12, 20, 0.95), ("card", 30, 40, 0.9)]
    assert pii.reconciled([("email", 33, 50)], spans) == [("email", 33, 50), ("ip", 5, 12), ("phone", 12, 20)]


def test_pii_model_reads_spelled_out_addresses_without_digits():
    assert pii.windows_of("nothing to see here") == []
    for value in ("jane at example dot com", "jane[at]example.com", "jo dot doe at mail dot some dot example dot com", f"jo.12 at {'long' * 20}.example.com"):
        text = f"{'please write to ' * 9}{value} {'if you can ' * 9}"
        at = text.index(value)
        covered = {x for a, b in pii.windows_of(text) for x in range(a, b)}
        assert covered >= set(range(at - 1, at + len(value) + 1))
    rng = np.random.default_rng(7)
    model = pii.BiLstmCrf(rng)
    model.fit([(pii.encode(x), pii.tags_of(0, len(x), s)) for x, s in pii.generated(rng, 2000)], rng)
    names, hosts = ("anna", "bob", "celia", "dora", "emil"), ("example", "garden", "loom", "brica", "halde")
    values = [v for n in names for h in hosts for v in (f"{n} at {h} dot com", f"{n}[at]{h}.org")]
    texts = [f"leb gan mori {v} fal denu mi" for v in values]
    found = pii.model_spans(model, texts)
    assert sum(("email", 13, 13 + len(v)) in {x[:3] for x in got} for v, got in zip(values, found)) > 0.6 * len(values)


def test_pii_spans_longer_than_a_window_survive():
    class Stub:
        """Labels all that isn't a 7 as an e-mail address."""

        def decode(self, chars):
            tags = np.where((chars > 0) & (chars != ord("7") - 30), 2, 0)
            tags[:, 1:][(tags[:, 1:] > 0) & (tags[:, :-1] == 0)] = 1
            return tags, np.ones(chars.shape)

    for value in ("name.12 at mail3 dot example dot com", f"name.12 at {'mail' * 30} dot example dot com"):
        for before in range(100, 170):
            text = "7" * before + value + "7" * 120
            assert pii.model_spans(Stub(), ["", text])[1] == [("email", before, before + len(value), 1.0)]
    lone = f"{'7' * 9}{'é漢' * 100} at {'漢é' * 100}.com7"
    assert pii.model_spans(Stub(), [lone])[0] == [("email", 9, len(lone) - 1, 1.0)]


def test_toxicity(spark):
    rng = random.Random(3)
    pairs = [(i, " ".join(rng.choice(WORDS) for _ in range(60)) + (" nastyword foulterm" if i % 5 == 0 else "")) for i in range(400)]
    lab = labels(spark, [(i, 0 if i % 10 == 0 else 1, int(i % 5 == 0)) for i in range(300)] + [(9999, 1, 1)])
    docs = table(spark, [*pairs, (1000, None), (1001, ""), (None, "nastyword foulterm " * 3)])
    got = {r.doc_id: r for r in toxicity.severity(docs, lab).collect()}
    assert all(got[i].rejected == (i % 5 == 0) and 0 <= got[i].severity <= 2 for i, _ in pairs)
    assert not got[1000].rejected and got[1000].severity == got[1001].severity and got[None].rejected
    kept = toxicity.drop_toxic(docs, lab)
    assert kept.columns == docs.columns and kept.count() == 320 + 2 and extras(kept)
    assert toxicity.severity(docs, labels(spark, [])).filter("rejected").count() == 0


def test_lm(spark):
    pairs = rows(5)
    got = sorted((tuple(r) for r in lm.katz_scores(table(spark, pairs), chunk=500).collect()), key=str)
    docs = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, [*(t or "").encode().lower().split(), b" end"]) for i, t in pairs]
    uni, bi, starts = Counter(), Counter(), 0
    for _, out, words in docs:
        if not out:
            uni.update(words)
            bi.update(zip([None, *words[:-1]], words))
            starts += 1
    total, distinct = sum(uni.values()), len(uni)
    model, d = lm.Unigrams(total, distinct, Counter(uni.values())), lm.discounts(Counter(bi.values()), 1)
    p1 = lambda w: float(model.array(np.array([uni[w]]))[0])
    seen = dict(bi)
    mass, words_of = defaultdict(float), defaultdict(float)
    for (h, w), n in seen.items():
        mass[h] += d.get(n, 1.0) * n
        words_of[h] += p1(w)
    times = lambda h: max(starts if h is None else uni[h], mass[h] + lm.HALF)
    alpha = lambda h: (1 - mass[h] / times(h)) / (1 - words_of[h]) if h in mass else 1.0
    p2 = lambda h, w: d.get(seen[h, w], 1.0) * seen[h, w] / times(h) if (h, w) in seen else alpha(h) * p1(w)
    for h in [None, *list(uni)[:20]]:
        if h in mass:
            assert abs(sum(p2(h, w) for w in uni) + alpha(h) * model.unknown - 1) < 1e-9
    want = []
    for i, out, words in docs:
        score = sum(math.log10(p2(h, w)) for h, w in zip([None, *words[:-1]], words))
        base = sum(math.log10((uni[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        want.append((i, out, len(words), sum(uni[w] > 0 for w in words), total, base, score))
    want.sort(key=str)
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 and abs(a[6] - b[6]) < 1e-6


def test_lm_keeps_bigrams_seen_once(spark):
    """Against an uncut model, whatever the operator's constants are; many chunks, so that counts differ from the corpus counts."""
    rng = random.Random(6)
    pairs = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randint(1, 30)))) for i in range(200)]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    docs = {i: [*t.encode().split(), b" end"] for i, t in pairs}
    uni, bi = Counter(), Counter()
    for i, words in docs.items():
        if not held(i):
            uni.update(words)
            bi.update(zip([None, *words[:-1]], words))
    counts, starts = Counter(bi.values()), sum(not held(i) for i in docs)
    d = {r: x for r in range(1, 6) if 0 < (x := (r + 1) * counts[r + 1] / (r * counts[r])) < 1}
    assert 1 in d and counts[1] > len(bi) / 2
    model = lm.Unigrams(sum(uni.values()), len(uni), Counter(uni.values()))
    p1 = lambda w: float(model.array(np.array([uni[w]]))[0])
    after = defaultdict(list)
    for (h, w), n in bi.items():
        after[h].append((w, d.get(n, 1.0) * n))

    def p2(h, w):
        if h not in after:
            return p1(w)
        mass = sum(m for _, m in after[h])
        times = max(starts if h is None else uni[h], mass + 0.5)
        if (h, w) in bi:
            return dict(after[h])[w] / times
        return (1 - mass / times) / (1 - sum(p1(x) for x, _ in after[h])) * p1(w)

    got = {r.doc_id: r.score for r in lm.katz_scores(table(spark, pairs), chunk=150).collect()}
    assert set(got) == set(docs)
    for i, words in docs.items():
        assert abs(got[i] - sum(math.log10(p2(h, w)) for h, w in zip([None, *words[:-1]], words))) < 1e-6


def test_decontamination(spark):
    rng = random.Random(9)
    text = lambda n: " ".join("w" + str(rng.randint(0, 5000)) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([3, 15, 15, 40, 60])] + [(5, None), (6, ""), (None, text(20))]
    pairs = [(i, text(80)) for i in range(20)]
    for k, (_, item) in enumerate(items):
        if item:
            pairs.append((100 + k, f"{text(30)} {item.upper()} {text(30)}"))
    changed = items[4][1].split()
    changed[30] = "changed"
    pairs += [(200, f"{text(9)} {' '.join(changed)} {text(9)}"), (201, items[3][1]), (202, None), (203, ""), (None, items[3][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = table(spark, pairs)
    got = {(r.doc_id, r.item_id) for r in decontam.contamination(docs, bench).collect()}
    assert got == {(100, 0), (101, 1), (102, 2), (103, 3), (104, 4), (107, None), (200, 4), (201, 3), (None, 3)}
    clean = decontam.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {*range(20), 202, 203} and extras(clean)
    # rows that share an id go by their own texts
    twice = table(spark, [(1, items[3][1]), (1, "a clean text of the same id"), (1, "a clean text of the same id")])
    assert decontam.drop_contaminated(twice, bench).count() == 2


def test_decontamination_against_all_windows(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, text(n)) for i, n in enumerate([3, 4, 12, 12, 25, 40, 40, 60])]
    items += [(20, items[4][1]), (21, list(items[5][1])), (21, items[6][1])]  # equal items, and an id that repeats
    pairs = [(i, text(rng.randint(1, 200))) for i in range(40)]
    for k in range(120):
        item = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 3)):
            item[rng.randrange(len(item))] = rng.choice(words)
        pairs.append((100 + k % 110, text(rng.randint(0, 40)) + item * rng.choice([1, 1, 2]) + text(rng.randint(0, 40))))
    pairs += [(300, text(20_000) + items[7][1]), (301, [])]

    def shingles(x):
        return Counter(tuple(x[i : i + 5]) for i in range(len(x) - 4)) if len(x) >= 5 else Counter([tuple(x)])

    want = {}
    for d, x in pairs:
        for k, item in items:
            own = shingles(item)
            known = set(own)
            for at in range(max(1, len(x) - len(item) + 1)):
                window = x[at : at + len(item)]
                if len(x) > 1000 and not known & set(shingles(window)):
                    continue
                if not window or (len(window) < len(item) and min(len(window), 5) != min(len(item), 5)):
                    continue
                w = shingles(window)
                value = sum((w & own).values()) / sum((w | own).values())
                if value >= 0.8 and (d, k) not in want or value >= 0.8 and (-value, at) < (-want[d, k][0], want[d, k][1]):
                    want[d, k] = (value, at, at + len(window))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in items], "item_id bigint, text string")
    docs = table(spark, [(d, " ".join(x)) for d, x in pairs])
    for block in (20_000, 3):
        monkeypatch.setattr(decontam, "ITEMS", block)
        got = {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.end_word) for r in decontam.contamination(docs, bench).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k][0] - want[k][0]) < 1e-12 for k in want)
        assert sum(got[k][1:] == want[k][1:] for k in want) == len(want)


def test_multi_index_misses_nothing():
    rng = np.random.default_rng(1)
    sized = decontam._Sized(20, [(i, rng.integers(0, 2**63, 16, dtype=np.uint64)) for i in range(50)])
    prints = rng.integers(0, 2**63, 300, dtype=np.uint64)
    prints[:50] = sized.prints ^ np.uint64(0b1011 << 20)
    near = {(a, b) for a in range(300) for b in range(50) if int(prints[a] ^ sized.prints[b]).bit_count() <= decontam.RADIUS}
    at, item = sized.candidates(prints)
    assert set(zip(at.tolist(), item.tolist())) == near


def test_pii_added_spans_on_held_out_lines(spark):
    """Precision and recall of the spans that the model adds to the base spans, on generated lines that training didn't see."""
    rng = np.random.default_rng(7)
    model = pii.BiLstmCrf(rng)
    model.fit([(pii.encode(x), pii.tags_of(0, len(x), s)) for x, s in pii.generated(rng, 2000)], rng)
    lines = pii.generated(np.random.default_rng(99), 1500)
    found = pii.model_spans(model, [x for x, _ in lines])
    right = wrong = missed = 0
    for (text, want), extra in zip(lines, found):
        base = pii.base_spans(text)
        added = set(pii.reconciled(base, extra)) - set(base)
        want = [x for x in want if pii._plausible(x[0], text[x[1] : x[2]])]  # not the card numbers that fail Luhn
        more = set(want) - set(base) if not any(b[1] < w[2] and w[1] < b[2] for w in want for b in base) else set()
        right += len(added & more)
        wrong += len(added - more)
        missed += len(more - added)
    print(f"added spans: precision {right / (right + wrong):.3f}, recall {right / (right + missed):.3f}, of {right + missed}")
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.9 and right + missed > 200


def test_pii_windows_miss_no_span_of_whole_texts():
    """A span that may be reported holds a trigger: reading around triggers finds what reading everything finds, with a model that needs little context."""
    class Stub:
        def decode(self, chars):  # runs of what isn't a comma, as phone numbers
            tags = np.where((chars > 0) & (chars != ord(",") - 30), 8, 0)
            tags[:, 1:][(tags[:, 1:] > 0) & (tags[:, :-1] == 0)] = 7
            return tags, np.ones(chars.shape)

    rng = random.Random(8)
    for _ in range(60):
        parts = ["".join(rng.choice("abc 12345678") for _ in range(rng.randint(1, 90))) for _ in range(40)]
        text, want, at = ",".join(parts), set(), 0
        for x in parts:
            if 7 <= sum(c.isdigit() for c in x) <= 15:
                want.add(("phone", at, at + len(x)))
            at += len(x) + 1
        got = {(k, a, b) for k, a, b, _ in pii.model_spans(Stub(), [text])[0] if text[a:b].strip(",") == text[a:b] and (a == 0 or text[a - 1] == ",") and (b == len(text) or text[b] == ",")}
        assert got == want


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, kept, sf)
        assert out.columns == docs.columns, name
        assert out.count() <= kept.count()
        kept = out
    by_hand = {r.doc_id: r.text for r in kept.collect()}
    assert {r.doc_id: r.decoded for r in cp.run(spark, sf).collect()} == by_hand and 0 < len(by_hand) < docs.count()


def test_pipeline_against_brute_force(spark, monkeypatch, tmp_path):
    """Every stage done again in plain Python over a small table: line counts, all pairs, all windows, the library's ids."""
    import public_tokenizers as P
    import tiktoken

    import corpus_pipeline as cp

    rng = random.Random(12)
    vocabulary = ["w" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(600)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(30)) for i in range(4)]
    pairs = [(i, f"{text(40)}\n{'Common line' if i % 3 == 0 else 'rare ' + str(i)}\n{text(10)}") for i in range(60)]
    pairs += [(100 + i, pairs[i][1].replace(" ", " waa ", 1)) for i in range(15)] + [(200 + i, f"{text(20)} {items[i % 4][1]} {text(9)}") for i in range(8)]
    pairs += [(300 + i, f"{text(30)} nastyword foulterm {text(5)}") for i in range(20)] + [(400, None), (401, ""), (402, "a b"), (None, pairs[3][1]), (7, pairs[7][1])]
    marks = [(i, 1, 0) for i in range(60)] + [(300 + i, i % 2, 1) for i in range(15)]
    sf = str(tmp_path)
    for name, rows_, schema in (("documents", [(i, t, "en", "s", 0) for i, t in pairs], "doc_id bigint, text string, lang string, source string, n_chars bigint"), ("labels", marks, "doc_id bigint, quality int, toxic int"), ("benchmark", items, "item_id bigint, text string")):
        spark.createDataFrame(rows_, schema).write.parquet(f"{sf}/{name}.parquet")

    model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))

    def severity(t):  # the model's sum over a text's features, one by one
        counts = Counter(f for w in set(re.findall(r"[^\W\d_]+", (t or "").lower())) for f in toxicity._features(w))
        z = sum(n**0.5 * float(model.weights[f]) for f, n in counts.items())
        return sum(1 / (1 + math.exp(k - z)) for k in model.thresholds)

    kept = [(i, t) for i, t in pairs if severity(t) < toxicity.REJECT]
    assert 60 <= len(kept) < len(pairs)
    key = lambda x: x.strip(" \t\n\x0b\f\r").lower()
    df = Counter(k for _, t in kept for k in {key(x) for x in (t or "").split("\n")} if k)
    clean = lambda t: t if t is None else "\n".join(x for x in t.split("\n") if df[key(x)] < 10)
    kept = [(i, clean(t)) for i, t in kept]
    shingle = lambda x: {tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} if x else set()
    sets = [shingle((t or "").lower().split()) for _, t in kept]
    group = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    best = {}
    for n, (i, _) in enumerate(kept):
        if not sets[n] or group[n] not in best or (i is not None and (kept[best[group[n]]][0] is None or i < kept[best[group[n]]][0])):
            best[group[n] if sets[n] else -n - 1] = n
    kept = [kept[n] for n in sorted(best.values())]

    def holds(t):
        x = (t or "").lower().split()
        return any(len(shingle(x[at : at + 30]) & shingle(item.split())) >= 0.8 * len(shingle(x[at : at + 30]) | shingle(item.split())) for _, item in items for at in range(max(1, len(x) - 29)))

    kept = [(i, t) for i, t in kept if not holds(t)]
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path(bpe.DEFAULT_RANKS)), special_tokens={})
    want = Counter((i, t, tuple(library.encode_ordinary(t or "")), t or "") for i, t in kept)
    assert Counter((r.doc_id, r.text, tuple(r.token_ids), r.decoded) for r in cp.run(spark, sf).collect()) == want


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    for name, schema in (("documents", "doc_id bigint, text string, lang string, source string, n_chars bigint"), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
