"""Scoring texts with a Katz backoff bigram model trained on the corpus itself.

Texts are cut into words, plus one end token each. The tables, all partitioned and none collected:

* chunks: up to ``CHUNK`` tokens of whole documents in a row, as numbers into the chunk's own sorted vocabulary;
* words: id and training count of every word (Good-Turing discounts for counts up to ``TOP``; what they free
  is the probability of an unknown word);
* pairs: the distinct bigrams of the training texts with their counts over the whole corpus. Each chunk deals its distinct bigrams by a hash to
  buckets of about ``BUCKET`` tokens and packs each bucket's share into one row, so that one exchange of packed rows brings a bigram's counts together; a
  bucket packs its totals, and for each chunk the totals that aren't the chunk's own counts (a chunk takes its own count where it isn't told another).
  Good-Turing discounts them from a count of 1 on;
* backoff: for each history its count and alpha, where alpha = (1 - sum of its seen bigrams' probabilities) / (1 - sum of their words' unigram
  probabilities); so each history's probabilities add up to 1 exactly.

A token's probability is its bigram's, if seen, else alpha(history) times its unigram probability; a history never seen
backs off with alpha 1. Chunks ask for their distinct words and bigrams only, and the answers return
to the chunk, so that no row is made for each token. Words are told apart by 64-bit hashes; more than 2**31 distinct words raise an error.

Defined cases: a null or empty text is the end token alone. A null doc_id is hashed as an empty string, and so
is held out. Rows are documents, also where they repeat a doc_id. Without training rows every word is unknown, with
probability 1; base_score then takes N = V = 0. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.llm.common import Workspace, plain
from tallyloom.llm.words import hashing, mix, texts, word_hashes, words_of

CHUNK, CHUNK_DOCS = 1_500_000, 20_000
BUCKET = 1_000_000
TOP = 5
#: A history's discounts free this part of a count at least, else its denominator grows until they do.
HALF = 0.5
_END = word_hashes([b" end"])[0]
_CHUNKS = "chunk bigint, doc_ids array<bigint>, held array<boolean>, lengths binary, tokens binary, vocab array<bigint>, counts array<bigint>"
_MASK = (1 << 33) - 1


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _planes(*columns: np.ndarray) -> bytes:
    """Columns of 32-bit numbers as planes of bytes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes() for x in columns))


def _from_planes(held: bytes, n: int) -> list[np.ndarray]:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(held), np.uint8).reshape(n, 4, -1)
    return [np.ascontiguousarray(x.T).view("<u4").ravel() for x in planes]


def _chunked(batches: Iterator[pa.RecordBatch], limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    task, made = context.partitionId() if context else 0, 0
    ids, held, parts, size = [], [], [], 0
    hashing()

    def flush() -> pa.RecordBatch:
        nonlocal ids, held, parts, size, made
        vocab, tokens = np.unique(np.concatenate(parts), return_inverse=True)
        lengths = np.array([len(x) for x in parts], dtype=np.int64)
        train = np.repeat(~np.array(held), lengths)
        order = np.argsort(-np.bincount(tokens, minlength=len(vocab)), kind="stable")  # small numbers for frequent words
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        vocab, tokens = vocab[order], place[tokens]
        counts = np.bincount(tokens[train], minlength=len(vocab))
        row = [[(task << 32) + made], [ids], [held], [lengths.tobytes()], [_planes(tokens.astype("<u4"))], pa.array([vocab.view(np.int64)]), pa.array([counts])]
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        ids, held, parts, size, made = [], [], [], 0, made + 1
        return pa.RecordBatch.from_arrays([pa.array(x, k) if isinstance(x, list) else x.cast(k) for x, k in zip(row, kinds)], names=["chunk", "doc_ids", "held", "lengths", "tokens", "vocab", "counts"])

    for batch in batches:
        for doc, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
            ids.append(doc)
            held.append(out)
            parts.append(np.append(word_hashes(words_of(text)), _END))
            size += len(parts[-1])
            if size >= limit or len(ids) >= CHUNK_DOCS:
                yield flush()
    if parts:
        yield flush()


def _row(table: pa.Table | pa.RecordBatch, i: int = 0) -> dict:
    """A chunk's row; its lists of numbers as arrays."""
    out = {}
    for name in table.schema.names:
        value = table.column(name)[i]
        out[name] = value.values.to_numpy(zero_copy_only=False) if pa.types.is_list(value.type) and name != "doc_ids" else value.as_py()
    return out


def _tokens(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Local word numbers, lengths of the documents, and the flags of their first tokens."""
    tokens, lengths = _from_planes(row["tokens"], 1)[0].astype(np.int64), np.frombuffer(row["lengths"], np.int64)
    first = np.zeros(len(tokens), dtype=bool)
    first[np.cumsum(lengths) - lengths] = True
    return tokens, lengths, first


def _keys(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each token's bigram key (-1 with an unknown history), its history's id (0 at a start, -1 unknown), local numbers, lengths, first."""
    tokens, lengths, first = _tokens(row)
    ids = np.asarray(row["ids"], dtype=np.int64)
    word = ids[tokens]  # 0: unknown
    history = np.concatenate([[0], word[:-1]])
    history = np.where(history == 0, -1, history)
    history[first] = 0
    return np.where(history >= 0, (history << 32) | word, -1), history, tokens, lengths, first


def _with_ids(left: pa.Table, right: pa.Table) -> pa.Table:
    """A chunk with its words' ids and corpus counts."""
    n = left["n_words"][0].as_py()
    ids, counts = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = right["pos"].to_numpy()
    ids[at], counts[at] = right["id"].to_numpy(), right["c"].to_numpy()
    return left.select(["chunk", "doc_ids", "held", "lengths", "tokens"]).append_column("ids", pa.array([ids])).append_column("counts", pa.array([counts]))


def _own_pairs(row: dict, keys: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's distinct bigrams of known histories and words, sorted, and their counts in its training documents."""
    train = np.repeat(~np.array(row["held"], dtype=bool), lengths)
    good = (keys >= 0) & ((keys & 0xFFFFFFFF) > 0)
    found, inverse = np.unique(keys[good], return_inverse=True)
    return found, np.bincount(inverse, weights=train[good], minlength=len(found)).astype(np.int64)


def _packed(keys: np.ndarray, *counts: np.ndarray) -> bytes:
    """Sorted bigram keys and columns of counts: steps of the histories, words, and each count's lower and upper half."""
    halves = [h.astype("<u4") for c in counts for h in (c & 0xFFFFFFFF, c >> 32)]
    return _planes(np.diff(keys >> 32, prepend=0).astype("<u4"), (keys & 0xFFFFFFFF).astype("<u4"), *halves)


def _unpacked(held: bytes, counts: int = 1) -> list[np.ndarray]:
    """The keys and their columns of counts."""
    history, word, *halves = (x.astype(np.int64) for x in _from_planes(held, 2 + 2 * counts))
    return [(np.cumsum(history) << 32) | word, *((high << 32) | low for low, high in zip(halves[::2], halves[1::2]))]


def _dealt(buckets: int):
    """(bucket, chunk, packed): a chunk's distinct bigrams by bucket, with their count in its training documents and their word's in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = _row(batch, i)
                keys, _, _, lengths, _ = _keys(row)
                found, counts = _own_pairs(row, keys, lengths)
                ids = np.asarray(row["ids"], dtype=np.int64)
                order = np.argsort(ids)
                of_word = np.asarray(row["counts"], dtype=np.int64)[order][np.searchsorted(ids[order], found & 0xFFFFFFFF)]
                with np.errstate(over="ignore"):
                    bucket = (mix(found.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")  # keys stay sorted within a bucket
                found, counts, of_word, bucket = found[order], counts[order], of_word[order], bucket[order]
                cuts = np.r_[np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)]
                for at in range(0, len(cuts) - 1, 256):
                    ends = list(zip(cuts[at:-1], cuts[at + 1 :]))[:256]
                    packed = [_packed(found[a:b], counts[a:b], of_word[a:b]) for a, b in ends]
                    yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a, _ in ends], pa.int64()), pa.array([row["chunk"]] * len(ends), pa.int64()), pa.array(packed, pa.binary())], names=["bucket", "chunk", "packed"])

    return run


def _totals(group: pa.Table) -> pa.Table:
    """A bucket's bigrams over all chunks: packed totals and word counts, with counts of counts, and for each chunk the totals that it is told."""
    chunks = group["chunk"].to_pylist()
    parts = [_unpacked(x.as_py(), 2) for x in group["packed"]]
    keys, n, c = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.diff(keys[order], prepend=-1))
    every, total, c = keys[order][starts], np.add.reduceat(n[order], starts), c[order][starts]
    seen = total > 0  # the others occur in held-out documents alone
    rows = [(False, None, _packed(every[seen], total[seen], c[seen]), *np.bincount(np.minimum(total, TOP + 2), minlength=TOP + 3)[1 : TOP + 2].tolist())]
    for chunk, (own, m, _) in zip(chunks, parts):
        all_n = total[np.searchsorted(every, own)]
        if (told := all_n != m).any():
            rows.append((True, chunk, _packed(own[told], all_n[told]), *[None] * (TOP + 1)))
    columns = list(zip(*rows))
    names = ["told", "chunk", "packed", *(f"n{r}" for r in range(1, TOP + 2))]
    kinds = {"told": pa.bool_(), "packed": pa.binary()}
    return pa.table([pa.array(x, kinds.get(k, pa.int64())) for k, x in zip(names, columns)], names=names)


_TOTALS = "told boolean, chunk bigint, packed binary, " + ", ".join(f"n{r} bigint" for r in range(1, TOP + 2))


def _masses(unigrams: Unigrams, d_pairs: dict[int, float]):
    """(h, mass, p): for each history of a bucket the sums of its bigrams' discounted counts and of their words' probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                keys, total, c = _unpacked(packed.as_py(), 2)
                if len(keys):
                    starts = np.flatnonzero(np.diff(keys >> 32, prepend=-1))
                    mass, p = _table(d_pairs)[np.minimum(total, TOP + 1)] * total, unigrams.array(c)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[starts] >> 32), pa.array(np.add.reduceat(mass, starts)), pa.array(np.add.reduceat(p, starts))], names=["h", "mass", "p"])

    return run


def _table(d: dict[int, float]) -> np.ndarray:
    """Discounts by count, TOP + 1 for all above."""
    return np.array([1.0, *(d.get(r, 1.0) for r in range(1, TOP + 2))])


def discounts(count_of: dict[int, int], low: int, top: int = TOP) -> dict[int, float]:
    """Good-Turing: r -> d with discounted count d * r, for low <= r <= top; 1 where counts of counts allow none."""
    out = {}
    for r in range(low, top + 1):
        now, above = count_of.get(r, 0), count_of.get(r + 1, 0)
        d = (r + 1) * above / (r * now) if now else 1.0
        out[r] = d if 0 < d < 1 else 1.0
    return out


class Unigrams:
    """Discounted unigram probabilities; the unknown word gets what the discounts free."""

    def __init__(self, total: int, distinct: int, count_of: dict[int, int]):
        self.total, self.distinct, self.d = total, distinct, discounts(count_of, 1)
        freed = sum((1 - d) * r * count_of.get(r, 0) for r, d in self.d.items())
        if total and freed <= 0:  # no counts to go by: the unknown word takes half a count
            self.scale, freed = (total - 0.5) / total, 0.5
        else:
            self.scale = 1.0
        self.unknown = freed / total if total else 1.0

    def array(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.scale * _table(self.d)[np.minimum(c, TOP + 1)] * c / max(1, self.total), self.unknown)


def _scorer(unigrams: Unigrams, d_pairs: dict[int, float]):
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = _row(left)
        keys, history, tokens, lengths, _ = _keys(row)
        counts = np.asarray(row["counts"], dtype=np.int64)
        asked = right.filter(pa.compute.is_valid(right["h"]))
        h_key = asked["h"].to_numpy()
        order = np.argsort(h_key)
        h_key, h_alpha, h_times = h_key[order], asked["alpha"].to_numpy()[order], asked["times"].cast(pa.float64()).to_numpy()[order]
        packed = [_unpacked(k) for k in right["packed"].to_pylist() if k is not None]
        p_key, p_count = _own_pairs(row, keys, lengths)
        for told, n in packed:
            p_count[np.searchsorted(p_key, told)] = n
        c = counts[tokens]
        uni = np.log10(unigrams.array(counts))[tokens]
        alpha, times = np.zeros(len(tokens)), np.ones(len(tokens))
        if len(h_key):
            at = np.minimum(np.searchsorted(h_key, history), len(h_key) - 1)
            hit = (history >= 0) & (h_key[at] == history)
            alpha[hit], times[hit] = h_alpha[at[hit]], h_times[at[hit]]
            times = np.where(np.isnan(times), np.concatenate([[0], c[:-1]]), times)
        logp = alpha + uni
        if len(p_key):
            at = np.minimum(np.searchsorted(p_key, keys), len(p_key) - 1)
            hit = (keys >= 0) & (p_key[at] == keys) & (p_count[at] > 0)
            n = p_count[at[hit]]
            logp[hit] = np.log10(_table(d_pairs)[np.minimum(n, TOP + 1)] * n / times[hit])
        ends = np.cumsum(lengths) - lengths
        base = np.log10((counts + 0.1) / (unigrams.total + 0.1 * (unigrams.distinct + 1)))[tokens]
        total = len(lengths)
        return pa.table({
            "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(lengths), "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), ends)),
            "train_tokens": pa.array(np.full(total, unigrams.total, np.int64)), "base_score": pa.array(np.add.reduceat(base, ends)), "score": pa.array(np.add.reduceat(logp, ends)),
        })

    return score


def katz_scores(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of ``docs`` (doc_id, text)."""
    work = Workspace(docs.sparkSession, "lm")
    rows = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")).alias("held"), "text")
    chunks = work.write(rows.mapInArrow(lambda batches: _chunked(batches, chunk), _CHUNKS), "chunks")

    # words: hash, id from 1 on, training count
    named = chunks.select(F.explode(F.arrays_zip("vocab", "counts")).alias("x")).select(F.col("x.vocab").alias("w"), F.col("x.counts").alias("c")).filter("c > 0")
    named = work.write(named.groupBy("w").agg(F.sum("c").alias("c")).withColumn("place", F.monotonically_increasing_id()), "named")
    sizes = sorted((r["part"], r["n"]) for r in named.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition
    offsets, before = [], 1
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    if before >= 1 << 31:
        raise ValueError("more than 2**31 distinct words")
    offset = F.broadcast(docs.sparkSession.createDataFrame(offsets or [(0, 1)], "part bigint, offset bigint"))
    words = named.withColumn("part", F.shiftright("place", 33)).join(offset, "part").select("w", (F.col("offset") + F.col("place").bitwiseAND(F.lit(_MASK))).alias("id"), "c")
    stats = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), *[F.count_if(F.col("c") == r) for r in range(1, TOP + 2)]).first()
    unigrams = Unigrams(stats[0], stats[1], dict(enumerate(stats[2:], 1)))
    starts = chunks.agg(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0

    # every chunk learns its words' ids and counts
    asked = chunks.select("chunk", F.posexplode("vocab").alias("pos", "w"))
    told = asked.join(words, "w").select(F.col("chunk").alias("of"), "pos", "id", "c")
    lean = chunks.withColumn("n_words", F.size("vocab")).drop("vocab", "counts")
    known = lean.groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(_with_ids, "chunk bigint, doc_ids array<bigint>, held array<boolean>, lengths binary, tokens binary, ids array<bigint>, counts array<bigint>")
    known = work.write(known, "known")
    work.drop("chunks")

    # pairs: one exchange of packed bigrams gives the corpus counts and the answers for each chunk
    dealt = known.mapInArrow(_dealt(max(1, -(-stats[0] // min(BUCKET, chunk)))), "bucket bigint, chunk bigint, packed binary")
    pairs = work.write(dealt.groupBy("bucket").applyInArrow(_totals, _TOTALS), "pairs", ["told"])
    count_of = pairs.agg(*[F.coalesce(F.sum(f"n{r}"), F.lit(0)) for r in range(1, TOP + 2)]).first()
    d_pairs = discounts(dict(enumerate(count_of, 1)), 1)

    # backoff weights
    own = pairs.filter("not told").select("packed").mapInArrow(_masses(unigrams, d_pairs), "h bigint, mass double, p double")
    sums = own.groupBy("h").agg(F.sum("mass").alias("mass"), F.sum("p").alias("p"))
    histories = words.select(F.col("id").alias("h"), F.col("c").alias("times")).unionByName(docs.sparkSession.createDataFrame([(0, starts)], "h bigint, times bigint"))
    times = F.greatest(F.col("times").cast("double"), F.col("mass") + HALF)
    alpha = F.log10((1 - F.col("mass") / times) / F.greatest(1 - F.col("p"), F.lit(1e-12)))
    # a chunk knows its words' counts: a history's denominator is told only where it is another number
    backoff = work.write(sums.join(histories, "h").select("h", alpha.alias("alpha"), F.when((F.col("h") == 0) | (times != F.col("times")), times).alias("times")), "backoff")
    work.drop("named")
    work.drop("pairs/told=false")

    asked = known.select("chunk", F.explode("ids").alias("h")).filter("h > 0").unionByName(known.select("chunk", F.lit(0).cast("bigint").alias("h")))
    weights = asked.join(backoff, "h").select(F.col("chunk").alias("of"), "h", "alpha", "times", F.lit(None).cast("binary").alias("packed"))
    counts = pairs.filter("told").select(F.col("chunk").alias("of"), "packed")
    answers = weights.unionByName(counts, allowMissingColumns=True)
    return known.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(_scorer(unigrams, d_pairs), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
