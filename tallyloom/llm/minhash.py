"""MinHash near-dedup on HyperMinHash registers.

A document's set has its distinct 5-word shingles. Each shingle falls into one of ``REGISTERS`` buckets, and a bucket
keeps its smallest hash as a leading-zero count and mantissa bits (16 bits in all). Buckets that stay empty take the
smallest hash of a further round of bucketing, at last of a hash of their own; so two sets agree in a bucket with just
the probability of their Jaccard similarity, short documents included, apart from chance collisions of
compressed registers, which the estimate corrects.

Rows with equal sets form one class; only classes are compared. Bands of registers make buckets of candidates: ``BANDS`` bands
of as many registers as leave a pair at the threshold a chance of 2e-6 to miss all of them (7 at a similarity of 0.85, 5 at 0.8). In each bucket all members are
compared with its smallest id first. Then, in buckets that still hold several components, blocks of members are compared
register by register (of a finer sketch), and pairs across components with a high estimate (five standard deviations below the threshold
or more) are verified: twice each member's best pair alone, so that components grow fast, and at last all of them. Pairs inside a component, and only these, are left out: they can't change components. Every link
is verified on full shingle sets (sorted 64-bit hashes).

Defined cases: texts without words (null, empty, white space) are linked with nothing. Each row is a document, also where it repeats a
doc_id or has none; a component is named by the smallest doc_id of its rows, and has no name (null) if none has an id. An empty
table gives an empty result. Extra columns are ignored by ``near_dedup`` and kept by ``drop_near_copies``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.common import Workspace, blobs, matrix, plain, slices, split_join, unwrapped, wrapped
from tallyloom.llm.components import components
from tallyloom.llm.words import hashing, mix, shingle_set, texts

BANDS, ROWS = 34, 7
REGISTERS = BANDS * ROWS
MANTISSA = 10
ROUNDS = 6
#: Times that components first grow along each member's best pair, before all pairs across components are compared.
MERGES = 2
#: Registers of the finer sketch by which the members of mixed buckets are compared.
FINE = 512
BLOCK = 2048
#: Bits of the hash by which rows that can't be wanted are left where they are.
BITMAP = 22
#: A band's chance of agreement at the threshold, at least: (1 - AGREE) ** BANDS is 2e-6.
AGREE = 0.3205
_SEEDS = mix(np.arange(1, ROUNDS + max(REGISTERS, FINE) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOW = np.uint64(0xFFFFFFFF)


def registers(shingles: np.ndarray, size: int = REGISTERS) -> np.ndarray:
    """The compressed registers (uint16) of a set of shingle hashes that isn't empty."""
    best = np.full(size, _LOW, dtype=np.uint64)
    empty = np.ones(size, dtype=bool)
    with np.errstate(over="ignore"):
        for t in range(ROUNDS):
            h = mix(shingles ^ _SEEDS[t])
            bucket = ((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
            value = h & _LOW
            if t:
                held = empty[bucket]
                bucket, value = bucket[held], value[held]
            np.minimum.at(best, bucket, value)
            empty[bucket] = False
            if not empty.any():
                break
        else:
            for at in np.flatnonzero(empty):
                best[at] = (mix(shingles ^ _SEEDS[ROUNDS + at]) & _LOW).min()
    bits = np.frexp(np.maximum(best, np.uint64(1)).astype(np.float64))[1]  # the length of the value in bits
    shift = bits - 1 - MANTISSA
    wide = best.astype(np.int64)
    mantissa = np.where(shift >= 0, wide >> np.maximum(shift, 0), wide << np.maximum(-shift, 0)) & ((1 << MANTISSA) - 1)
    return (((32 - bits) << MANTISSA) | mantissa).astype(np.uint16)


def chance(n_a, n_b, size: int = REGISTERS) -> np.ndarray:
    """The probability that registers of two disjoint sets of these sizes collide."""
    level = np.arange(32)
    def share(n):
        load = np.maximum(np.asarray(n, dtype=np.float64)[..., None] / size, 1.0)
        return np.exp(-load * 2.0 ** -(level + 1)) - np.exp(-load * 2.0**-level)
    return (share(n_a) * share(n_b)).sum(-1) / (1 << MANTISSA)


def estimate(equal, n_a, n_b, size: int = REGISTERS) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, corrected for collisions."""
    c = chance(n_a, n_b, size)
    return np.clip((np.asarray(equal) / size - c) / (1 - c), 0, 1)


def rows_of(percent: float) -> int:
    """Registers of a band for a threshold, ``ROWS`` at most."""
    return ROWS if percent >= 100 else max(1, min(ROWS, int(math.log(AGREE) / math.log(percent / 100))))


def band_hashes(regs: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band; ``regs`` has a row for each document."""
    part = regs[:, : BANDS * rows].reshape(len(regs), BANDS, rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), part.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for i in range(rows):
            out = mix((out << np.uint64(7)) ^ (out >> np.uint64(57)) ^ (part[:, :, i] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return out.view(np.int64)


def _slack(threshold: float, size: int = REGISTERS) -> float:
    return threshold - 5 * (threshold * (1 - threshold) / size) ** 0.5


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), dtype=np.int64).tolist())


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashing()
    for batch in batches:
        n, k1, k2, regs = [], [], [], []
        for text in texts(batch.column(1)):
            s = shingle_set(text)
            n.append(len(s))
            a, b = _digest(s)
            k1.append(a)
            k2.append(b)
            regs.append(registers(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(regs, pa.binary())], names=["doc_id", "n", "k1", "k2", "regs"])


def _bands(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                keys = band_hashes(matrix(part.column(1), np.uint16, REGISTERS), rows)
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], names=["bucket", "id"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, shingles, fine) of each text with words."""
    hashing()
    for batch in batches:
        for part in slices(batch, 0, 256, 1 << 20):
            sets = [x for x in map(shingle_set, texts(part.column(0))) if len(x)]
            keys = list(zip(*map(_digest, sets))) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.int64()), pa.array(keys[1], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([registers(x, FINE).tobytes() for x in sets], pa.binary())], names=["k1", "k2", "shingles", "fine"])


def _named_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, shingles, fine) of texts that have the set of their class; a row's text may have changed its class by a repeated doc_id."""
    hashing()
    for batch in batches:
        for part in slices(batch, 3, 256, 1 << 20):
            out = []
            for i, k1, k2, text in zip(*(part.column(c).to_pylist() for c in range(3)), texts(part.column(3))):
                s = shingle_set(text)
                if len(s) and _digest(s) == (k1, k2):
                    out.append((i, s.tobytes(), registers(s, FINE).tobytes()))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], names=["id", "shingles", "fine"])


def _likely(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (matrix(batch.column(c), np.uint16, REGISTERS) for c in ("ra", "rb"))
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            good = pa.array(estimate((a == b).sum(1), na, nb) >= _slack(threshold))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, dtype=bool)
            for i, (u, v) in enumerate(zip(blobs(batch.column("sa"), np.uint64), blobs(batch.column("sb"), np.uint64))):
                both = len(np.intersect1d(u, v, assume_unique=True))
                good[i] = 100 * both >= percent * (len(u) + len(v) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], names=["a", "b"])

    return run


def _across(threshold: float, rows: int, best: bool):
    """For two blocks of one bucket: pairs across components with a high estimate, each in the first band that it shares.

    With ``best``, only each member's pair of the highest estimate.
    """

    def run(group: pa.Table) -> pa.Table:
        left, right = (group.filter(pa.compute.equal(group["side"], s)) for s in (0, 1))
        same = right.num_rows == 0
        right = left if same else right
        unpack = lambda t: (t["id"].to_numpy(), t["component"].to_numpy(), t["n"].to_numpy(), matrix(t["fine"], np.uint16, FINE), band_hashes(matrix(t["regs"], np.uint16, REGISTERS), rows))
        ia, ca, na, ra, keys_a = unpack(left)
        ib, cb, nb, rb, keys_b = unpack(right)
        bucket, least = group["bucket"][0].as_py(), _slack(threshold, FINE)
        out_a, out_b = [], []
        for i in range(len(ia)):
            js = np.flatnonzero((cb != ca[i]) & ((ib > ia[i]) if same else True))
            if not len(js):
                continue
            value = estimate((rb[js] == ra[i]).sum(1), np.full(len(js), na[i]), nb[js], FINE)
            js, value = js[value >= least], value[value >= least]
            if not len(js):
                continue
            here = keys_b[js, (keys_b[js] == keys_a[i]).argmax(1)] == bucket
            js, value = js[here], value[here]
            if best and len(js):
                js = js[value.argmax()][None]
            out_a += np.minimum(ia[i], ib[js]).tolist()
            out_b += np.maximum(ia[i], ib[js]).tolist()
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def _mixed(members: DataFrame, labels: DataFrame, regs: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, dealt to pairs of blocks; two members alone were compared as a star."""
    labelled = members.join(labels, "id", "left").select("bucket", "size", "id", F.coalesce("component", "id").alias("component"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("size").alias("n_members")).filter("low < high and n_members > 2").select("bucket")
    left = labelled.join(mixed, "bucket", "left_semi").join(regs, "id")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    left = left.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return left.select("bucket", "id", "component", "n", "regs", "fine", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "sa", "sb").mapInArrow(_linked(percent), "a bigint, b bigint")


def near_classes(docs: DataFrame, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """A row for each document (doc_id, n, k1, k2), and one for each class of equal sets: k1, k2, size, first, name, keeper.

    ``first`` is the class's smallest doc_id, ``name`` its component's, and ``keeper`` is true for one class of a component, one with that id.
    """
    spark = docs.sparkSession
    work, rows_a_band, threshold = Workspace(spark, "minhash"), rows_of(percent), percent / 100
    docs = plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    rows = work.write(docs.mapInArrow(_sketch, "doc_id bigint, n bigint, k1 bigint, k2 bigint, regs binary"), "rows")
    classes = rows.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size"), F.any_value("n").alias("n"), F.any_value("regs").alias("regs"))
    classes = work.write(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    banded = classes.select("id", "regs").mapInArrow(_bands(rows_a_band), "bucket bigint, id bigint")
    many = banded.groupBy("bucket").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = work.write(banded.join(many, "bucket"), "members")
    # the classes that share a bucket; from here on only these matter
    known = work.write(classes.select("id", "first", "k1", "k2", "n", "regs").join(members.select("id"), "id", "left_semi"), "known")
    regs = known.select("id", "n", "regs")
    # stars: each member with its bucket's smallest id
    stars = members.filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    ends = lambda x, y: regs.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    likely = stars.join(ends("b", "rb"), "b").join(ends("a", "ra"), "a").mapInArrow(_likely(threshold), "a bigint, b bigint")
    likely = work.write(likely, "likely")

    sets = work.write(_class_sets(docs, known.select("id", "first", "k1", "k2")), "sets")
    links = work.write(_verified(likely, sets, percent), "links-0")
    labels = components(links, work, "labels-0")
    tested = likely
    for step in range(1, MERGES + 2):
        left = work.write(_mixed(members, labels, regs.join(sets.select("id", "fine").dropDuplicates(["id"]), "id")), f"left-{step}")
        if left.isEmpty():
            work.drop(f"left-{step}")
            break
        pairs = left.groupBy("bucket", "i", "j").applyInArrow(_across(threshold, rows_a_band, step <= MERGES), "a bigint, b bigint").distinct()
        pairs = work.write(pairs.join(tested, ["a", "b"], "left_anti"), f"pairs-{step}")
        work.drop(f"left-{step}")
        found = work.write(_verified(pairs, sets, percent), f"links-{step}")
        tested = tested.unionByName(pairs)
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = components(links, work, f"labels-{step}")
    for name in ("sets", "members", "likely", "known", *(f"pairs-{step}" for step in range(1, MERGES + 2))):
        work.drop(name)

    best = F.min(F.struct(F.col("first").isNull().alias("nameless"), "first", "id"))
    heads = labels.join(classes.select("id", "first"), "id").groupBy("component").agg(best.alias("head"))
    heads = labels.join(heads, "component").select("id", F.col("head.first").alias("name"), F.col("head.id").alias("head"))
    lone = F.col("head").isNull()
    named = classes.join(heads, "id", "left").select("k1", "k2", "size", "first", F.when(lone, F.col("first")).otherwise(F.col("name")).alias("name"), (lone | (F.col("head") == F.col("id"))).alias("keeper"))
    return rows.select("doc_id", "n", "k1", "k2"), work.write(named, "named")


def _probably(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without most rows whose doc_id isn't among ``ids``, so that few texts cross the network; none of those that are is lost.

    A bitmap of 2**``BITMAP`` hashed ids, a bounded table of 64-bit words, is broadcast; where ids fill it, it lets all rows pass.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << BITMAP))
    bit = F.call_function("shiftleft", F.expr("1L"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    held = ids.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    placed = docs.withColumn("place", place).withColumn("word", F.shiftright("place", 6))
    return placed.join(F.broadcast(held), "word").filter(F.col("bits").bitwiseAND(bit) != 0).select(docs.columns)


def _class_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, shingles, fine) of the wanted classes, from the text of the row with their first doc_id.

    Classes whose first doc_id another class has too, or that have none, find their texts by the sets' own digests.
    """
    shared = wanted.filter("first is not null").groupBy("first").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("first")
    alone = wanted.filter("first is not null").join(shared, "first", "left_anti").select("id", "k1", "k2", F.col("first").alias("doc_id"))
    sets = _probably(docs, alone).join(alone, "doc_id").select("id", "k1", "k2", "text").mapInArrow(_named_sets, "id bigint, shingles binary, fine binary")
    odd = wanted.filter("first is null").unionByName(wanted.join(shared, "first", "left_semi").select(wanted.columns))
    if odd.isEmpty():
        return sets
    again = docs.filter("doc_id is null").unionByName(docs.join(shared, F.col("doc_id") == F.col("first"), "left_semi"))
    again = again.select("text").mapInArrow(_sets, "k1 bigint, k2 bigint, shingles binary, fine binary").dropDuplicates(["k1", "k2"])
    return sets.unionByName(odd.join(again, ["k1", "k2"]).select("id", "shingles", "fine"))


def near_dedup(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    rows, classes = near_classes(docs, percent)
    out = split_join(rows.filter("n > 0"), classes.select("k1", "k2", "size", "name"), ["k1", "k2"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("name").alias("component_id"))
    alone = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, all columns; texts without words stay.

    The row with the component's smallest doc_id stays; rows without id come last. Of several such rows, which
    repeat an id or have none, one stays.
    """
    work, names = Workspace(docs.sparkSession, "near"), docs.columns
    rows, classes = near_classes(docs, percent)
    odd = work.write(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").select("doc_id"), "odd")
    stays = F.col("keeper") & F.col("doc_id").eqNullSafe(F.col("first"))
    gone = split_join(rows.filter("n > 0 and doc_id is not null"), classes, ["k1", "k2"]).filter(~stays).select("doc_id")
    every = wrapped(docs)
    if odd.isEmpty():
        gone = work.write(gone, "gone")
        return unwrapped(every.join(gone, F.col("row.doc_id") == F.col("doc_id"), "left_anti"), names)
    gone = work.write(gone.unionByName(odd.filter("doc_id is not null")).distinct(), "gone")
    clean = every.filter("row.doc_id is not null").join(gone, F.col("row.doc_id") == F.col("doc_id"), "left_anti")
    # rows that share their id, or have none, are numbered and go by their sets
    some = every.filter("row.doc_id is null").unionByName(every.join(odd, F.col("row.doc_id") == F.col("doc_id"), "left_semi"))
    some = work.write(some.withColumn("place", F.monotonically_increasing_id()), "some")
    keys = work.write(some.select("place", F.col("row.doc_id").cast("bigint").alias("doc_id"), F.col("row.text").alias("text")).mapInArrow(_row_keys, "place bigint, doc_id bigint, n bigint, k1 bigint, k2 bigint"), "keys")
    first = keys.filter("n > 0").groupBy("k1", "k2", "doc_id").agg(F.min("place").alias("place"))
    kept = first.join(classes.filter("keeper").select("k1", "k2", "first"), ["k1", "k2"]).filter(F.col("doc_id").eqNullSafe(F.col("first"))).select("place")
    kept = kept.unionByName(keys.filter("n = 0").select("place"))
    return unwrapped(clean.select("row").unionByName(some.join(kept, "place", "left_semi").select("row")), names)


def _row_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashing()
    for batch in batches:
        sets = [shingle_set(x) for x in texts(batch.column(2))]
        keys = list(zip(*map(_digest, sets))) or [(), ()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[0], pa.int64()), pa.array(keys[1], pa.int64())], names=["place", "doc_id", "n", "k1", "k2"])
