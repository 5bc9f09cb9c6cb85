"""Exact dedup over a log-structured merge index of text digests (DataFrame operations only).

Documents are dealt to memtables by a hash of their id. A memtable flushes one sorted run: a row for each digest with
its smallest id and its count, in Parquet with min/max statistics on the digest, and the run's Bloom filter: a table of 64-bit blocks, in which a digest sets
four bits of one block. Compaction merges
runs level by level; of equal digests the smallest id stays and counts add up.

A memtable's digests are looked up in the runs before it: a run's filter leaves out most digests that the run doesn't hold, the others are joined
with its rows. Digests that an earlier run holds, or that occur more than once in their memtable, are shared; their smallest ids and counts are looked up
in the compacted runs in the same way. No other digest is read again: its document is alone. Documents of shared digests are
hits; they are compared byte for byte with the text of the row that stays, and rows that differ (a digest collision) form classes of their own by their text.

``DigestIndex`` may stay in a folder of its own, where later batches are looked up and flushed as further runs.

Defined cases: a null text counts as empty; empty texts equal one another. A null doc_id takes part like any other row,
is never the smallest unless all ids of its group are null, and is kept only then. Rows that repeat a doc_id with
the same text are the same document: they count towards group_size and report the same answer. An empty table gives an
empty result. Extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.llm.common import Workspace, plain, split_join

#: A run of white space that isn't one plain space already.
_RUNS = "[ \\t-\\r]{2,}|[\\t-\\r]"
#: Digests to a 64-bit block of a run's filter, and bits that each sets.
PER_BLOCK, BITS = 6, 4
#: Hits compared with one copy of a kept row's text, before the next copy takes over.
HITS_PER_COPY = 512


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def _place(digest: Column, blocks: int | Column) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(blocks) if isinstance(blocks, int) else blocks)


def _mask(digest: Column) -> Column:
    """A digest's bits in its block."""
    h = F.xxhash64(F.lit(1), digest)
    bits = [F.expr("1L") for _ in range(BITS)]
    bits = [F.call_function("shiftleft", one, F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i, one in enumerate(bits)]
    out = bits[0]
    for x in bits[1:]:
        out = out.bitwiseOR(x)
    return out


class DigestIndex:
    """Sorted digest runs at levels, with their filters; ``fanout`` runs of a level are compacted to one of the next.

    A run's name tells its level, its number and the numbers of the runs that it was made of, so that an index in a folder can be opened again:
    runs that a compaction has replaced but not yet removed are left out.
    """

    def __init__(self, work: Workspace, fanout: int = 4):
        self.work, self.fanout, self.levels, self.made = work, fanout, {}, 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, fanout: int = 4) -> DigestIndex:
        """The index in a folder that all executors share, empty if there is none yet."""
        index = cls(Workspace.at_path(spark, path), fanout)
        runs = sorted((tuple(map(int, name.split("-")[1:])), name) for name in index.work.names() if name.startswith("run-"))
        replaced = lambda a, b: any(c <= a and b <= d and (c, d) != (a, b) for (_, c, d), _ in runs)
        for (level, first, last), name in runs:
            index.made = max(index.made, last + 1)
            if not replaced(first, last):
                index.levels.setdefault(level, []).append(name)
        return index

    def _run(self, rows: DataFrame, level: int, first: int, last: int) -> str:
        name = f"run-{level}-{first}-{last}"
        merged = rows.groupBy("digest").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n"))
        run = self.work.write(merged.sortWithinPartitions("digest"), f"new-{name}")
        blocks = max(1, run.count() // PER_BLOCK)  # the filter first: a run under its own name is complete
        self.work.write(run.groupBy(_place(F.col("digest"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("digest"))).alias("bits"), F.lit(blocks).alias("blocks")), f"filter-{name}")
        self.work.rename(f"new-{name}", name)
        return name

    def _read(self, names: list[str]) -> DataFrame:
        return self.work.spark.read.schema("digest BINARY, first_id BIGINT, n BIGINT").parquet(*[self.work.at(x) for x in names])

    def names(self) -> list[str]:
        return [x for level in self.levels.values() for x in level]

    def flush(self, memtable: DataFrame) -> None:
        """Add a memtable (digest, first_id, n) as a run of level 0, then compact full levels."""
        self._settle(self._run(memtable, 0, self.made, self.made))

    def absorb(self, memtable: DataFrame) -> DataFrame:
        """``flush``, but the run's digests are looked up in the runs before it: the shared ones among them (digest)."""
        name = self._run(memtable, 0, self.made, self.made)
        rows = self._read([name])
        shared = rows.filter(F.col("n") > 1).select("digest")
        if self.names():
            shared = shared.unionByName(self.lookup(rows.select("digest")).select("digest")).distinct()
        shared = self.work.write(shared, f"shared-{self.made}")
        self._settle(name)
        return shared

    def _settle(self, name: str) -> None:
        level = 0
        self.made += 1
        self.levels.setdefault(0, []).append(name)
        while len(self.levels[level]) >= self.fanout:
            full = self.levels.pop(level)
            ends = [tuple(map(int, x.split("-")[2:])) for x in full]
            level += 1
            name = self._run(self._read(full), level, min(a for a, _ in ends), max(b for _, b in ends))
            for old in full:
                self.work.drop(old)
                self.work.drop(f"filter-{old}")
            self.levels.setdefault(level, []).append(name)

    def rows(self) -> DataFrame:
        """All runs merged: digest, first_id, n."""
        names = self.names()
        runs = self._read(names)
        return runs if len(names) == 1 else runs.groupBy("digest").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n"))

    def maybe(self, digests: DataFrame, name: str) -> DataFrame:
        """The rows of ``digests`` whose digest a run's filter lets pass: all that the run holds, and a few that it doesn't."""
        held = self.work.spark.read.schema("block BIGINT, bits BIGINT, blocks INT").parquet(self.work.at(f"filter-{name}"))
        blocks = held.select("blocks").first()
        if blocks is None:
            return digests.limit(0)
        placed = digests.withColumns({"block": _place(F.col("digest"), blocks[0]), "mask": _mask(F.col("digest"))})
        return placed.join(held.select("block", "bits"), "block").filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select(digests.columns)

    def lookup(self, digests: DataFrame) -> DataFrame:
        """digest, first_id, n of those distinct ``digests`` (digest) that some run holds."""
        found = None
        for name in self.names():
            hits = self.maybe(digests.select("digest"), name).join(self._read([name]), "digest")
            found = hits if found is None else found.unionByName(hits)
        if found is None:
            return digests.select("digest", F.lit(None).cast("bigint").alias("first_id"), F.lit(None).cast("bigint").alias("n")).limit(0)
        return found.groupBy("digest").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n"))

    def add(self, docs: DataFrame) -> DataFrame:
        """Look a further batch of documents (doc_id, text) up and add it: doc_id, digest, first_id (of the runs so far), seen.

        ``seen`` tells that an earlier batch has the digest; bytes aren't compared, as earlier texts aren't kept in the index.
        """
        rows = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"))
        rows = self.work.write(rows, f"batch-{self.made}")
        found = self.work.write(self.lookup(rows.select("digest").distinct()).select("digest", "first_id"), f"found-{self.made}")
        self.flush(rows.select("digest", F.col("doc_id").alias("first_id"), F.lit(1).cast("bigint").alias("n")))
        return rows.join(found.withColumn("seen", F.lit(True)), "digest", "left").select("doc_id", "digest", "first_id", F.coalesce("seen", F.lit(False)).alias("seen"))


def exact_dedup(docs: DataFrame, memtables: int = 4, fanout: int = 4) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    work = Workspace(spark, "exact")
    docs = plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    norm = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    log = work.write(norm.select("doc_id", F.unhex(F.sha2("norm", 256)).alias("digest")), "log")

    index, shared = DigestIndex(work, fanout), None
    for m in range(memtables):
        part = log.filter(F.pmod(F.xxhash64("doc_id"), F.lit(memtables)) == m)
        found = index.absorb(part.select("digest", F.col("doc_id").alias("first_id"), F.lit(1).cast("bigint").alias("n")))
        shared = found if shared is None else shared.unionByName(found)
    classes = work.write(index.lookup(shared.distinct()), "classes").withColumn("size", F.col("n"))
    for name in [*index.names(), *[f"filter-{x}" for x in index.names()], *[f"shared-{m}" for m in range(memtables)]]:
        work.drop(name)

    # hits and the rows that stay, with their texts: only groups of more than one row need bytes
    members = split_join(log, classes, ["digest"]).select("doc_id", "digest", "first_id", "n").distinct()
    texts = norm.withColumn("digest", F.unhex(F.sha2("norm", 256)))
    held = texts.alias("t").join(members.alias("m"), F.col("t.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("t.digest") == F.col("m.digest"))).select("t.doc_id", "t.digest", "first_id", "n", "norm")
    held = work.write(held, "held")
    copies = F.ceil(F.col("n") / HITS_PER_COPY).cast("int")
    hits = held.filter(~F.col("doc_id").eqNullSafe(F.col("first_id"))).withColumn("salt", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), copies).cast("int"))
    keepers = held.filter(F.col("doc_id").eqNullSafe(F.col("first_id"))).dropDuplicates(["digest"])
    keepers = keepers.select("digest", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"), F.col("norm").alias("kept_norm"))
    differ = hits.join(keepers, ["digest", "salt"]).filter(F.col("norm") != F.col("kept_norm"))
    differ = work.write(differ.select("doc_id", "digest", "norm"), "differ")
    work.drop("held")

    # a document that no class takes up is alone
    out = split_join(log, classes, ["digest"], "left")
    out = out.withColumns({"n": F.coalesce("n", F.lit(1).cast("bigint")), "first_id": F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first_id"))})
    size, keep = F.col("n"), F.col("first_id")
    if not differ.isEmpty():  # digests that collide: the rows that differ are regrouped by their text
        own = differ.groupBy("digest", "norm").agg(F.min("doc_id").alias("own_id"), F.count(F.lit(1)).alias("own_n"))
        own = differ.join(own, ["digest", "norm"]).select("digest", "doc_id", "own_id", "own_n").distinct()
        gone = differ.groupBy("digest").agg(F.count(F.lit(1)).alias("gone"))
        out = out.join(own, ["digest", "doc_id"], "left").join(gone, "digest", "left")
        size = F.coalesce(F.col("own_n"), F.col("n") - F.coalesce(F.col("gone"), F.lit(0)))
        keep = F.coalesce(F.col("own_id"), F.col("first_id"))
    return out.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
