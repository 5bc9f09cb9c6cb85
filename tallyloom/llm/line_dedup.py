"""Line dedup over levelled sorted runs of line hashes.

Each batch of documents gives a sorted run of (line hash, number of documents). A new batch is merge-anti-joined
with the runs: hashes that the runs already hold in ``min_docs`` documents are settled and are left out, the rest is
added as the batch's own run. ``fanout`` runs of a level are compacted to one of the next, adding up the counts. A line
is hot once its counts reach ``min_docs`` over all runs; hot lines lose every occurrence. Runs kept in a folder take further batches (``LineRuns.open``).

Defined cases: a row is a document, also where its doc_id is null or repeated. A null or empty text is one empty line.
Lines of white space alone have an empty key and always stay. An empty table gives an empty result. Extra columns are
ignored by ``line_dedup`` and kept by ``drop_hot_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.llm.common import ASCII_SPACE, Workspace, ascii_lower, fingerprint, plain, unwrapped, wrapped

MIN_DOCS = 10


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def hashes_of(text: Column) -> Column:
    """An array, one entry a line: two hashes and whether the key is not empty."""
    def entry(x):
        a, b = fingerprint(key_of(x))
        return F.struct(a.alias("h1"), b.alias("h2"), (F.length(F.btrim(x, F.lit(ASCII_SPACE))) > 0).alias("full"))

    return F.transform(lines_of(text), entry)


class LineRuns:
    """Levelled sorted runs of (h1, h2, n) in the shared folder, and the settled hashes: those that have reached ``min_docs``.

    A run's name tells its level and the numbers of the batches that it holds, so that runs in a folder can be opened again and take further
    batches: runs that a compaction has replaced but not yet removed are left out.
    """

    def __init__(self, work: Workspace, min_docs: int = MIN_DOCS, fanout: int = 4):
        self.work, self.min_docs, self.fanout, self.levels, self.made = work, min_docs, fanout, {}, 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, min_docs: int = MIN_DOCS, fanout: int = 4) -> LineRuns:
        """The runs in a folder that all executors share, none if it is new."""
        runs = cls(Workspace.at_path(spark, path), min_docs, fanout)
        found = sorted((tuple(map(int, name.split("-")[1:])), name) for name in runs.work.names() if name.startswith("run-"))
        for (level, first, last), name in found:
            runs.made = max(runs.made, last + 1)
            if not any(a <= first and last <= b and (a, b) != (first, last) for (_, a, b), _ in found):
                runs.levels.setdefault(level, []).append(name)
        return runs

    def _read(self, names: list[str]) -> DataFrame:
        return self.work.spark.read.schema("h1 BIGINT, h2 BIGINT, n BIGINT").parquet(*[self.work.at(x) for x in names])

    def _write(self, rows: DataFrame, level: int, first: int, last: int) -> str:
        name = f"run-{level}-{first}-{last}"
        self.work.write(rows.sortWithinPartitions("h1", "h2"), name)
        return name

    def merged(self) -> DataFrame:
        names = [x for level in self.levels.values() for x in level]
        return self._read(names).groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def add(self, counts: DataFrame) -> None:
        """Anti-join a batch's (h1, h2, n) with the settled hashes of the runs and add the rest as a run."""
        if self.levels:
            counts = counts.join(self.hot(), ["h1", "h2"], "left_anti")
        level, name = 0, self._write(counts, 0, self.made, self.made)
        self.made += 1
        self.levels.setdefault(0, []).append(name)
        while len(self.levels[level]) >= self.fanout:
            full = self.levels.pop(level)
            ends = [tuple(map(int, x.split("-")[2:])) for x in full]
            level += 1
            name = self._write(self._read(full).groupBy("h1", "h2").agg(F.sum("n").alias("n")), level, min(a for a, _ in ends), max(b for _, b in ends))
            for old in full:
                self.work.drop(old)
            self.levels.setdefault(level, []).append(name)

    def add_documents(self, docs: DataFrame) -> None:
        """Add a further batch of documents (doc_id, text): a line counts once in each."""
        lines = F.filter(hashes_of(F.col("text")), lambda x: x["full"])
        each = plain(docs, "text").select(F.explode(F.array_distinct(F.transform(lines, lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))))).alias("x"))
        self.add(each.groupBy("x.h1", "x.h2").agg(F.count(F.lit(1)).alias("n")))

    def hot(self) -> DataFrame:
        return self.merged().filter(F.col("n") >= self.min_docs).select("h1", "h2")


def _logged(docs: DataFrame) -> DataFrame:
    """doc_id, two hashes of the text, and the hashes and positions of its lines with a key: a row for each document, without the texts."""
    t1, t2 = fingerprint(F.coalesce("text", F.lit("")))
    placed = F.transform(hashes_of(F.col("text")), lambda x, i: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["full"].alias("full"), i.alias("pos")))
    return docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), F.filter(placed, lambda x: x["full"]).alias("lines"))


def _hits(log: DataFrame, hot: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, hits): positions of hot lines for each document that has some."""
    lines = log.select("doc_id", "t1", "t2", F.explode("lines").alias("x")).select("doc_id", "t1", "t2", "x.h1", "x.h2", "x.pos")
    return lines.join(hot, ["h1", "h2"], "left_semi").groupBy("doc_id", "t1", "t2").agg(F.sort_array(F.collect_set("pos")).alias("hits"))


def _hot_lines(docs: DataFrame, work: Workspace, min_docs: int, batches: int) -> tuple[DataFrame, DataFrame]:
    """Hot hashes, and the documents' hits."""
    log = work.write(_logged(docs), "log")
    counted = log.select(F.pmod(F.xxhash64("doc_id", "t1"), F.lit(batches)).cast("int").alias("batch"), F.explode(F.array_distinct(F.transform("lines", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))))).alias("x"))
    counted = counted.groupBy("batch", "x.h1", "x.h2").agg(F.count(F.lit(1)).alias("n"))
    counted = work.write(counted, "batches")
    runs = LineRuns(work, min_docs)
    for b in range(batches):
        runs.add(counted.filter(F.col("batch") == b).select("h1", "h2", "n"))
    work.drop("batches")
    hot = work.write(runs.hot(), "hot")
    return hot, _hits(log, hot)


def _without(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """row (a struct of all columns of ``docs``), kept_lines, n, dropped; the text crosses the network once, keyed by id and its own hashes."""
    text = F.coalesce("row.text", F.lit(""))
    t1, t2 = fingerprint(text)
    keyed = wrapped(docs).withColumns({"u1": t1, "u2": t2})
    out = keyed.join(hits, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("u1") == F.col("t1")) & (F.col("u2") == F.col("t2")), "left")
    lines = lines_of(F.col("row.text"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("hits")), lambda i: F.get(lines, i))
    return out.select("row", F.when(F.col("hits").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("kept"), F.size(lines).cast("bigint").alias("n"), F.coalesce(F.size("hits"), F.lit(0)).cast("bigint").alias("dropped"))


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = 4) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256, kept_text for every row of ``docs`` (doc_id, text)."""
    work = Workspace(docs.sparkSession, "lines")
    docs = plain(docs, "doc_id", "text")
    _, hits = _hot_lines(docs, work, min_docs, batches)
    out = _without(docs, hits)
    return out.select("row.doc_id", F.col("n").alias("n_lines"), F.col("dropped").alias("n_dropped"), F.sha2(F.col("kept"), 256).alias("kept_sha256"), F.col("kept").alias("kept_text"))


def drop_hot_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = 4) -> DataFrame:
    """``docs`` with hot lines taken out of ``text``; all other columns as they are. A null text stays null."""
    work = Workspace(docs.sparkSession, "lines")
    _, hits = _hot_lines(plain(docs, "doc_id", "text"), work, min_docs, batches)
    return _cleaned(docs, hits)


def drop_lines_of(docs: DataFrame, runs: LineRuns) -> DataFrame:
    """``docs`` without the lines that are hot in ``runs``, such as those of earlier batches; all other columns as they are."""
    work = Workspace(docs.sparkSession, "lines")
    log = work.write(_logged(plain(docs, "doc_id", "text")), "log")
    return _cleaned(docs, _hits(log, work.write(runs.hot(), "hot")))


def _cleaned(docs: DataFrame, hits: DataFrame) -> DataFrame:
    text = F.when(F.col("dropped") > 0, F.col("kept")).otherwise(F.col("row.text"))
    return unwrapped(_without(docs, hits).withColumn("row", F.col("row").withField("text", text)), docs.columns)
