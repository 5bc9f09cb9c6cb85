"""What the training-data operators share: a shared work folder, table reading, bounded batches and hashing columns."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.shipping import ship_package

ASCII_SPACE = " \t\n\x0b\f\r"  # [\x20\x09-\x0D]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Arrow batches to Python workers: Spark's own settings, which a session may have changed, and ours in their place.
_ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2048"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m")}
#: Classes that split_join broadcasts at most.
HOT = 4096


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a folder of our own, in local mode alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/tallyloom-shared"
    return root.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session, unless it has chosen its own sizes: 10,000 long texts are gigabytes."""
    for key, (default, ours) in _ARROW.items():
        with contextlib.suppress(Exception):  # a Spark without the setting
            if spark.conf.get(key) == default:
                spark.conf.set(key, ours)


_MADE: weakref.WeakSet[Workspace] = weakref.WeakSet()


def release() -> None:
    """Remove the intermediate tables of all operators called so far; results that aren't written yet can't be read after that."""
    for work in list(_MADE):
        work.drop()


class Workspace:
    """A folder of intermediate Parquet tables under the shared root.

    Written tables cut the lineage: an executor lost later costs a re-read, not a recomputation. Tables that a returned
    DataFrame still reads stay until ``release()`` or the driver's end; ``drop`` removes the others as soon as they are used up.
    """

    def __init__(self, spark: SparkSession, op: str):
        self.spark, self.path = spark, f"{shared_root(spark)}/tallyloom/{op}-{uuid.uuid4().hex}"
        atexit.register(self.drop)
        _MADE.add(self)

    @classmethod
    def at_path(cls, spark: SparkSession, path: str) -> Workspace:
        """A folder that stays, at a path that all executors share."""
        work = cls.__new__(cls)
        work.spark, work.path = spark, path.rstrip("/")
        return work

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at(name) if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def names(self) -> list[str]:
        """The tables in the folder that were written to their end."""
        files, path = self._files("")
        if not files.exists(path):
            return []
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return [x.getPath().getName() for x in files.listStatus(path) if files.exists(done(x.getPath(), "_SUCCESS"))]

    def rename(self, old: str, new: str) -> None:
        files, path = self._files(old)
        files.rename(path, self._files(new)[1])

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None, **options) -> DataFrame:
        """Write ``df`` as Parquet and return the written table with the same schema."""
        schema = df.schema
        writer = df.write.mode("overwrite").options(compression="zstd", **options)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        with released_shuffles(self.spark):
            writer.parquet(self.at(name))
        return self.spark.read.schema(schema).parquet(self.at(name))

    def drop(self, name: str = "") -> None:
        with contextlib.suppress(Exception):  # at interpreter exit the JVM may be gone
            files, path = self._files(name)
            files.delete(path, True)


@contextlib.contextmanager
def released_shuffles(spark: SparkSession):
    """Within this block, an SQL execution's shuffle files go as soon as it ends (its result is written by then)."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone. Texts of ASCII bytes only take the fast native lower()."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def fingerprint(c: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a value, under different seeds."""
    return F.xxhash64(c), F.xxhash64(F.lit(0x9E3779B9), c)


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """The given columns alone: extra columns of any name never meet those that an operator makes."""
    ship_package(df.sparkSession)
    bounded_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in columns])


def wrapped(df: DataFrame) -> DataFrame:
    """All columns in one struct ``row``, so that none meets a column that an operator makes."""
    ship_package(df.sparkSession)
    bounded_batches(df.sparkSession)
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unwrapped(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(f"row.`{c}`") for c in names])


def split_join(rows: DataFrame, classes: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``classes`` on ``keys``, where a class's ``size`` is the number of its rows; ``left`` keeps rows without a class.

    Classes with more than 1 in ``HOT`` of all rows, ``HOT`` of them at most, are broadcast: their rows stay where they are. So no
    key brings more than that share of the rows to one task.
    """
    total = classes.agg(F.sum("size")).first()[0] or 0
    hot = classes.filter(F.col("size") > max(64, total // HOT))
    if hot.isEmpty():
        return rows.join(classes, keys, how)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(classes.filter(F.col("size") <= max(64, total // HOT)), keys, how)
    return rest.unionByName(rows.join(F.broadcast(hot), keys))


def slices(batch: pa.RecordBatch, column: int, rows: int = 1024, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows and ``size`` bytes of a text column, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def _ends(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]


def blobs(column: pa.Array, kind: type) -> list[np.ndarray]:
    """A binary column's values as arrays over its buffer, without copies."""
    width, data = np.dtype(kind).itemsize, column.buffers()[2]
    ends = _ends(column).tolist()
    return [np.frombuffer(data, kind, (b - a) // width, a) if b > a else np.empty(0, kind) for a, b in zip(ends, ends[1:])]


def matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """A binary column of values of one length as a matrix over its buffer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, width), kind)
    return np.frombuffer(column.buffers()[2], kind, len(column) * width, int(_ends(column)[0])).reshape(-1, width)


_HELD: dict[str, Callable[[], None]] = {}


def claim(name: str, let_go: Callable[[], None]) -> None:
    """At a task's start in a Python worker: the caches that other operators left there go, this one's stay for the next task."""
    others = [x for x in _HELD if x != name]
    for other in others:
        _HELD.pop(other)()
    if others:
        pa.default_memory_pool().release_unused()
    _HELD[name] = let_go
