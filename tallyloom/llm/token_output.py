"""Token ids as Parquet list columns, in ascending doc_id order.

``write_tokens`` range-partitions the documents by doc_id, encodes each partition in order and writes a row for each
document: doc_id, the file part, the ids before it in that part, its number of ids, and the ids as a list column.
Ids are dictionary-encoded where a chunk's dictionary stays small, else plain; counts and offsets are delta-encoded (Parquet format v2). Row groups
and pages have set sizes; Parquet's page indexes let a reader take single documents or only the metadata columns.
``read_tokens`` adds up the parts' totals (one row a file) and returns global starts; ``read_metadata`` does so without reading any ids, and
``read_documents`` reads the row groups and pages alone that may hold the wanted documents.

Defined cases: a null or empty text has the end id alone. Null doc_ids come first, rows that repeat a doc_id follow each
other in order of their texts (null as empty); ranges are cut by doc_id and the first ``PREFIX`` characters, so that rows of one id may spread over tasks. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.llm.common import Workspace, claim, plain, released_shuffles, slices

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
PREFIX = 32
_ENCODERS: dict = {}
SCHEMA = "doc_id bigint, part int, part_start bigint, n_tokens bigint, token_ids array<int>"


def _shown_bytes() -> dict[int, str]:
    """The characters by which byte-level vocabularies show bytes: printable ones themselves, the others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) if b in printable else chr(256 + rest.index(b)) for b in range(256)}


class _Encoder:
    """Ids by the tokenizers library; byte-level vocabularies that split as the public pattern get distinct pieces once."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        from tallyloom.llm.pretoken import BatchEncoder

        self.tokenizer, self.shown = Tokenizer.from_file(path), _shown_bytes()
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        # the cuts of BatchEncoder hold for byte-level splitting as in the public pattern; other tokenizers take texts as a whole
        split = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        self.byte_level = split | {"trim_offsets": None} == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": None, "use_regex": True} and self.tokenizer.normalizer is None
        self.model, self.cut = self.tokenizer.model, BatchEncoder(self._piece, 300_000)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: bytes) -> bytes:
        text = piece.decode("utf-8")
        if not (text[1:] if text[0] == " " else text).isalpha():
            return self._whole(text)
        # letters alone, after a space or not, are one pre-token: the library's model takes it as it is
        text = text.replace(" ", self.shown[32]) if len(text) == len(piece) else piece.decode("latin-1").translate(self.shown)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def batch(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, ``end`` (packed) after each, and how many each has."""
        texts = pc.fill_null(texts, "")
        apart = np.full(len(texts), not self.byte_level)
        for x in self.special:
            apart |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        tails = [end] * len(texts)
        if apart.any():
            for i in np.flatnonzero(apart).tolist():
                tails[i] = self._whole(texts[i].as_py()) + end
            texts = pc.if_else(pa.array(apart), pa.scalar("", texts.type), texts)
        return self.cut(texts, tails)

    def __call__(self, text: str) -> bytes:
        return self.batch(pa.array([text], pa.string()), b"")[0].tobytes()


def _encoder(path: str) -> _Encoder:
    """The encoder of a tokenizer file, built once in each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    claim("tokens", _ENCODERS[path].cut.let_go)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = END_ID, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Write ``docs`` (doc_id, text) to Parquet at ``path``."""
    import public_tokenizers

    tokenizer_path = tokenizer_path or public_tokenizers.path(DEFAULT_TOKENIZER)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, before, run = context.partitionId() if context else 0, 0, _encoder(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for piece in slices(batch, 1, 1024, 2 << 20):
                ids, counts = run.batch(piece.column(1), end)
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.full(len(counts), part, np.int32)), pa.array(before + ends - counts), pa.array(counts), lists], names=["doc_id", "part", "part_start", "n_tokens", "token_ids"])
                before += int(ends[-1])

    docs = plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    text = F.coalesce("text", F.lit(""))
    ordered = docs.repartitionByRange("doc_id", F.substring(text, 1, PREFIX)).sortWithinPartitions("doc_id", text)
    options = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": page_bytes, "compression": "zstd"}
    with released_shuffles(docs.sparkSession):
        ordered.mapInArrow(encode, SCHEMA).write.mode("overwrite").options(**options).parquet(path)


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, offset): the ids of all parts before; a row for each file."""
    totals = sorted(spark.read.schema(SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    offsets, before = [], 0
    for part, n in totals:
        offsets.append((part, before))
        before += n
    return F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "part int, offset bigint"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, token_ids; starts count the ids of all documents before."""
    start = (F.col("offset") + F.col("part_start")).alias("start")
    return spark.read.schema(SCHEMA).parquet(path).join(_starts(spark, path), "part").select("doc_id", start, "n_tokens", "token_ids")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens; the column of ids isn't read."""
    return read_tokens(spark, path).drop("token_ids")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of ``read_tokens`` of some documents; their ids are pushed down to the files' statistics, as the files are in order of doc_id."""
    return read_tokens(spark, path).filter(F.col("doc_id").isin([int(x) for x in doc_ids]))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        ids, ends = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), lists.offsets.to_numpy()
        held = memoryview(np.ascontiguousarray(ids)).cast("B")
        crcs = [zlib.crc32(held[4 * a : 4 * b]) for a, b in zip(ends.tolist(), ends[1:].tolist())]
        counts = np.diff(ends).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(docs: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Write ``docs`` and read the files back: doc_id, start, n_tokens and ids_crc32, of the ids as read."""
    spark = docs.sparkSession
    path = path or Workspace(spark, "tokens").at("ids")
    write_tokens(docs, path, **how)
    return read_tokens(spark, path).mapInArrow(_crc, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
