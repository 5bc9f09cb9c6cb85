"""Benchmark decontamination: SimHash fingerprints of item-sized windows in a multi-index, verified exactly.

Words are runs of non-space characters, lower-cased.
An item's fingerprint is the 64-bit SimHash of its weighted word shingles (weight: how often a shingle occurs). A
document's windows have as many words as an item, for each item size, at every position where a window shares a shingle
with some item; windows that share none have similarity 0. Fingerprints are cut into 8 blocks of 8 bits, and a
block's index lists the items within 2 bits of each value. By the pigeonhole principle every item within a Hamming
distance of 23 agrees with the window up to 2 bits in some block, so the index misses none. A block's index holds a bitmap of items for each
value, so that a window's candidates are the union of 8 bitmaps: 8 words of work for 64 items. Candidates are verified by
weighted Jaccard similarity of their shingles. At similarity 0.8 the expected distance is 9.7 (deviation 2.9), so
that the radius leaves out less than one in 100,000.

The benchmark goes to the executors in blocks of at most ``ITEMS`` items and ``ITEM_BYTES`` bytes of text (one item at
least), one pass over the documents for each block.

Defined cases: items and texts without words (null, empty) match nothing. Items of fewer than 5 words count as one
shingle and match windows of just their words. Rows that repeat a doc_id or an item_id give one row with the best match.
Null ids are kept as null. Empty tables give an empty result. Extra columns are ignored by ``contamination`` and kept by
``drop_contaminated``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.common import plain, slices
from tallyloom.llm.words import SHINGLE, folded_words, hashing, shingle_hashes, texts, word_hashes

RADIUS, BLOCKS, BLOCK_BITS = 23, 8, 8
ITEMS, ITEM_BYTES = 20_000, 16 << 20
_SCHEMA = "doc_id bigint, item_id bigint, similarity double, start_word bigint, end_word bigint"


def _signs(hashes: np.ndarray) -> np.ndarray:
    """A row of 64 entries +1 or -1 for each hash."""
    return (np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) << 1) - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def simhash(hashes: np.ndarray) -> int:
    return int(_packed(_signs(hashes).sum(0, keepdims=True))[0])


class _Sized:
    """The items of one size in words, with their multi-index."""

    def __init__(self, width: int, items: list[tuple[int, np.ndarray]]):
        self.width, self.ids, self.counts = width, [x for x, _ in items], [Counter(h.tolist()) for _, h in items]
        self.shingles = max(1, width - SHINGLE + 1)
        self.prints = np.array([simhash(h) for _, h in items], dtype=np.uint64)
        distance = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])
        close = distance <= RADIUS // BLOCKS
        spare = np.zeros((256, -len(items) % 64), dtype=bool)
        self.index = [np.packbits(np.hstack([close[:, (self.prints >> np.uint64(BLOCK_BITS * b)).astype(np.uint8)], spare]), axis=1, bitorder="little").view(np.uint64) for b in range(BLOCKS)]

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) numbers within the radius."""
        found = []
        step = max(1, (1 << 21) // len(self.ids))  # windows at a time, for bounded memory
        for start in range(0, len(prints), step):
            part = prints[start : start + step]
            near = np.zeros((len(part), self.index[0].shape[1]), dtype=np.uint64)
            for b in range(BLOCKS):
                near |= self.index[b][(part >> np.uint64(BLOCK_BITS * b)).astype(np.uint8)]
            at, item = np.nonzero(np.unpackbits(near.view(np.uint8), axis=1, count=len(self.ids), bitorder="little"))
            good = np.bitwise_count(part[at] ^ self.prints[item]) <= RADIUS
            found.append((at[good] + start, item[good]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2


class Items:
    """A block of the benchmark, ready for scanning texts."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        by_width: dict[int, list] = {}
        gate: dict[int, set[int]] = {}
        for item, text in rows:
            hashes = word_hashes(folded_words(text))
            if len(hashes):
                shingles = shingle_hashes(hashes)
                by_width.setdefault(len(hashes), []).append((item, shingles))
                gate.setdefault(min(len(hashes), SHINGLE), set()).update(shingles.tolist())
        self.sized = [_Sized(w, x) for w, x in sorted(by_width.items())]
        self.gates = {}
        for width, hashes in gate.items():
            known = np.array(sorted(hashes), dtype=np.uint64)
            bits = np.zeros(1 << 20, dtype=bool)
            bits[(known & np.uint64(0xFFFFF)).astype(np.int64)] = True
            self.gates[width] = (known, bits)

    def matches(self, text: bytes | None, threshold: float) -> dict[int, tuple[float, int, int]]:
        """item -> best similarity, first word and end word of its window; the earliest of equal windows."""
        hashes = word_hashes(folded_words(text))
        found: dict[int, tuple[float, int, int]] = {}
        for width, (known, bits) in self.gates.items():
            if len(hashes) < width:
                continue
            shingles = shingle_hashes(hashes, width)
            at = np.flatnonzero(bits[(shingles & np.uint64(0xFFFFF)).astype(np.int64)])
            if len(at):
                at = at[known[np.minimum(np.searchsorted(known, shingles[at]), len(known) - 1)] == shingles[at]]
            if len(at):
                self._scan(shingles, at, len(hashes), width, threshold, found)
        return found

    def _scan(self, shingles, at, n_words, width, threshold, found) -> None:
        for sized in self.sized:
            if min(sized.width, SHINGLE) != width:
                continue
            if sized.width > n_words:
                self._short(shingles, sized, n_words, threshold, found)
                continue
            # starts of windows with a known shingle; runs of starts that lie close together share their sums
            last = n_words - sized.width
            low, high = np.maximum(at - sized.shingles + 1, 0), np.minimum(at, last)
            cuts = np.flatnonzero(low[1:] > high[:-1] + 1) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(at)]):
                first, end = int(low[a]), int(high[b - 1]) + 1
                if first >= end:
                    continue
                for start in range(first, end, 4096):  # bounded sums
                    stop = min(start + 4096, end)
                    signs = _signs(shingles[start : stop + sized.shingles - 1])
                    sums = np.cumsum(np.vstack([np.zeros((1, 64), np.int32), signs]), axis=0)
                    prints = _packed(sums[sized.shingles :] - sums[: -sized.shingles])
                    where, item = sized.candidates(prints)
                    counts: dict[int, Counter] = {}
                    for w, i in zip(where.tolist(), item.tolist()):
                        if w not in counts:
                            counts[w] = Counter(shingles[start + w : start + w + sized.shingles].tolist())
                        self._keep(found, sized, i, counts[w], start + w, start + w + sized.width, threshold)

    def _short(self, shingles, sized, n_words, threshold, found) -> None:
        """A text shorter than the item is one window itself."""
        where, item = sized.candidates(np.array([simhash(shingles)], dtype=np.uint64))
        counts = Counter(shingles.tolist())
        for i in item.tolist():
            self._keep(found, sized, i, counts, 0, n_words, threshold)

    @staticmethod
    def _keep(found, sized, i, counts, start, end, threshold) -> None:
        own = sized.counts[i]
        both = sum(min(n, own[h]) for h, n in counts.items() if h in own)
        value = both / (sum(counts.values()) + sum(own.values()) - both)
        item = sized.ids[i]
        if value >= threshold and (item not in found or (-value, start) < (-found[item][0], found[item][1])):
            found[item] = (value, start, end)


def _blocks(benchmark: DataFrame) -> Iterator[DataFrame]:
    """The items with a text, in blocks of a bounded size."""
    items = plain(benchmark, "item_id", "text").withColumn("item_id", F.col("item_id").cast("bigint")).filter("text is not null")
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS), -(-size // ITEM_BYTES))
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield benchmark.sparkSession.sparkContext.broadcast([(r[0], r[1].encode()) for r in part.collect()])


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, similarity, start_word, end_word: each document with each item that it holds, at the best window."""
    docs = plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    out = None
    for rows in _blocks(benchmark):
        found = docs.mapInArrow(_scanner(rows, threshold), _SCHEMA)
        out = found if out is None else out.unionByName(found)
    best = F.max_by(F.struct("similarity", "start_word", "end_word"), F.struct("similarity", -F.col("start_word")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.*")


def _scanner(rows, threshold: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing()
        items = Items(rows.value)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                out += [(doc, item, *x) for item, x in items.matches(text, threshold).items()]
            columns = list(zip(*out)) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "similarity", "start_word", "end_word"])

    return scan


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the rows whose text holds an item; all columns. Each row goes by its own text, whatever its doc_id."""
    at = docs.columns.index("text")
    plain(docs, "text")

    def keeper(rows):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashing()
            items = Items(rows.value)
            for batch in batches:
                for part in slices(batch, at):
                    yield part.filter(pa.array([not items.matches(x, threshold) for x in texts(part.column(at))], pa.bool_()))

        return keep

    for rows in _blocks(benchmark):
        docs = docs.mapInArrow(keeper(rows), docs.schema)
    return docs
