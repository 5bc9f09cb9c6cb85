"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades come from the labels: 0 not toxic, 1 toxic, 2 toxic and of low quality. The model has one weight vector w and
ordered thresholds: P(grade >= k) = sigmoid(w.x - t_k). x counts a document's distinct words by hashed features, the word
itself and its prefixes of 4 to 7 letters. Weights are fitted by accelerated proximal gradient with an L1 penalty, so that
most are zero. The output is the expected grade, the sum of P(grade >= k).

The fit takes the ``SAMPLE`` labelled documents with the smallest hash of their id (a bound on training rows; all of a
text is used). Scoring covers all documents.

Defined cases: a null or empty text has no features and gets the severity of an empty text. Labels that are null or
without a document are ignored; of repeated labels the most severe counts. Without labelled rows, or with no toxic one, all
severities are 0. Repeated rows get equal answers. An empty table gives an empty result. Extra columns are ignored by
``severity`` and kept by ``drop_toxic``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.common import claim, plain, slices

SAMPLE = 6000
BITS = 20
GRADES = 3
#: Expected grade from which a document counts as toxic; on held-out labels of the test data this finds 99 % without a clean one.
REJECT = 0.25
_WORD = re.compile(r"[^\W\d_]+")


def _features(word: str) -> list[int]:
    keys = ["w" + word, *("p" + word[:n] for n in range(4, 8) if len(word) >= n)]
    return [xxhash.xxh32_intdigest(k) >> (32 - BITS) for k in keys]


def _words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's features, distinct ones with counts, packed."""
    for batch in batches:
        ids, counts = [], []
        for text in batch.column(1).to_pylist():
            found, n = np.unique(np.array([f for w in _words(text) for f in _features(w)], dtype=np.uint32), return_counts=True)
            ids.append(found.tobytes())
            counts.append(n.astype(np.uint16).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "grade", "ids", "counts"])


class Ordinal:
    """Cumulative-link model: weights of hashed features and GRADES - 1 ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def expected(self, scores: np.ndarray) -> np.ndarray:
        return (1 / (1 + np.exp(np.clip(self.thresholds[None, :] - np.asarray(scores)[:, None], -40, 40)))).sum(1)

    @classmethod
    def fit(cls, rows: list[tuple[int, np.ndarray, np.ndarray]], steps: int = 250, l1: float = 1e-3, least: int = 10) -> Ordinal:
        """``rows``: grade, feature ids, counts. Features of fewer than ``least`` documents are left out."""
        grades = np.array([g for g, _, _ in rows])
        if not len(rows) or not (grades > 0).any():
            return cls(np.zeros(1 << BITS, np.float32), np.full(GRADES - 1, 40.0))
        seen = np.zeros(1 << BITS, dtype=np.int32)
        for _, x, _ in rows:
            seen[x] += 1
        kept = seen >= min(least, max(2, len(rows) // 50))
        names, number = np.flatnonzero(kept), np.cumsum(kept) - 1
        held = [(number[x[good]], np.sqrt(k[good], dtype=np.float32)) for _, x, k in rows if (good := kept[x]) is not None]
        lengths = np.array([len(x) for x, _ in held])
        full = lengths > 0
        starts = (np.cumsum(lengths) - lengths)[full]
        col, value = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
        held = None
        n, m = len(rows), len(names)

        # features less their means: words of most documents would slow the descent down; the thresholds take the difference
        means = np.bincount(col, value, m) / n

        def of_rows(w: np.ndarray) -> np.ndarray:
            out = np.zeros(n)
            if len(col):
                out[full] = np.add.reduceat(value * w[col], starts)
            return out - w @ means

        def of_columns(x: np.ndarray) -> np.ndarray:
            return np.bincount(col, value * np.repeat(x, lengths), m) - x.sum() * means

        above = (grades[:, None] >= np.arange(1, GRADES)[None, :]).astype(np.float64)
        share = np.clip(above.mean(0), 1 / (4 * n), 1 - 1 / (4 * n))
        t = np.log((1 - share) / share)
        w = np.zeros(m)
        # a bound on the curvature from a power iteration on the design matrix
        v = np.cos(np.arange(m)) / max(1, m) ** 0.5
        top = 1.0
        for _ in range(12):
            u = of_columns(of_rows(v))
            top = max(np.linalg.norm(u), 1e-9)
            v = u / top
        rate = 1 / (0.25 * (GRADES - 1) * (top + n) / n)
        z, tz, momentum = w, t, 1.0
        for _ in range(steps):
            score = of_rows(z)
            p = 1 / (1 + np.exp(np.clip(tz[None, :] - score[:, None], -40, 40)))
            error = (p - above) / n
            gradient = of_columns(error.sum(1))
            w_new = z - rate * gradient
            w_new = np.sign(w_new) * np.maximum(np.abs(w_new) - rate * l1, 0)
            t_new = np.sort(tz + rate * error.sum(0))
            m_new = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
            z = w_new + (momentum - 1) / m_new * (w_new - w)
            tz = t_new + (momentum - 1) / m_new * (t_new - t)
            w, t, momentum = w_new, t_new, m_new
        weights = np.zeros(1 << BITS, np.float32)
        weights[names] = w
        return cls(weights, t + w @ means)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    labels = plain(labels, "doc_id", "quality", "toxic").filter("doc_id is not null and toxic is not null")
    grade = F.when(F.col("toxic") <= 0, 0).when(F.coalesce("quality", F.lit(1)) <= 0, 2).otherwise(1)
    graded = labels.groupBy("doc_id").agg(F.max(grade).alias("grade"))
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = plain(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "grade")
    # of rows that repeat an id, one text; so at most ``sample`` rows come to the driver
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "grade")).alias("x")).select("doc_id", "x.text", "x.grade")
    got = rows.mapInArrow(_sampled, "doc_id bigint, grade int, ids binary, counts binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.grade, bytes(r.ids)))
    # a copied text would count several times and drown the rest
    distinct = {bytes(r.ids): r for r in got}
    del got
    return Ordinal.fit([(r.grade, np.frombuffer(r.ids, np.uint32), np.frombuffer(r.counts, np.uint16)) for r in distinct.values()])


class _Scorer:
    """Scores texts by a fitted model; weights of words are looked up once. It stays with the broadcast model from task to task."""

    LIMIT = 250_000

    def __init__(self, fitted: Ordinal):
        self.fitted, self.known = fitted, {}

    @classmethod
    def of(cls, model) -> _Scorer:
        fitted = model.value
        if not hasattr(fitted, "scorer"):
            fitted.scorer = cls(fitted)
        claim("toxicity", fitted.scorer.known.clear)
        return fitted.scorer

    def hits(self, word: str) -> list[tuple[int, float]]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= self.LIMIT:
                self.known.clear()
            found = self.known[word] = [(f, float(self.fitted.weights[f])) for f in _features(word) if self.fitted.weights[f]]
        return found

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        scores = []
        for text in texts:
            total: dict[int, list] = {}
            for word in _words(text):
                for f, x in self.hits(word):
                    at = total.setdefault(f, [0, x])
                    at[0] += 1
            scores.append(sum(n**0.5 * x for _, (n, x) in sorted(total.items())))
        return self.fitted.expected(np.array(scores, dtype=np.float64))


def severity(docs: DataFrame, labels: DataFrame, reject: float = REJECT, sample: int = SAMPLE) -> DataFrame:
    """doc_id, severity (expected grade, 0 to 2) and rejected for every row of ``docs`` (doc_id, text)."""
    docs = plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer.of(model)
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "severity"])

    return docs.mapInArrow(score, "doc_id bigint, severity double").withColumn("rejected", F.col("severity") >= reject)


def drop_toxic(docs: DataFrame, labels: DataFrame, reject: float = REJECT, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without rejected documents; all columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer.of(model)
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(scorer(part.column(at).to_pylist()) < reject))

    return docs.mapInArrow(keep, docs.schema)
