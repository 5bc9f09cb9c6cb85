"""Language identification: scripts narrow the candidates, then Viterbi labels spans of mixed-language text.

Training counts hashed character n-grams (1 to 4, with word edges) and whole words for each language. It learns from
labelled documents only, about ``PER_LANGUAGE`` for each language, chosen by a hash of the id (a bound on training
rows; all of a text is used); the counts have at most 2**``BITS`` entries for each language. A word's score for a language
is its summed log probability, relative to the best language. The languages of a word are those that training saw in
the word's script; others get the lowest score. The words new to a batch are scored together, as arrays of n-gram numbers. Viterbi finds the labelling of a text's words of the highest total
score, where each change of language costs ``SWITCH``. The text's language has the most letters in these spans, and the score is
its share of all letters, where letters of words in a script that no language was trained on count for none.

Defined cases: null texts and texts without letters give und with score 0 and no spans. Ties go to the smaller language name; so a text in
unknown scripts alone gets the first language with score 0.
Without labelled rows every text gives und. A null doc_id is hashed as an empty string. Repeated rows get equal answers; an
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.llm.common import claim, plain, slices

PER_LANGUAGE = 1500
BITS = 16
SWITCH = 12.0
FLOOR = -8.0
#: The first code points of script blocks, and a script's name from there on.
_SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xFF00, "latin"),
]
_STARTS = [a for a, _ in _SCRIPTS]


def script_of(char: str) -> str:
    return _SCRIPTS[bisect_right(_STARTS, ord(char)) - 1][1]


def _letters(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words scored at once.
TOGETHER = 50_000


def _features(words: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Features of words (letters alone): (places, feature numbers) of each kind, and where each word's places begin.

    A place is a character of a word with its edges; the n-grams that start there, and at a word's first place the whole word.
    """
    codes = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    left = np.repeat(starts + sizes, sizes) - np.arange(len(codes))  # characters from here to the word's end
    kinds = []
    with np.errstate(over="ignore"):
        def numbers(h: np.ndarray, n: int) -> np.ndarray:
            h = (h ^ (h >> np.uint64(31))) * _MIX + np.uint64(n)
            return ((h ^ (h >> np.uint64(29))) * _MIX >> np.uint64(64 - BITS)).astype(np.int64)

        h = np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, 5):
            h = h[: len(codes) - n + 1] * np.uint64(1_000_003) + codes[n - 1 :]
            at = np.flatnonzero(left[: len(h)] >= n)
            kinds.append((at, numbers(h[at], n)))
        place = np.arange(len(codes)) - np.repeat(starts, sizes)
        power = np.cumprod(np.r_[np.uint64(1), np.full(int(sizes.max(initial=1)), 1_000_003, dtype=np.uint64)])
        kinds.append((starts, numbers(np.add.reduceat(codes * power[place], starts) if len(words) else starts.astype(np.uint64), 5)))
    return kinds, starts


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, feature, n) of a task's texts; features from 2**BITS on stand for scripts."""
    scripts = {name: (1 << BITS) + i for i, name in enumerate(sorted({x for _, x in _SCRIPTS}))}
    totals: dict[str, np.ndarray] = {}
    words: dict[str, Counter] = {}

    def add() -> None:
        for lang, counts in words.items():
            total = totals.setdefault(lang, np.zeros((1 << BITS) + len(scripts), dtype=np.int64))
            held = [(letters, n) for word, n in counts.items() if (letters := _letters(word))]
            for at in range(0, len(held), TOGETHER):
                part = held[at : at + TOGETHER]
                times = np.array([n for _, n in part], dtype=np.int64)
                kinds, starts = _features([x for x, _ in part])
                for places, features in kinds:
                    weight = times[np.searchsorted(starts, places, side="right") - 1]
                    total[: 1 << BITS] += np.bincount(features, weights=weight, minlength=1 << BITS).astype(np.int64)
            for letters, n in held:
                total[scripts[script_of(letters[0])]] += n
        words.clear()

    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words.setdefault(lang, Counter()).update(text.lower().split())
            if sum(map(len, words.values())) > 500_000:
                add()
    add()
    for lang, total in sorted(totals.items()):
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "feature", "n"])


class Model:
    """Log probabilities of features, and the languages of each script."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        names = sorted({x for _, x in _SCRIPTS})
        self.langs = sorted({r[0] for r in rows})
        counts = np.zeros((len(self.langs), (1 << BITS) + len(names)))
        number = {x: i for i, x in enumerate(self.langs)}
        for lang, feature, n in rows:
            counts[number[lang], feature] += n
        grams, scripts = counts[:, : 1 << BITS], counts[:, 1 << BITS :]
        self.log = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * (1 << BITS))).astype(np.float32).T if self.langs else np.zeros((1 << BITS, 0), np.float32)
        # a script belongs to a language that has more than a stray word of it
        total = np.maximum(scripts.sum(1, keepdims=True), 1)
        self.scripts = {x: scripts[:, i] / total[:, 0] > 0.001 for i, x in enumerate(names)}

    def words(self, letters: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of words for each language, the best 0, and whether any language has a word's script; if none, all are 0."""
        scores, known = np.zeros((len(letters), len(self.langs)), np.float32), np.zeros(len(letters), bool)
        for at in range(0, len(letters), TOGETHER):
            part = letters[at : at + TOGETHER]
            kinds, starts = _features(part)
            total = np.zeros((sum(map(len, part)) + 2 * len(part), len(self.langs)), np.float32)
            for places, features in kinds:
                total[places] += self.log[features]
            found = np.add.reduceat(total, starts, axis=0) / 2  # n-grams overlap: about two for each letter
            allowed = np.array([self.scripts[script_of(x[0])] for x in part])
            top = np.where(allowed, found, -np.inf).max(1)
            here = allowed.any(1)
            found = np.where(allowed, np.maximum(found - np.where(here, top, 0)[:, None], FLOOR), FLOOR)
            scores[at : at + TOGETHER] = np.where(here[:, None], found, 0)
            known[at : at + TOGETHER] = here
        return scores, known


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best labels of a batch of sequences; ``scores`` is (steps, languages, sequences), padded with zeros; labels are (steps, sequences)."""
    steps, langs, n = scores.shape
    best = scores[0].astype(np.float64)
    jumps, tops = np.zeros((steps, langs, n), dtype=bool), np.zeros((steps, n), dtype=np.int16)
    for t in range(1, steps):
        moved = best.max(0) - switch
        tops[t] = best.argmax(0)
        jumps[t] = moved > best
        best = np.maximum(best, moved)
        best += scores[t]
    out = np.zeros((steps, n), dtype=np.int16)
    at = best.argmax(0)
    rows = np.arange(n)
    for t in range(steps - 1, -1, -1):  # padding scores 0, so the last label holds from a sequence's end on
        out[t] = at
        at = np.where(jumps[t, at, rows], tops[t], at)
    return out


class _Words:
    """A bounded table of the words seen: scores, the number of letters, and that of letters in a known script. It stays with the broadcast model from task to task."""

    LIMIT = 200_000

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    @classmethod
    def of(cls, model: Model) -> _Words:
        if not hasattr(model, "table"):
            model.table = cls(model)
        claim("langid", model.table.clear)
        return model.table

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.langs)), np.float32)
        self.sizes = np.zeros(0, np.int64)
        self.known = np.zeros(0, bool)

    def learn(self, texts: list[list[str]]) -> None:
        fresh = list(set().union(*texts).difference(self.at))
        if len(self.at) + len(fresh) > self.LIMIT:
            self.clear()
            fresh = list(set().union(*texts))
        letters = [_letters(x) for x in fresh]
        full = [i for i, x in enumerate(letters) if x]
        scores, known = np.zeros((len(fresh), len(self.model.langs)), np.float32), np.zeros(len(fresh), bool)
        if full:
            scores[full], known[full] = self.model.words([letters[i] for i in full])
        before = len(self.at)
        self.at.update(zip(fresh, range(before, before + len(fresh))))
        self.scores, self.known = np.vstack([self.scores, scores]), np.concatenate([self.known, known])
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, letters), np.int64, len(letters))])


_Label = tuple[str, float, list[tuple[str, int, int]]]


def label(model: Model, words: _Words, texts: list[str | None], size: int = 1_000_000) -> list[_Label]:
    """(language, score, spans as language, first and end word) of each text; ``size`` bounds the padded words of a group."""
    out: list[_Label] = [("und", 0.0, [])] * len(texts)
    if not model.langs:
        return out
    split = [t.lower().split() if t else [] for t in texts]
    words.learn(split)
    held = [(i, np.fromiter(map(words.at.__getitem__, x), np.int64, len(x))) for i, x in enumerate(split) if x]
    held = sorted(((i, x) for i, x in held if words.sizes[x].any()), key=lambda r: len(r[1]))
    start, langs = 0, len(model.langs)
    while start < len(held):  # groups of similar length, of bounded padded size
        end = start + 1
        while end < len(held) and end - start < 512 and (end - start + 1) * len(held[end][1]) <= size:
            end += 1
        group = held[start:end]
        start, n = end, end - start
        lengths = np.array([len(x) for _, x in group])
        padded = np.zeros((lengths.max(), n), dtype=np.int64)
        for r, (_, x) in enumerate(group):
            padded[: len(x), r] = x
        inside = np.arange(lengths.max())[:, None] < lengths[None, :]
        labels = viterbi((words.scores[padded] * inside[:, :, None]).transpose(0, 2, 1))
        sizes = words.sizes[padded] * inside
        cell = np.arange(n)[None, :] * langs + labels
        shares = np.bincount(cell.ravel(), (sizes * words.known[padded]).ravel(), n * langs).reshape(n, langs)
        total, best = sizes.sum(0), shares.argmax(1)
        changed = (labels[1:] != labels[:-1]) & inside[1:]
        mixed = changed.any(0) if len(changed) else np.zeros(n, bool)
        for r, (i, x) in enumerate(group):
            k = int(best[r])
            cuts = [0, *(np.flatnonzero(changed[:, r]) + 1).tolist(), len(x)] if mixed[r] else [0, len(x)]
            out[i] = (model.langs[k], float(shares[r, k] / total[r]), [(model.langs[labels[a, r]], a, b) for a, b in zip(cuts, cuts[1:])])
    return out


def spans(model: Model, text: str) -> list[tuple[str, int, int]]:
    """(language, first word, end word) of a text's labelled spans."""
    return label(model, _Words(model), [text])[0][2]


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text, lang) that aren't held out and have a language."""
    rows = plain(docs, "doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))).filter("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not counts:
        return Model([])
    share = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))])
    place = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = rows.filter(place < F.element_at(share, F.col("lang"))).select("text", "lang")
    grouped = chosen.mapInArrow(_counted, "lang string, feature int, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    return Model([tuple(r) for r in grouped.collect()])  # at most 2**BITS rows for each language, and its scripts


_SPANS = "array<struct<lang:string,first_word:int,end_word:int>>"


def languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans (lang, first_word, end_word) for every row of ``docs`` (doc_id, text, lang)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, per_language))
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32())]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words.of(model.value)
        for batch in batches:
            for part in slices(batch, 2, 4096):
                found = label(model.value, words, part.column(2).to_pylist())
                spans = pa.array([[{"lang": a, "first_word": b, "end_word": c} for a, b, c in x] for _, _, x in found], kind)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x for x, _, _ in found], pa.string()), pa.array([x for _, x, _ in found], pa.float64()), spans], names=["doc_id", "held_out", "lang_pred", "score", "spans"])

    rows = plain(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(predict, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, spans {_SPANS}")
