"""Personal data: base patterns, and a character BiLSTM-CRF that adds spans.

Base spans of e-mail addresses, IP addresses, card and phone numbers come from patterns with checks. The model
labels each character B/I of a kind or O. It is trained in numpy on labelled spans: windows of at most ``SAMPLE_DOCS``
documents of the corpus with their base spans, and generated lines with variants that the patterns don't know
(spelled-out e-mail signs, phone numbers without a plus, spaced-out IP addresses).

Windows of ``WIDTH`` characters overlap by half and cover every stretch within ``AROUND`` characters of a digit, an @, a
spelled-out "at" or "[at]" or a "dot", and the words that a stretch's ends fall on as a whole (letters up to U+024F); a span that ``_plausible``
lets pass holds one of these. Each window is decoded by Viterbi. Spans come from each window, and from the middles of a stretch's windows
joined, for those that its windows cut; a span that a stretch's end cuts is decoded again in a wider stretch. The spans of all windows of a text are then reconciled together: base spans stand, and of the others
the set without overlaps of the highest total confidence is taken, by dynamic programming over the whole text.

Defined cases: a null or empty text has no spans. Rows are independent, so null ids, repeated rows and an empty table
need no care; without any base span in the sample the model learns from generated lines alone. Offsets are code points, ends
are exclusive. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.common import plain, slices

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, WINDOWS_A_DOC = 1500, 8
WIDTH, AROUND = 64, 24
EMBED, HIDDEN, STEPS, BATCH = 12, 24, 400, 48
CONFIDENCE = 0.6
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
#: What an e-mail address is spelled out with; each of them opens a window, like a digit or an @.
_SPELLED = (" at ", "[at]", " dot ")
_WORD = re.compile("[!-\u024f]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = []
    at, taken = text.find("@"), 0
    while at >= 0:  # each @ by itself, so that long runs cost no more than their length
        following = at + 1
        local = text[taken:at]
        start = taken + len(local.rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            following = m.end()
        taken = following
        at = text.find("@", following)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_DIGIT.findall(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def _found(text: str, sign: str) -> Iterator[tuple[int, int]]:
    at = text.find(sign)
    while at >= 0:
        yield at, at + len(sign)
        at = text.find(sign, at + 1)


def stretches_of(text: str) -> list[tuple[int, int]]:
    """The text around digits, @ signs and their spelled-out forms, without overlaps."""
    out: list[list[int]] = []
    for start, end in sorted([*(m.span() for m in _TRIGGER.finditer(text)), *(x for sign in _SPELLED for x in _found(text, sign))]):
        low, high = max(0, start - AROUND), min(len(text), end + AROUND)
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    whole: list[tuple[int, int]] = []
    for low, high in out:  # whole words, and a character more, so that a span may end with its word
        before = whole[-1][1] if whole else 0
        if high <= before:
            continue
        while low > before and "!" <= text[low - 1] <= "\u024f":
            low -= 1
        low = max(before, low - 1)
        high = min(len(text), _WORD.match(text, high).end() + 1)
        if whole and low <= before:
            whole[-1] = (whole[-1][0], high)
        else:
            whole.append((max(0, low), high))
    return whole


def _windows(low: int, high: int) -> Iterator[tuple[int, int]]:
    at = low
    while True:
        yield at, min(at + WIDTH, high)
        if at + WIDTH >= high:
            return
        at += WIDTH // 2


def windows_of(text: str) -> list[tuple[int, int]]:
    """Overlapping windows over all stretches."""
    return [x for low, high in stretches_of(text) for x in _windows(low, high)]


def encode(text: str) -> np.ndarray:
    """Character numbers: printable ASCII by itself, white space, other letters, the rest; 0 is padding."""
    return np.array([ord(c) - 30 if 32 < ord(c) < 127 else 1 if c.isspace() else 97 if c.isalpha() else 98 for c in text], dtype=np.int64)


def tags_of(start: int, end: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    tags = np.zeros(end - start, dtype=np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        low, high = max(a, start), min(b, end)
        if low < high:
            tags[low - start : high - start] = k + 1
            if a >= start:
                tags[a - start] = k
    return tags


def generated(rng: np.random.Generator, n: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Lines with one labelled span or a number of no kind."""
    word = lambda: "".join(rng.choice(list("abcdefghilmnoprstuvéüñ"), rng.integers(2, 9)))
    number = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    out = []
    for _ in range(n):
        name, host = f"{word()}.{number(2)}".encode("ascii", "ignore").decode(), f"mail{number(1)}"
        if rng.random() < 0.5:  # without digits
            name, host = (x.encode("ascii", "ignore").decode() or "jo" for x in (f"{word()}.{word()}" if rng.random() < 0.5 else word(), word()))
        end = str(rng.choice(["example.com", "com", "org", "net"]))
        spelled = end.replace(".", " dot ")
        made = [
            ("email", f"{name}@{host}.{end}"), ("email", f"{name} at {host} dot {spelled}"), ("email", f"{name}[at]{host}.{end}"), ("", f"{word()} at {word()} {word()}"), ("", f"{word()} at {word()}. {word()}"), ("phone", f"+{number(1)} ({number(3)}) {number(3)}-{number(4)}"), ("phone", f"({number(3)}) {number(3)}-{number(4)}"),
            ("phone", f"+{number(2)} {number(3)} {number(3)} {number(3)}"), ("ip", ".".join(str(x) for x in rng.integers(0, 256, 4))), ("ip", " . ".join(str(x) for x in rng.integers(0, 256, 4))), ("card", " ".join(number(4) for _ in range(4))), ("card", "-".join(number(4) for _ in range(4))), ("card", number(16)),
            ("", number(int(rng.integers(1, 6)))), ("", f"{number(1)}.{number(2)}"), ("", f"v{number(1)}.{number(1)}"), ("", f"{number(4)}-{number(2)}-{number(2)}"), ("", f"@{word()}"),
        ]
        kind, value = made[int(rng.integers(len(made)))]
        before = " ".join(word() for _ in range(rng.integers(0, 4)))
        line = f"{before} {value}".strip() if before else value
        at = len(line) - len(value)
        line += rng.choice([" ", ". ", ", ", "\n"]) + " ".join(word() for _ in range(rng.integers(0, 4)))
        out.append((line[:WIDTH], [(kind, at, at + len(value))] if kind and at + len(value) <= WIDTH else []))
    return out


class BiLstmCrf:
    """Forward and backward LSTMs over characters, a linear layer and CRF transitions."""

    def __init__(self, rng: np.random.Generator):
        g = lambda *shape: (rng.standard_normal(shape) * (1 / shape[0]) ** 0.5).astype(np.float32)
        self.p = {"emb": (rng.standard_normal((99, EMBED)) * 0.5).astype(np.float32), "out": g(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": g(EMBED, 4 * HIDDEN), f"h{d}": g(HIDDEN, 4 * HIDDEN), f"c{d}": np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)}

    def _lstm(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """States of one direction; gates in the order input, forget, output, cell."""
        n, steps, _ = x.shape
        drive = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, trace = np.zeros((n, steps, HIDDEN), np.float32), {}
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = drive[:, t] + h @ self.p[f"h{d}"]
            gates = 1 / (1 + np.exp(-a[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            z = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            new_c = (f * c + i * z) * m
            th = np.tanh(new_c)
            new_h = o * th * m
            if keep:
                trace[t] = (h, c, i, f, o, z, th, m)
            h, c = new_h, new_c
            out[:, t] = h
        return out, trace

    def emissions(self, chars: np.ndarray, keep: bool = False):
        mask = (chars > 0).astype(np.float32)
        x = self.p["emb"][chars]
        (hf, tf), (hb, tb) = self._lstm(x, mask, "f", keep), self._lstm(x, mask, "b", keep)
        h = np.concatenate([hf, hb], axis=2)
        return h @ self.p["out"] + self.p["bias"], (x, mask, h, tf, tb)

    @staticmethod
    def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis, keepdims=True)
        return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)

    def marginals(self, e: np.ndarray, mask: np.ndarray):
        """Log forward and backward messages and the log normaliser."""
        n, steps, k = e.shape
        move = self.p["move"]
        fwd, bwd = np.zeros((n, steps, k)), np.zeros((n, steps, k))
        fwd[:, 0] = e[:, 0]
        for t in range(1, steps):
            step = self._log_sum(fwd[:, t - 1, :, None] + move[None], 1) + e[:, t]
            fwd[:, t] = np.where(mask[:, t, None] > 0, step, fwd[:, t - 1])
        for t in range(steps - 2, -1, -1):
            step = self._log_sum(move[None] + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            bwd[:, t] = np.where(mask[:, t + 1, None] > 0, step, bwd[:, t + 1])
        return fwd, bwd, self._log_sum(fwd[:, -1], 1)

    def gradients(self, chars: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        e, (x, mask, h, tf, tb) = self.emissions(chars, True)
        fwd, bwd, z = self.marginals(e, mask)
        n, steps, k = e.shape
        share = np.exp(fwd + bwd - z[:, None, None])
        de = ((share - np.eye(k)[tags]) * mask[:, :, None] / n).astype(np.float32)
        dmove = np.zeros((k, k))
        for t in range(1, steps):
            pair = np.exp(fwd[:, t - 1, :, None] + self.p["move"][None] + (e[:, t] + bwd[:, t])[:, None, :] - z[:, None, None]) * mask[:, t, None, None]
            dmove += pair.sum(0) / n
            np.subtract.at(dmove, (tags[:, t - 1], tags[:, t]), mask[:, t] / n)
        g = {"move": dmove.astype(np.float32), "out": np.einsum("nth,ntk->hk", h, de), "bias": de.sum((0, 1)), "emb": np.zeros_like(self.p["emb"])}
        dh = de @ self.p["out"].T
        dx = np.zeros_like(x)
        for d, trace, part in (("f", tf, dh[:, :, :HIDDEN]), ("b", tb, dh[:, :, HIDDEN:])):
            wx, wh, wc = (np.zeros_like(self.p[f"{a}{d}"]) for a in "xhc")
            back_h, back_c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                h0, c0, i, f, o, zt, th, m = trace[t]
                gh = (part[:, t] + back_h) * m
                gc = (gh * o * (1 - th * th) + back_c) * m
                da = np.concatenate([gc * zt * i * (1 - i), gc * c0 * f * (1 - f), gh * th * o * (1 - o), gc * i * (1 - zt * zt)], axis=1)
                wx += x[:, t].T @ da
                wh += h0.T @ da
                wc += da.sum(0)
                dx[:, t] += da @ self.p[f"x{d}"].T
                back_h, back_c = da @ self.p[f"h{d}"].T, gc * f
            g |= {f"x{d}": wx, f"h{d}": wh, f"c{d}": wc}
        np.add.at(g["emb"], chars.ravel(), dx.reshape(-1, EMBED))
        return g

    def fit(self, windows: list[tuple[np.ndarray, np.ndarray]], rng: np.random.Generator, steps: int = STEPS) -> None:
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for s in range(1, steps + 1):
            batch = [windows[i] for i in rng.integers(0, len(windows), BATCH)]
            chars, tags = pad([c for c, _ in batch]), pad([t for _, t in batch])
            for k, grad in self.gradients(chars, tags).items():
                grad = np.clip(grad, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad * grad
                self.p[k] -= (0.015 * min(1.0, 2 - 2 * s / steps + 0.05) * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-8)).astype(np.float32)

    def decode(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi tags and each character's posterior of its tag."""
        e, (_, mask, *_rest) = self.emissions(chars)
        n, steps, k = e.shape
        best, came = e[:, 0].astype(np.float64), np.zeros((n, steps, k), np.int16)
        for t in range(1, steps):
            paths = best[:, :, None] + self.p["move"][None]
            came[:, t] = paths.argmax(1)
            step = paths.max(1) + e[:, t]
            best = np.where(mask[:, t, None] > 0, step, best)
            came[:, t] = np.where(mask[:, t, None] > 0, came[:, t], np.arange(k)[None, :])
        tags = np.zeros((n, steps), np.int64)
        tags[:, -1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = came[np.arange(n), t, tags[:, t]]
        fwd, bwd, z = self.marginals(e, mask)
        share = np.take_along_axis(fwd + bwd, tags[:, :, None], 2)[:, :, 0] - z[:, None]
        return tags, np.exp(np.minimum(share, 0))


def pad(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows))), dtype=np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def _plausible(kind: str, value: str) -> bool:
    """What a span of a kind must hold at least."""
    digits = len(_DIGIT.findall(value))
    if kind == "email":
        return ("@" in value or " at " in value or "[at]" in value) and ("." in value or " dot " in value)
    return {"ip": 4 <= digits <= 12 and value.count(".") == 3, "card": 14 <= digits <= 19 and luhn("".join(_DIGIT.findall(value))), "phone": 7 <= digits <= 15}[kind]


def _runs(tags: np.ndarray, sure: np.ndarray) -> Iterator[tuple[str, int, int, float]]:
    """(kind, start, end, confidence) of each labelled run."""
    kind = np.where(tags > 0, (tags - 1) // 2, -1)
    before = np.concatenate([[-1], kind[:-1]])
    starts = (kind >= 0) & ((tags % 2 == 1) | (kind != before))
    for first in np.flatnonzero(starts):
        rest = (kind[first + 1 :] != kind[first]) | starts[first + 1 :]
        end = first + 1 + (int(rest.argmax()) if rest.any() else len(rest))
        yield KINDS[kind[first]], int(first), end, float(sure[first:end].min())


def model_spans(model: BiLstmCrf, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
    """Spans of each text by its windows, with confidences, before they are reconciled."""
    out: list[dict] = [{} for _ in texts]

    def add(i: int, kind: str, a: int, b: int, conf: float) -> None:
        if conf >= CONFIDENCE and _plausible(kind, texts[i][a:b]):
            out[i][kind, a, b] = max(conf, out[i].get((kind, a, b), 0.0))

    # stretches with the part that they were widened for, at first all of them
    left = [(i, low, high, low, high) for i, t in enumerate(texts) for low, high in stretches_of(t)]
    while left:
        held = [(k, a, b) for k, (_, low, high, _, _) in enumerate(left) for a, b in _windows(low, high)]
        wider = []
        for at in range(0, len(held), 512):
            part = held[at : at + 512]
            decoded = model.decode(pad([encode(texts[left[k][0]][a:b]) for k, a, b in part]))
            for (k, a, b), tags, sure in zip(part, *decoded):
                i, low, high, p, q = left[k]
                tags, sure = tags[: b - a], sure[: b - a]
                if a == low:
                    all_tags, all_sure = np.zeros(high - low, np.int64), np.ones(high - low)
                middle = 0 if a == low else WIDTH // 4
                all_tags[a - low + middle : b - low], all_sure[a - low + middle : b - low] = tags[middle:], sure[middle:]
                if tags.any() and (a > low or b < high):
                    for kind, x, y, conf in _runs(tags, sure):
                        if not ((x == 0 and a > 0) or (y == b - a and b < len(texts[i]))):
                            add(i, kind, a + x, a + y, conf)
                if b == high and all_tags.any():  # the stretch as a whole: each window's middle
                    for kind, x, y, conf in _runs(all_tags, all_sure):
                        x, y = low + x, low + y
                        if y <= p or x >= q:
                            continue
                        if not ((x == low and low > 0) or (y == high and high < len(texts[i]))):
                            add(i, kind, x, y, conf)
                        elif conf >= CONFIDENCE:  # more text than before on both sides, at least as much as the run is long
                            more = WIDTH + y - x
                            wider.append((i, max(0, x - more), min(len(texts[i]), y + more), x, y))
        left = wider
    return [[(*k, c) for k, c in sorted(x.items())] for x in out]


def reconciled(base: list[tuple[str, int, int]], extra: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int]]:
    """Base spans and the best set of the others that overlaps neither them nor itself."""
    import bisect

    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    highest = np.maximum.accumulate([b for _, b in taken]).tolist()
    free = sorted((b, a, k, c) for k, a, b, c in extra if not ((i := bisect.bisect_left(starts, b)) and highest[i - 1] > a))
    best: list[tuple[float, list]] = [(0.0, None)]
    ends = [x[0] for x in free]
    for n, (_b, a, _k, c) in enumerate(free):
        before = bisect.bisect_right(ends, a, 0, n)
        with_it = best[before][0] + c
        best.append((with_it, (n, before)) if with_it > best[n][0] else (best[n][0], best[n][1]))
    chosen, at = [], len(free)
    step = best[at][1]
    while step is not None:
        n, before = step
        b, a, k, _ = free[n]
        chosen.append((k, a, b))
        step = best[before][1]
    return sorted([*base, *chosen], key=lambda s: (KINDS.index(s[0]), s[1]))


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of a document with their tags; an even choice of them where there are many."""
    for batch in batches:
        chars, tags = [], []
        for text in batch.column(1).to_pylist():
            spans, found = base_spans(text), windows_of(text)
            for a, b in found[:: max(1, -(-len(found) // WINDOWS_A_DOC))]:
                chars.append(encode(text[a:b]).astype(np.int8).tobytes())
                tags.append(tags_of(a, b, spans).astype(np.int8).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(chars, pa.binary()), pa.array(tags, pa.binary())], names=["chars", "tags"])


def train(docs: DataFrame, sample: int = SAMPLE_DOCS) -> BiLstmCrf:
    rows = plain(docs, "doc_id", "text").filter(F.col("text").rlike("[0-9@]"))
    chosen = F.broadcast(rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # of rows that repeat an id, one text; so at most ``sample`` texts give windows to the driver
    texts = rows.join(chosen, "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("doc_id", "x.text")
    got = sorted((bytes(r.chars), bytes(r.tags)) for r in texts.mapInArrow(_labelled, "chars binary, tags binary").collect())
    rng = np.random.default_rng(7)
    real = [(np.frombuffer(c, np.int8).astype(np.int64), np.frombuffer(t, np.int8).astype(np.int64)) for c, t in sorted(set(got))]
    made = [(encode(x), tags_of(0, len(x), s)) for x, s in generated(rng, 2000)]
    model = BiLstmCrf(rng)
    model.fit([*real, *made] if not real else [*real, *(made * max(1, len(real) // len(made)))], rng)
    return model


def personal_data(docs: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and spans for every row of ``docs`` (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, sample))
    joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 2048):
                texts = [x or "" for x in part.column(1).to_pylist()]
                base = [base_spans(x) for x in texts]
                extra = model_spans(model.value, texts)
                counts = [pa.array([sum(s[0] == kind for s in b) for b in base], pa.int64()) for kind in KINDS]
                shas = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
                spans = [joined(reconciled(b, e)) for b, e in zip(base, extra)]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(shas, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = plain(docs, "doc_id", "text")
    return rows.mapInArrow(find, f"doc_id {dict(rows.dtypes)['doc_id']}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
