"""Words of a text and hashes of words and shingles, in numpy.

A word is a run of bytes other than [\\x20\\x09-\\x0D] with A-Z lower-cased; bytes.lower() and bytes.split() do just that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from tallyloom.llm.common import claim

SHINGLE = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


class _Hashes(dict):
    """word -> 64-bit hash; two generations bound the memory."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit, self.old = limit, {}

    def __missing__(self, word: bytes) -> int:
        found = self.old.get(word)
        if found is None:
            found = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


    def let_go(self) -> None:
        self.clear()
        self.old = {}


_HASHES = _Hashes()


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def folded_words(text: bytes | None) -> list[bytes]:
    """Words with all letters lower-cased, not A-Z alone."""
    return words_of(text if not text or text.isascii() else text.decode().lower().encode())


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit words."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order; of fewer words, one hash of the whole sequence."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(n, size)
    out = np.full(n - width + 1, width, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = (out ^ (hashes[i : i + len(out)] * _ODD[i % 7])) * _ODD[(i + 1) % 7]
            out ^= out >> np.uint64(29)
        return mix(out)


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(word_hashes(words_of(text)), size))


def hashing() -> None:
    """At a task's start, before words are hashed."""
    claim("words", _HASHES.let_go)


def texts(column: pa.Array) -> Iterator[bytes | None]:
    """A string column's values as UTF-8 bytes."""
    for x in pc.cast(column, pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield x.as_py()
