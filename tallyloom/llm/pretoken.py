"""Splitting texts into pieces that byte-level BPE encodes independently, with a bounded cache of encoded pieces.

The public pattern never lets a token run from a non-space character across a following single space, nor across
a single newline between non-space characters. So a text may be cut before such a space and around such a newline, and each
piece encoded by itself. Most texts cut into a few million distinct pieces, each encoded once and then looked up.

``BatchEncoder`` cuts a whole batch's bytes at once and looks each distinct piece of the batch up once. Its cuts need no look at
what stands before: white space that ends in a space or a newline, followed by another character, never joins this last one
(a space belongs to what follows, a newline stands alone), and no token runs from a letter on to a sign or a digit.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

_CUT = re.compile(r"(?<=\S) (?=\S)")
_LINE = re.compile(r"(?<=\S)\n(?=\S)")
_EDGE = re.compile(r"^\s|\s$")


#: Pieces whose ids are put in their places at a time.
GATHERED = 1 << 16
#: Bytes by what they are for a cut: the start of a character that certainly isn't white space, an ASCII letter, another visible ASCII character,
#: the first of the two bytes of a letter (U+00C0 to U+027F but for two signs, U+0400 to U+047F).
_SOLID, _LETTER, _SIGN, _LEAD = np.zeros((4, 256), bool)
_SOLID[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SIGN[0x21:0x7F] = ~_LETTER[0x21:0x7F]
_LEAD[[*range(0xC3, 0xCA), 0xD0, 0xD1]] = True


def cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin: ``data`` are the texts' UTF-8 bytes one after the other, ``ends`` is 0 and each text's end."""
    start, followed = np.zeros(len(data), bool), np.zeros(len(data), bool)
    followed[:-1] = _SOLID[data[1:]]
    filled = ends[:-1] < ends[1:]
    followed[ends[1:][filled] - 1] = False
    line = (data == 0x0A) & followed
    start |= line | (data == 0x20) & followed
    start[1:] |= line[:-1]
    letter = _LETTER[data]  # its last byte
    letter[1:] |= _LEAD[data[:-1]] & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    start[1:] |= letter[:-1] & _SIGN[data[1:]]
    start[ends[:-1][filled]] = True
    return np.flatnonzero(start)


class Unclean(Exception):
    """A piece with white space at an edge: the text has to be cut the careful way."""


class _Pieces(dict):
    """piece -> packed ids; two generations bound the memory."""

    def __init__(self, encode: Callable[[str], bytes], prefix: str, strict: bool, limit: int, word: Callable[[str], bytes] | None = None):
        super().__init__()
        self.encode, self.prefix, self.strict, self.limit, self.word, self.old = encode, prefix, strict, limit, word or encode, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            if self.strict and piece.isalpha():  # most of what is new: one match, with no space in it
                found = self.word(self.prefix + piece)
            elif self.strict and (not piece or piece[0].isspace() or piece[-1].isspace()):
                raise Unclean
            else:
                found = self.encode(self.prefix + piece)
        if len(piece) <= 64:  # a long piece is hardly seen twice
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


class PieceEncoder:
    """Encodes texts to packed little-endian uint32 ids through ``encode_piece(str) -> bytes``, which must be exact.

    ``encode_word`` does the same for letters alone, after a space or not: these are one match of the pattern.
    """

    def __init__(self, encode_piece: Callable[[str], bytes], encode_word: Callable[[str], bytes] | None = None, limit: int = 400_000):
        self.encode_piece, self.encode_word = encode_piece, encode_word or encode_piece
        self.head = _Pieces(self._inner, "", True, limit // 4, self.encode_word)
        self.rest = _Pieces(self._inner, " ", True, limit, self.encode_word)
        self.marks = _Pieces(encode_piece, "", False, 10_000)

    def let_go(self) -> None:
        for pieces in (self.head, self.rest, self.marks):
            pieces.clear()
            pieces.old = {}

    def _inner(self, piece: str) -> bytes:
        """A piece with its space: cut at newlines, and before one closing sign, which is a match of its own after a letter."""
        if "\n" in piece:
            first, *others = _LINE.split(piece)
            if others:
                line = self.marks["\n"]
                before = self.rest[first[1:]] if first[0] == " " else self.head[first]
                return before + b"".join(line + self.head[x] for x in others)
        if len(piece) > 2 and piece[-1] in ",.;:!?)" and piece[-2].isalpha():
            core = self.rest[piece[1:-1]] if piece[0] == " " else self.head[piece[:-1]]
            return core + self.marks[piece[-1]]
        return self.encode_piece(piece)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        pieces = text.split(" ")
        try:
            return self.head[pieces[0]] + b"".join(map(self.rest.__getitem__, pieces[1:]))
        except Unclean:
            first, *others = _CUT.split(text)
            return self._careful(first, "") + b"".join(self._careful(x, " ") for x in others)

    def _careful(self, piece: str, prefix: str) -> bytes:
        if not piece or _EDGE.search(piece):
            return self.encode_piece(prefix + piece)
        return self.rest[piece] if prefix else self.head[piece]


class BatchEncoder:
    """Encodes batches of texts to ids through ``encode_piece(bytes) -> packed little-endian uint32 ids``, which must be exact."""

    def __init__(self, encode_piece: Callable[[bytes], bytes], limit: int = 400_000):
        self.pieces = _Pieces(encode_piece, b"", False, limit)

    def let_go(self) -> None:
        self.pieces.clear()
        self.pieces.old = {}

    def __call__(self, texts: pa.Array, tails: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``texts`` (no nulls), each followed by the packed ids of its tail, one after the other; and how many each has."""
        ends = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        at, ends = int(ends[0]), ends - ends[0]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at : at + int(ends[-1])]
        starts = cuts(data, ends)
        offsets = np.append(starts, len(data))
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        packed = list(map(self.pieces.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))

        places = {tail: len(packed) + i for i, tail in enumerate(dict.fromkeys(tails))}
        packed += places
        bounds = np.searchsorted(starts, ends)  # a text's pieces, then its tail
        which = np.insert(coded.indices.to_numpy().astype(np.int64), bounds[1:], [places[x] for x in tails])
        bounds += np.arange(len(bounds))
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) >> 2
        counts, first = sizes[which], np.cumsum(sizes) - sizes
        before = np.concatenate([[0], np.cumsum(counts)])
        ids, out = np.frombuffer(b"".join(packed), "<i4"), np.empty(int(before[-1]), "<i4")
        for a in range(0, len(which), GATHERED):
            part = slice(a, a + GATHERED)
            begin, end = before[a], before[min(a + GATHERED, len(which))]
            out[begin:end] = ids[np.repeat(first[which[part]] - before[:-1][part], counts[part]) + np.arange(begin, end)]
        return out, np.diff(before[bounds])
