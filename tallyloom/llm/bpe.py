"""Byte-level BPE encoding and decoding in linear time.

Bytes are mapped to Latin-1 characters, so that a character automaton matches byte tokens. One scan over the reversed
piece gives the longest token that starts at each byte. Encoding takes longest matches and backtracks to shorter prefixes
whenever a token can't follow the one before it: two tokens are compatible if merging their joined bytes by rank gives
these two again, which is memoised. A sequence of pairwise compatible tokens is the one that the merges by rank produce,
so each byte position is given up at most once and the work is linear in the text.

Defined cases: a null text counts as empty, an empty text has no ids. Strings of special tokens are ordinary text. Rows
are independent: null ids, repeated rows and extra columns (kept) don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyloom.llm.common import claim, plain, slices

DEFAULT_RANKS = "byte_bpe_multi_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Plain BPE: join the adjacent pair of lowest rank until no pair has one. For short pieces and as the yardstick."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best == 1 << 62:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Bpe:
    """A codec for one table of ranks and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        from tallyloom.llm.pretoken import PieceEncoder

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of: dict[int, bytes] = {rank: token for token, rank in ranks.items()}
        automaton = ahocorasick.Automaton()
        for token in ranks:
            automaton.add_word(token[::-1].decode("latin-1"), token)
        automaton.make_automaton()
        self.automaton = automaton
        self.shorter: dict[bytes, bytes | None] = {}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.whole: dict[bytes, bool] = {}
        # the cuts of PieceEncoder hold for the public pattern; with another, a text is encoded as a whole
        self.pieces = PieceEncoder(self._piece, lambda word: array("I", self.encode_bytes(word.encode("utf-8"))).tobytes()) if pattern == public_pattern() else None
        self.encode_text = self.pieces or self._piece

    def let_go(self) -> None:
        """Forget what the encoding of earlier texts has left."""
        for known in (self.shorter, self.fits, self.whole):
            known.clear()
        if self.pieces:
            self.pieces.let_go()

    def _prefix(self, token: bytes) -> bytes | None:
        """The longest token that is a proper prefix of this one."""
        if token not in self.shorter:
            self.shorter[token] = next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), None)
        return self.shorter[token]

    def _reachable(self, token: bytes) -> bool:
        if token not in self.whole:
            self.whole[token] = merge_by_rank(token, self.ranks) == [token]
        return self.whole[token]

    def _compatible(self, a: bytes, b: bytes) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 300_000:
                self.fits.clear()
            known = self.fits[a, b] = merge_by_rank(a + b, self.ranks) == [a, b]
        return known

    def _longest(self, piece: bytes) -> list[bytes | None]:
        n, starts = len(piece), [None] * len(piece)
        for end, token in self.automaton.iter(piece[::-1].decode("latin-1")):
            at = n - 1 - end
            if starts[at] is None or len(token) > len(starts[at]):
                starts[at] = token
        return starts

    def encode_bytes(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        if (rank := self.ranks.get(piece)) is not None:
            return [rank]
        n, starts = len(piece), self._longest(piece)
        alive = bytearray(b"\1") * (n + 1)
        done: list[bytes] = []
        at, token = 0, starts[0]
        while at < n:
            while token is not None:
                end = at + len(token)
                if alive[end] and self._reachable(token) and (not done or self._compatible(done[-1], token)):
                    break
                token = self._prefix(token)
            if token is not None:
                done.append(token)
                at += len(token)
                token = starts[at] if at < n else None
            else:  # nothing can start here after what stands before: give this position up
                if not done:
                    raise ValueError("the ranks lack single bytes of this text")
                alive[at] = 0
                token = done.pop()
                at -= len(token)
        return [self.ranks[x] for x in done]

    def _piece(self, text: str) -> bytes:
        ids: list[int] = []
        for match in self.pattern.findall(text):
            ids += self.encode_bytes(match.encode("utf-8"))
        return array("I", ids).tobytes()

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_text(text), dtype="<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


_CODECS: dict[tuple[str, str], Bpe] = {}


def codec(path: str, pattern: str) -> Bpe:
    """The codec of a rank file, built once in each Python worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Bpe(load_ranks(path), pattern)
    claim("bpe", _CODECS[path, pattern].let_go)
    return _CODECS[path, pattern]


def encode_table(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, digests_only: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, ...) with token_ids and decoded; with ``digests_only`` the contract's four columns alone."""
    import public_tokenizers

    path, pattern = ranks_path or public_tokenizers.path(DEFAULT_RANKS), pattern or public_tokenizers.PATTERN
    if digests_only:
        def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bpe = codec(path, pattern)
            for part in (part for batch in batches for part in slices(batch, 1)):
                rows = []
                for text in part.column(1):
                    packed = bpe.encode_text(text.as_py() or "")
                    ids = np.frombuffer(packed, dtype="<u4").tolist()
                    rows.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
                n, ids_sha, text_sha = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        docs = plain(docs, "doc_id", "text")
        return docs.mapInArrow(digests, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

    keep = [c for c in docs.columns if c not in ("token_ids", "decoded")]
    docs = plain(docs, *keep)
    at = keep.index("text")
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, at, 256, 1 << 20):  # ids of a few texts at a time
                packed = [bpe.encode_text(x.as_py() or "") for x in part.column(at)]
                ids = [np.frombuffer(x, dtype="<u4") for x in packed]
                flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                decoded = [bpe.decode(x.tolist()).decode("utf-8", "replace") for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(decoded, pa.string())], names=[*keep, "token_ids", "decoded"])

    return docs.mapInArrow(codes, schema)
