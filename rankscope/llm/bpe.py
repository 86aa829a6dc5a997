"""Byte-level BPE encoding in linear time, and decoding.

Tokens are bytes mapped to Latin-1 characters and put in an Aho-Corasick
automaton, whose matches give the longest token at each place of a piece.  The
encoder takes the longest token that is compatible with the one before it and
backtracks where none is.  Two adjacent tokens are compatible if merging the
bytes of both gives these two tokens again; a sequence whose neighbours are all
compatible is the one that the merges give.  Whether a merge would cross the
border is seen from the tokens that end, and begin, at the border while both
sides are merged, in the order of ranks.  Compatibilities and short pieces are
memoised per worker, in tables of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankscope.llm.common import numbered

PIECES = 1 << 18
PAIRS = 1 << 19
#: Pieces with more bytes of ids are not memoised.
PIECE_BYTES = 64


class Codec:
    """``ranks``: token bytes -> id; ``pattern`` cuts a text into pieces that are encoded separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.size = {i: len(b) for b, i in ranks.items()}
        self.prefix: dict[int, int] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.edges: dict[int, tuple[list[bytes], list[bytes]] | None] = {}

    def borders(self, token: int) -> tuple[list[bytes], list[bytes]] | None:
        """The parts that begin, and those that end, ``token`` while it is merged, shortest first.

        None if the merges of its bytes don't give the token.
        """
        if token not in self.edges:
            data = self.bytes_of[token]
            parts = [data[k:k + 1] for k in range(len(data))]
            first, last = [parts[0]], [parts[-1]]
            while len(parts) > 1:
                rank, k = min((self.ranks.get(a + b, 1 << 40), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank == 1 << 40:
                    break
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
                if k == 0:
                    first.append(parts[0])
                if k == len(parts) - 1:
                    last.append(parts[-1])
            self.edges[token] = (first, last) if len(parts) == 1 else None
        return self.edges[token]

    def compatible(self, left: int, right: int) -> bool:
        """True if the merges of both tokens' bytes give just these two (``left`` -1: of the right one alone)."""
        if left < 0:
            return self.borders(right) is not None
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.borders(right) is not None and not self._crossed(
                self.borders(left)[1], self.borders(right)[0])
        return known

    def _crossed(self, ends: list[bytes], begins: list[bytes]) -> bool:
        """True if a merge over the border comes before the merges that take its two parts.

        Parts grow in the order of their ranks; of equal ranks the left one merges first.
        """
        never = 1 << 40
        rank, i, j = self.ranks, 0, 0
        while True:
            left = rank[ends[i + 1]] if i + 1 < len(ends) else never
            right = rank[begins[j + 1]] if j + 1 < len(begins) else never
            over = rank.get(ends[i] + begins[j], never)
            if over < left and over <= right and over < never:
                return True
            if left == right == never:
                return False
            if left <= right:
                i += 1
            else:
                j += 1

    def longest(self, text: str, at: int) -> int:
        """The longest token of a Latin-1 text that starts at ``at``."""
        for _, token in self.automaton.iter_long(text, at):
            return token
        raise ValueError("the ranks lack a byte of the text")

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``, or -1."""
        known = self.prefix.get(token)
        if known is None:
            data = self.bytes_of[token]
            known = self.prefix[token] = next(
                (self.ranks[data[:k]] for k in range(len(data) - 1, 0, -1) if data[:k] in self.ranks), -1)
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        text, compatible, size = data.decode("latin-1"), self.compatible, self.size
        # Most pieces are a chain of longest matches.
        tokens = [token for _, token in self.automaton.iter_long(text)]
        good, before = 0, -1
        for token in tokens:
            if not compatible(before, token):
                break
            good, before = good + 1, token
        if good == len(tokens) and sum(map(size.__getitem__, tokens)) == len(data):
            return tokens
        # From the first incompatible one on, try shorter tokens, and go back where none is left.
        dead = bytearray(len(data) + 1)
        tokens = tokens[:good]
        at = sum(map(size.__getitem__, tokens))
        token = self.longest(text, at)
        while True:
            before = tokens[-1] if tokens else -1
            while token >= 0 and (dead[at + size[token]] or not compatible(before, token)):
                token = self.shorter(token)
            if token >= 0:
                tokens.append(token)
                at += size[token]
                if at == len(data):
                    return tokens
                token = self.longest(text, at)
            elif tokens:
                dead[at] = 1
                token = tokens.pop()
                at -= size[token]
                token = self.shorter(token)
            else:
                raise ValueError("no sequence of tokens gives the piece")

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out, known = [], self.pieces
        for piece in self.find(text):
            packed = known.get(piece)
            if packed is None:
                packed = self.older.get(piece)
                if packed is None:
                    data = piece.encode("utf-8", "surrogatepass")
                    ids = self.encode_piece(data)
                    packed = struct.pack(f"<{len(ids)}I", *ids)
                if len(packed) <= PIECE_BYTES:
                    if len(known) >= PIECES:  # the older half of the memo goes
                        self.older, self.pieces = known, {}
                        known = self.pieces
                    known[piece] = packed
            out.append(packed)
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a vocabulary file, made once in a worker process."""
    if (path, pattern) not in _CODECS:
        _CODECS.clear()
        _CODECS[path, pattern] = Codec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` plus ``out``: each whole text's ids as an array; a null text has none, like an empty one.

    ``path`` is the vocabulary on every worker (a package's file, or one sent
    with ``SparkContext.addFile``).  Rows are independent: repeated rows and
    nulls in other columns pass through, as do columns of any name, before the
    added one; an empty table gives an empty one.
    """
    names = docs.columns
    docs, (text_col,) = numbered(docs, text_col)

    @F.pandas_udf("array<int>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path, pattern)
        for batch in texts:
            yield pd.Series([np.frombuffer(own.encode(t or ""), dtype="<i4") for t in batch])

    return docs.select("*", encode(F.col(text_col).cast("string"))).toDF(*names, out)


def decode_documents(docs: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` plus ``out``, the last column: the bytes of each array of ids; null gives null."""
    names = docs.columns
    docs, (ids_col,) = numbered(docs, ids_col)

    @F.pandas_udf("binary")
    def decode(arrays: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path, pattern)
        for batch in arrays:
            yield pd.Series([None if a is None else own.decode(np.asarray(a, dtype="<u4").tobytes()) for a in batch])

    return docs.select("*", decode(F.col(ids_col))).toDF(*names, out)


def token_digests(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, plus n_tokens, ids_sha256 and decoded_sha256, made in one pass over the texts.

    Columns of any name pass through; the added ones come last.  An empty table gives an empty one.
    """
    carried = [c for c in docs.columns if c != text_col]
    docs, (text_col,) = numbered(docs, text_col)

    @F.pandas_udf("struct<n_tokens long, ids_sha256 string, decoded_sha256 string>")
    def digest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern)
        for batch in texts:
            rows = []
            for t in batch:
                packed = own.encode(t or "")
                rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(),
                             hashlib.sha256(own.decode(packed)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    rest = [c for c in docs.columns if c != text_col]
    return docs.select(*rest, digest(F.col(text_col).cast("string")).alias("_d")).select(*rest, "_d.*").toDF(
        *carried, "n_tokens", "ids_sha256", "decoded_sha256")
