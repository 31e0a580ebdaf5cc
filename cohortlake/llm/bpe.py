"""Byte-level BPE by longest matches and backtracking.

Tokens are mapped byte for byte to Latin-1 strings, so one Aho-Corasick
automaton finds every token at every byte. A piece is encoded from left to
right with the longest token that may follow its predecessor; if none may, the
encoder steps back. Two tokens may be neighbours if merging their joined bytes
gives just these two; that answer is memoised. A sequence whose neighbours all
agree is the one that the merges by rank produce, and as a position that
failed is never entered again, the time is linear in the piece.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import by_text, schema


class _Unclean(Exception):
    """White space that needs the pattern on the whole text."""


class _Words(dict):
    """Encoded words by text; at most ``most`` are kept."""

    def __init__(self, codec: BacktrackingBpe, lead: str, most: int):
        super().__init__()
        self.codec, self.lead, self.most = codec, lead, most

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Unclean
        ids = self.codec.encode_pieces(self.lead + word)
        if len(word) <= 48:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids


class BacktrackingBpe:
    """Encoder and decoder for a rank file (lines of base64 token and rank) and a pattern that cuts text into pieces."""

    def __init__(self, ranks_path: str, pattern: str, cache: int = 400_000):
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.bytes_of = dict(zip(self.ranks.values(), self.ranks, strict=True))
        self.pattern = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[int, int] = {}
        for token, rank in self.ranks.items():
            if self.merge(token) == [rank]:  # others are never the outcome of merges
                self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        for token, rank in self.ranks.items():
            s = token.decode("latin-1")
            self.shorter[rank] = next((self.ranks[token[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.automaton), -1)
        self.fits: dict[tuple[int, int], bool] = {}
        self.first, self.rest = _Words(self, "", cache // 4), _Words(self, " ", cache)
        self.newline = self.encode_pieces("\n")

    def merge(self, piece: bytes) -> list[int]:
        """The merges by rank, for short byte strings."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 31), i) for i in range(len(parts) - 1))
            if rank == 1 << 31:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, left: int, right: int) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= 500_000:
                self.fits.clear()
            known = self.fits[left, right] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        longest = [-1] * n
        for end, (rank, size) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = rank  # ends ascend, so the longest stays
        size_of, ids, pos = self.bytes_of, [], 0
        dead = bytearray(n + 1)
        token = longest[0]
        while pos < n:
            end = pos + len(size_of[token])
            if not dead[end] and (not ids or self.may_follow(ids[-1], token)):
                ids.append(token)
                pos = end
                token = longest[pos] if pos < n else -1
                continue
            token = self.shorter[token]
            while token < 0:  # nothing may stand here: give up the token before
                dead[pos] = 1
                last = ids.pop()
                pos -= len(size_of[last])
                token = self.shorter[last]
        return ids

    def encode_pieces(self, text: str) -> bytes:
        ids = chain.from_iterable(self.encode_piece(p.encode()) for p in self.pattern.findall(text))
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        A single space or line break between other characters always starts a
        piece, so words are looked up one by one; any other white space sends
        the whole text through the pattern.
        """
        out: list[bytes] = []
        try:
            for line in text.split("\n"):
                words = line.split(" ")
                out.append(self.first[words[0]])
                out.extend(map(self.rest.__getitem__, words[1:]))
                out.append(self.newline)
        except _Unclean:
            return self.encode_pieces(text)
        out.pop()
        return b"".join(out)


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> BacktrackingBpe:
    return BacktrackingBpe(ranks_path, pattern)


@lru_cache(maxsize=2)
def _vocabulary(ranks_path: str) -> dict[int, bytes]:
    with open(ranks_path, "rb") as f:
        return {int(r): base64.b64decode(t) for t, r in map(bytes.split, f)}


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``ids`` (binary, little-endian unsigned 32-bit) of every row.

    A null text is empty and gives no ids; rows stay as they are otherwise
    (null or repeated keys too). No shuffle; a task holds one Arrow batch.
    ``ranks_path`` must be readable on every executor.
    """

    def run(texts: list[str], part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(c.encode, texts), pa.binary())], [key, "ids"])

    source = df.select(key, F.col(text_col).cast("string").alias("_text"))
    return source.mapInArrow(by_text("_text", run), schema(source, key, ids="binary"))


def decode_ids(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add ``out_col``: the bytes of the tokens of ``ids_col`` (null: null)."""

    def run(batches):
        words = _vocabulary(ranks_path)
        for b in batches:
            ids = b.column(b.schema.get_field_index(ids_col))
            text = pa.array((None if not i.is_valid else b"".join(map(words.__getitem__, array("I", i.as_py()))) for i in ids), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, text], [*b.schema.names, out_col])

    return df.mapInArrow(run, schema(df, *df.columns, **{out_col: "binary"}))
