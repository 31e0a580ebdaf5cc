"""Packing token sequences by first-fit decreasing in randomised groups.

A document is cut into full sequences and a remainder. Remainders are dealt at
random over partitions; every run of ``group_docs`` of them is packed by
itself: longest first, each into the first bin with room, which a tournament
tree over the bins' free room finds in logarithmic time.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import by_text, give_back, schema


class FirstFit:
    """Bins of one size; an inner node holds the most free room among the bins below it."""

    def __init__(self, room: int, bins: int):
        self.width = 1 << max(0, bins - 1).bit_length()
        self.free = [room] * (2 * self.width)

    def place(self, size: int) -> int:
        """Put ``size`` into the first bin with room for it; the bin's number."""
        free, at = self.free, 1
        while at < self.width:
            at *= 2
            if free[at] < size:
                at += 1
        free[at] -= size
        bin_, at = at - self.width, at // 2
        while at:
            left, right = free[2 * at], free[2 * at + 1]
            free[at] = left if left > right else right
            at //= 2
        return bin_


def first_fit_decreasing(sizes: list[int], room: int) -> list[int]:
    """The bin of each size, by descending size (ties: as listed)."""
    tree, out = FirstFit(room, len(sizes)), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = tree.place(sizes[i])
    return out


class _Chunks(dict):
    """Ids of chunks between spaces; at most ``most`` chunks are kept.

    New words of letters only are encoded many at a time, joined by spaces, and
    their ids are told apart by the tokens that end a word. Other chunks, and
    groups in which a letter's lower case is no letter, are encoded one by one.
    """

    def __init__(self, path: str, most: int):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.most, self.tokenizer = most, Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.marks = {m: self._encode([m])[0] for m in ",."}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], group: int = 512) -> None:
        groups = [words[i : i + group] for i in range(0, len(words), group)]
        for own, ids in zip(groups, self._encode([" ".join(g) for g in groups]), strict=True):
            stops = (np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 1) * 4
            if len(stops) != len(own):
                self.update(zip(own, self._encode(own), strict=True))
                continue
            at = [0, *stops.tolist()]
            for word, a, z in zip(own, at, at[1:], strict=False):
                self[word] = ids[a:z]

    def forget(self) -> None:
        self.clear()
        self[""] = b""

    def learn(self, new: set[str]) -> None:
        """Encode these chunks."""
        if len(self) + len(new) > self.most:
            self.forget()
        marked = [c for c in new if c[-1] in self.marks and c[:-1].isalpha()]
        words = {c for c in new if c.isalpha()} | {c[:-1] for c in marked if c[:-1] not in self}
        self._words(list(words))
        for c in marked:
            self[c] = self[c[:-1]] + self.marks[c[-1]]
        rest = [c for c in new if c not in self]
        self.update(zip(rest, self._encode(rest), strict=True))

    def encode(self, texts: list[str]) -> list[list[bytes]]:
        """Ids of each text's chunks. Every chunk is looked up once; the new ones are encoded together."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        found = [list(map(self.get, s)) for s in split]
        gaps = [[i for i, x in enumerate(f) if x is None] if None in f else [] for f in found]
        new = {s[i] for s, g in zip(split, gaps, strict=True) for i in g}
        if new:
            self.learn(new)
        for s, f, g in zip(split, found, gaps, strict=True):
            for i in g:
                f[i] = self[s[i]]
        return found


@lru_cache(maxsize=1)
def _chunks(path: str, most: int) -> _Chunks:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return _Chunks(path, most)


def tokenize(df: DataFrame, tokenizer_path: str, end_id: int | None = 2, text_col: str = "text", key: str = "doc_id", cache: int = 1_200_000, keep: bool = True) -> DataFrame:
    """``key`` and ``ids`` (binary, little-endian unsigned 32-bit, with ``end_id`` at the end).

    For tokenizers that cut at white space and drop it: ids of chunks between
    spaces and line breaks are joined, and each new chunk is encoded once.
    A null text is empty. ``tokenizer_path`` must be readable on every executor.
    A worker holds ``cache`` chunks at most and, unless ``keep``, neither chunks nor tokenizer when a task ends.
    """
    source = _source(df, key, text_col)
    return source.mapInArrow(_encoded(key, tokenizer_path, end_id, cache, keep), schema(source, key, ids="binary"))


def _source(df: DataFrame, key: str, text_col: str) -> DataFrame:
    return df.select(key, F.col(text_col).cast("string").alias("_text"))


def _encoded(key: str, tokenizer_path: str, end_id: int | None, cache: int, keep: bool):
    """mapInArrow: the ids of each text."""
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def run(texts: list[str], part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = [b"".join([*chunks, end]) for chunks in _chunks(tokenizer_path, cache).encode(texts)]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], [key, "ids"])

    def encoded(batches):
        yield from by_text("_text", run, 512 << 10)(batches)
        if not keep:
            _chunks.cache_clear()
            give_back()

    return encoded


def _pieces(key: str, room: int, keep_ids: bool):
    """mapInArrow: one row for each piece of at most ``room`` ids."""

    def run(batches):
        n = 0
        for b in batches:
            docs, keys = [], []
            rows: list[list] = [[], [], [], [], [], []]
            for i, ids in enumerate(b.column(1)):
                ids, n = ids.as_buffer() or b"", n + 1
                total = len(ids) // 4
                for start in range(0, total, room):
                    piece = memoryview(ids)[4 * start : 4 * (start + room)]
                    docs.append(i)
                    keys.append(n)
                    for column, v in zip(rows, (start, len(piece) // 4, zlib.crc32(piece), total, n % 4096, bytes(piece) if keep_ids else None), strict=True):
                        column.append(v)
            columns = [b.column(0).take(pa.array(docs, pa.int64())), *(pa.array(c, t) for c, t in zip(rows, (pa.int64(),) * 5 + (pa.binary(),), strict=True))]
            yield pa.RecordBatch.from_arrays(columns, [key, "start", "length", "ids_crc32", "doc_tokens", "_salt", "ids"])

    return run


def pack(tokens: DataFrame, room: int = 4096, group_docs: int = 65_536, key: str = "doc_id", keep_ids: bool = True, seed: int = 1) -> DataFrame:
    """Pack the ``ids`` of each row of ``tokens`` into sequences of at most ``room`` ids.

    Returns one row per piece: ``key, start, length, ids_crc32, doc_tokens,
    sequence_id, offset`` and, with ``keep_ids``, ``ids``. Rows are dealt by a
    hash of key, length, checksum and a salt of the row's place, so neither a
    null key nor repeated rows gather in one task. Each partition is sorted
    and packed in runs of ``group_docs`` pieces, which bounds a task's memory.
    Sequence ids are unique: partition x 2^36 + running number. Rows without
    ids give no piece; an empty table gives none.
    """
    if keep_ids:
        group_docs = min(group_docs, (256 << 20) // (4 * room))
    pieces = tokens.select(key, "ids").mapInArrow(_pieces(key, room, keep_ids), _kinds(tokens, key))
    return _packed(pieces, room, group_docs, key, keep_ids, seed)


def pack_texts(df: DataFrame, tokenizer_path: str, room: int = 4096, group_docs: int = 65_536, end_id: int | None = 2, text_col: str = "text", key: str = "doc_id", cache: int = 1_200_000, keep: bool = True, seed: int = 1) -> DataFrame:
    """The rows of :func:`pack` without ``ids`` for :func:`tokenize`.

    A task has one Python worker where the two take two: ids go from step to step within it, not through Spark.
    """
    source = _source(df, key, text_col)
    encoded, pieces = _encoded(key, tokenizer_path, end_id, cache, keep), _pieces(key, room, False)
    return _packed(source.mapInArrow(lambda batches: pieces(encoded(batches)), _kinds(source, key)), room, group_docs, key, False, seed)


def _kinds(df: DataFrame, key: str):
    return schema(df, key, **dict.fromkeys(("start", "length", "ids_crc32", "doc_tokens", "_salt"), "long"), ids="binary")


def _packed(pieces: DataFrame, room: int, group_docs: int, key: str, keep_ids: bool, seed: int) -> DataFrame:
    order = F.xxhash64(key, "length", "ids_crc32", "_salt", F.lit(seed))
    dealt = pieces.withColumn("_order", order).repartition("_order").sortWithinPartitions("_order", key, "start", "length", "ids_crc32")
    names = [key, "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]

    def run(batches):
        base, used = TaskContext.get().partitionId() << 36, 0
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            nonlocal used
            t = pa.Table.from_batches(held).combine_chunks()
            sizes = t["length"].to_pylist()
            bins = first_fit_decreasing(sizes, room)
            filled: dict[int, int] = {}
            offsets = []
            for bin_, size in zip(bins, sizes, strict=True):
                offsets.append(filled.get(bin_, 0))
                filled[bin_] = offsets[-1] + size
            ids = pa.array([base + used + x for x in bins], pa.int64())
            used += len(filled)
            held.clear()
            t = t.select(names).append_column("sequence_id", ids).append_column("offset", pa.array(offsets, pa.int64()))
            return t.to_batches()[0]

        for b in batches:
            while b.num_rows:
                part = b.slice(0, group_docs - sum(x.num_rows for x in held))
                held.append(part)
                b = b.slice(part.num_rows)
                if sum(x.num_rows for x in held) == group_docs:
                    yield packed()
        if held:
            yield packed()

    return dealt.mapInArrow(run, schema(dealt, *names, sequence_id="long", offset="long"))
