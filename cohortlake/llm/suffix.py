"""Removal of repeated byte strings by external induced suffix sorting.

A byte goes if it lies in a string of ``length`` bytes that also starts
earlier (smaller doc_id, or the same document further left).

1. Every window of ``length`` bytes is assigned to a gram chosen by content
   (:mod:`_windows`), so equal windows meet in the shard of their gram. Only
   hashes and positions travel. Occurrences with the same surrounding bytes
   are copies: all but the first are repeated as a whole. Grams of common
   phrases, found in a bounded sample, are chosen last, so that what stands
   around such a phrase is dealt by other grams.
2. What differs around a gram that occurs more than once is cut out of the
   texts: one stretch of bytes for each different surrounding.
3. Each shard of stretches, less those whose windows can be in no other, is
   sorted by external induced sorting (:mod:`induced`). Suffixes with a common
   prefix of ``length`` bytes are the same window; all but the first are
   repeated.
4. The spans are united per document and cut out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _windows
from ._common import by_text, cut, give_back, schema
from .induced import repeats

#: Distinct surroundings of one gram from which its stretches are dealt by a longer string, so that a common phrase spreads over shards.
HOT = 1024

#: Shards whose marks are one file of the checkpoint. Where Hadoop has no native library, an executor starts helper processes for every file that it writes there.
SHARDS_A_FILE = 16

#: Bits of a gram's hash that travel; within a shard they tell grams apart, and two grams taken for one only cost time.
GRAM_BITS = (1 << 40) - 1


def _pack(columns: list[np.ndarray]) -> bytes:
    """Equally long int64 columns, as differences, compressed."""
    flat = np.concatenate([np.diff(c, prepend=np.int64(0)) for c in columns]).astype("<i8")
    shuffled = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 8).T)
    return struct.pack("<q", len(columns[0])) + zstandard.compress(shuffled.tobytes(), 1)


def _unpack(blob: bytes, width: int) -> list[np.ndarray]:
    n = struct.unpack_from("<q", blob)[0]
    raw = np.frombuffer(zstandard.decompress(blob[8:]), np.uint8).reshape(8, -1)
    flat = np.ascontiguousarray(raw.T).view("<i8").ravel()
    return [np.cumsum(flat[i * n : (i + 1) * n]) for i in range(width)]


def _gather(blobs, width: int) -> list[np.ndarray]:
    parts = [_unpack(b, width) for b in blobs]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * width


def _merged(uid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """Ranges of starts united where they touch, by row."""
    if not len(uid):
        return [uid, lo, hi]
    order = np.lexsort((lo, uid))
    uid, lo, hi = uid[order], lo[order], hi[order]
    top = np.maximum.accumulate(hi + (np.cumsum(np.r_[0, uid[1:] != uid[:-1]]) << 40)) & ((1 << 40) - 1)
    new = np.r_[True, (uid[1:] != uid[:-1]) | (lo[1:] > top[:-1] + 1)]
    heads = np.flatnonzero(new)
    return [uid[heads], lo[heads], top[np.r_[heads[1:], len(uid)] - 1]]


def _by_bucket(columns: list[np.ndarray], bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for a, z in zip(heads, [*heads[1:], len(bucket)], strict=False):
        yield int(bucket[a]), _pack([c[order[a:z]] for c in columns])


def _common(narrow: DataFrame, gram: int, total: int, sample_bytes: int) -> np.ndarray:
    """Grams in 0.5 % (and 8 at least) of a sample of about ``sample_bytes`` of texts' beginnings. They are only chosen last, which is right for any list."""
    share = min(1.0, sample_bytes / max(1, total))
    picked = narrow.where(F.pmod(F.xxhash64("__uid", F.lit("hot")), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = picked.select(F.substring("__text", 1, 8192).alias("t")).limit(max(64, sample_bytes // 256)).toArrow()["t"]
    texts = [t.encode() for t in rows.to_pylist() if t]
    return _windows.common_grams(texts, gram, max(8, len(texts) // 200))


def _scan(length: int, gram: int, shards: int, common):
    """Occurrences of one part's texts, as blobs by shard; those that repeat another one of the part are only marked."""

    def run(texts: list[str], part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        doc = part.column(0)
        known = doc.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
        ids = doc.fill_null(0).to_numpy().astype(np.int64)
        uid = part.column(1).to_numpy()
        found: list[list[np.ndarray]] = [[] for _ in range(8)]
        hot = _windows.Hot(common.value) if len(common.value) else None
        for row, text in enumerate(texts):
            data = text.encode()
            p, lo, hi = _windows.occurrences(data, length, gram, hot)
            if len(p):
                h, s = _windows.keys(data, p, lo, hi, length, gram)
                for column, v in zip(found, (h.view(np.int64), s.view(np.int64), np.full(len(p), known[row]), np.full(len(p), ids[row]), np.full(len(p), uid[row]), lo, hi, p), strict=True):
                    column.append(v)
        if not found[0]:
            return
        h, s, has, d, u, lo, hi, p = (np.concatenate(c) for c in found)
        order = np.lexsort((lo, u, d, has, s, h))
        h, s, has, d, u, lo, hi, p = (c[order] for c in (h, s, has, d, u, lo, hi, p))
        again = np.r_[False, (h[1:] == h[:-1]) & (s[1:] == s[:-1])]
        marked = _merged(u[again], lo[again], hi[again])
        rows = [(b, True, blob) for b, blob in _by_bucket(marked, marked[0] % shards)]
        first = [c[~again] for c in (h & GRAM_BITS, s, has, d, u, lo, hi, p)]
        rows += [(b, False, blob) for b, blob in _by_bucket(first, h[~again].view(np.uint64) % np.uint64(shards))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.binary()), strict=True)], ["shard", "marked", "blob"])

    return run


def _match(buckets: int, length: int):
    """One shard: repeated occurrences are marked; different surroundings of a repeated gram become stretches to sort."""

    def of(marked: list[bytes], blobs: list[bytes]) -> pa.RecordBatch:
        rows = []
        old = _gather(marked, 3)
        h, s, has, d, u, lo, hi, p = _gather(blobs, 8)
        order = np.lexsort((lo, u, d, has, s, h))
        h, s, has, d, u, lo, hi, p = (c[order] for c in (h, s, has, d, u, lo, hi, p))
        if len(h):
            again = np.r_[False, (h[1:] == h[:-1]) & (s[1:] == s[:-1])]
            old = _merged(*(np.concatenate([a, b]) for a, b in zip(old, (u[again], lo[again], hi[again]), strict=True)))
            h, has, d, u, lo, hi, p = (c[~again] for c in (h, has, d, u, lo, hi, p))
            heads = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            sizes = np.diff(np.r_[heads, len(h)])
            many = np.repeat(sizes, sizes)
            todo = many > 1
            columns = [c[todo] for c in (u, lo, hi, p, h, (many > HOT).astype(np.int64))]
            order = np.lexsort((columns[1], columns[0]))
            columns = [c[order] for c in columns]
            rows += [(b, False, blob, int(n)) for (b, blob), n in zip(_by_bucket(columns, columns[0] % buckets), _lengths(columns, buckets, length), strict=True)]
        rows += [(b, True, blob, 0) for b, blob in _by_bucket(old, old[0] % buckets)]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int32(), pa.bool_(), pa.binary(), pa.int64()), strict=True)], ["bucket", "marked", "blob", "n_bytes"])

    def run(batches):
        shard, marked, blobs = None, [], []
        for b in batches:
            for key, mark, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != shard:
                    if shard is not None:
                        yield of(marked, blobs)
                    shard, marked, blobs = key, [], []
                (marked if mark else blobs).append(blob)
        if shard is not None:
            yield of(marked, blobs)
        give_back()

    return run


def _lengths(columns: list[np.ndarray], buckets: int, length: int) -> np.ndarray:
    """Bytes of the stretches of each bucket that has any, by bucket."""
    bucket = columns[0] % buckets
    return np.bincount(bucket, columns[2] - columns[1] + length)[np.unique(bucket)]


def _dealt(df: DataFrame, text_col: str, buckets: int) -> DataFrame:
    """Rows by bucket of their row number: ``bucket, blob``, each blob a compressed Arrow stream of the rows of one part."""

    def run(texts: list[str], part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bucket = part.column(part.schema.get_field_index("__uid")).to_numpy() % buckets
        order = np.argsort(bucket, kind="stable")
        part, bucket = part.take(pa.array(order)), bucket[order]
        heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        blobs = []
        for a, z in zip(heads.tolist(), [*heads[1:].tolist(), len(bucket)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as writer:
                writer.write_batch(part.slice(a, z - a))
            blobs.append(zstandard.compress(sink.getvalue(), 1))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[heads], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return df.mapInArrow(by_text(text_col, run, 4 << 20), "bucket int, blob binary")


def _rows(t: pa.Table) -> list[pa.Table]:
    """The rows of the blobs of :func:`_dealt`, part by part."""
    return [pa.ipc.open_stream(zstandard.decompress(b.as_buffer())).read_all() for b in t["blob"]]


def _stretches(length: int, gram: int, shards: int):
    """Cogroup of texts and stretches of one bucket: the stretches' bytes, by shard of their gram (or of a longer string, if it is hot)."""
    digest = xxhash.xxh3_64_intdigest
    side = (length - gram) // 2

    def run(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(8)]
        if texts.num_rows and wanted.num_rows:
            columns = _gather(wanted["blob"].to_pylist(), 6)
            order = np.lexsort((columns[1], columns[0]))
            u, lo, hi, p, h, hot = (c[order] for c in columns)
            for part in _rows(texts):
                for uid, doc, text in zip(part["__uid"].to_pylist(), part["_key"].to_pylist(), part["__text"], strict=True):
                    first, last = np.searchsorted(u, [uid, uid + 1])
                    if first == last:
                        continue
                    data = text.as_buffer().to_pybytes()
                    for a, z, q, key, many in zip(*(c[first:last].tolist() for c in (lo, hi, p, h, hot)), strict=True):
                        parts = [(a, z, key, q, gram)]
                        if many:  # each window has `side` bytes on one side of the gram at least
                            split = q - side
                            parts = [(a, min(z, split), digest(data[split : q + gram], 2), split, gram + side)] if a <= split else []
                            if z > split:
                                parts.append((max(a, split + 1), z, digest(data[q : q + gram + side], 3), q, gram + side))
                        for a_, z_, k, core, wide in parts:
                            for column, v in zip(out, (k % shards, uid, doc, a_, z_ - a_ + 1, core - a_, wide, data[a_ : z_ + length]), strict=True):
                                column.append(v)
        kinds = (pa.int32(), *(pa.int64(),) * 6, pa.binary())
        give_back()
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["shard", "__uid", "doc", "lo", "n", "core", "wide", "data"])

    return run


def _likely(t: pa.Table, length: int, ranges: int = 8) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Stretches that can hold a window of another one: rows of ``t``, first windows in them, bytes and numbers of windows.

    The windows of a stretch hold its common string (``core``, ``wide``) and
    ``length - wide`` bytes around it. Those with about as many bytes on the
    left hold one longer string together, and only windows whose longer string
    stands in two stretches can be equal.
    """
    digest, found = xxhash.xxh3_64_intdigest, []
    for row, (data, n, core, wide) in enumerate(zip(t["data"], *(t[c].to_pylist() for c in ("n", "core", "wide")), strict=True)):
        data, free = data.as_buffer().to_pybytes(), length - wide
        step = -(-(free + 1) // ranges)
        for j in range(ranges):
            left, most = j * step, min(free, (j + 1) * step - 1)  # bytes on the left of the string
            first, last = max(0, core - most), min(n - 1, core - left)
            if left <= most and first <= last:
                found.append((row, first, last, digest(data[core - left : core + wide + free - most], j)))
    if not found:
        return (*np.empty((2, 0), np.int64), [], np.empty(0, np.int64))
    row, first, last, key = (np.array(c, np.uint64 if i == 3 else np.int64) for i, c in enumerate(zip(*found, strict=True)))
    _, which, many = np.unique(key, return_inverse=True, return_counts=True)
    kept = many[which] > 1
    row, first, last = row[kept], first[kept], last[kept]
    order = np.lexsort((first, row))
    row, first, last = row[order], first[order], last[order]
    heads = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (first[1:] > last[:-1] + 1)]) if len(row) else np.empty(0, np.int64)
    row, first, last = row[heads], first[heads], last[np.append(heads[1:], len(row)) - 1] if len(heads) else last
    data = [t["data"][i].as_buffer()[a : z + length].to_pybytes() for i, a, z in zip(row.tolist(), first.tolist(), last.tolist(), strict=True)]
    return row, first, data, last - first + 1


def _sorted_shard(length: int, buckets: int, queue_tuples: int):
    """applyInArrow over one shard of stretches: ranges of repeated windows, by bucket of their rows."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        row, first, pieces, n = _likely(t, length)
        if not len(row):
            return pa.Table.from_arrays([pa.array([], pa.int32()), pa.array([], pa.binary())], ["bucket", "blob"])
        sizes = np.array(list(map(len, pieces)), np.int64)
        starts = np.r_[0, np.cumsum(sizes + 1)]
        text = np.frombuffer(b"\xff".join([*pieces, b""]), np.uint8)  # UTF-8 has no byte 255
        lo, uid = (t[c].to_numpy().astype(np.int64)[row] for c in ("lo", "__uid"))
        lo += first
        doc, has = t["doc"].fill_null(0).to_numpy().astype(np.int64)[row], t["doc"].is_valid().to_numpy().astype(np.int64)[row]
        used = np.zeros(256, bool)
        used[np.unique(text)] = True
        used[255] = False
        codes = np.cumsum(used).astype(np.uint8) * used
        text = codes[text]
        first_of = np.empty(len(uid), np.int64)
        first_of[np.lexsort((lo, uid, doc, has))] = np.arange(len(uid))  # stretches in the order of their places
        marked = []
        for same, heads in repeats(text, length, queue_tuples):
            number = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(same))))
            owner = np.searchsorted(starts, same, side="right") - 1
            offset = same - starts[owner]
            inside = offset < n[owner]
            number, owner, offset = number[inside], owner[inside], offset[inside]
            order = np.lexsort((offset, first_of[owner], number))  # the first of each class stays
            number, owner, offset = number[order], owner[order], offset[order]
            again = np.flatnonzero(number[1:] == number[:-1]) + 1
            marked.append(np.column_stack([uid[owner[again]], lo[owner[again]] + offset[again]]))
        rows = []
        if marked:
            u, at = np.concatenate(marked).T
            ranges = _merged(u, at, at)
            rows = list(_by_bucket(ranges, ranges[0] % buckets))
        columns = list(zip(*rows, strict=True)) if rows else [[], []]
        give_back()
        return pa.Table.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary())], ["bucket", "blob"])

    return run


def whole_characters(data: memoryview, a: int, z: int) -> tuple[int, int]:
    """The part of a byte range that holds whole UTF-8 characters."""
    while a < z and data[a] & 0xC0 == 0x80:
        a += 1
    while a < z < len(data) and data[z] & 0xC0 == 0x80:
        z -= 1
    return a, z


def _cut_out(length: int, names: list[str], whole: bool):
    """Cogroup of rows and repeated ranges of one bucket: spans and what is left of each text."""

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(rows: pa.Table, ranges: pa.Table) -> pa.Table:
        u, lo, hi = _merged(*_gather(ranges["blob"].to_pylist(), 3))
        hi = hi + length
        new = np.r_[True, (u[1:] != u[:-1]) | (lo[1:] > hi[:-1])] if len(u) else np.empty(0, bool)  # touching spans are one run
        heads = np.flatnonzero(new)
        ends = hi[np.r_[heads[1:], len(u)] - 1] if len(u) else hi
        u, lo = u[heads], lo[heads]
        done = []
        for part in _rows(rows):
            spans, kept = [], []
            for uid, text in zip(part["__uid"].to_pylist(), part["__text"], strict=True):
                first, last = np.searchsorted(u, [uid, uid + 1])
                data, own = memoryview(text.as_buffer() or b""), list(zip(lo[first:last].tolist(), ends[first:last].tolist(), strict=True))
                if whole:
                    own = [whole_characters(data, a, z) for a, z in own]
                edges = [0, *(x for s in own for x in s), len(data)]
                kept.append(b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"start": a, "end": z} for a, z in own])
            done.append(pa.Table.from_arrays([*(part[c] for c in names), pa.array(spans, kind), pa.array(kept, pa.binary())], [*names, "spans", "kept"]))
        give_back()
        return pa.concat_tables(done)

    return run


def remove_repeats(docs: DataFrame, length: int = 100, gram: int = 44, shard_bytes: int = 8 << 20, sort_bytes: int = 8 << 20, queue_tuples: int = 1 << 18, sample_bytes: int = 4 << 20, key: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """The rows of ``docs`` with ``spans`` (byte ranges that repeat earlier bytes) and ``kept`` (the other bytes).

    With ``whole``, spans shrink to whole characters, so that the rest is text.
    Judged on the input: overlapping strings all count, whatever else goes.
    A null text is empty; texts shorter than ``length`` keep all bytes. Rows
    with null keys come before all others; rows with one key are ordered by
    their place in the input. All other columns stay as they are (``spans`` and
    ``kept`` of the input are replaced). Texts must be
    read in the same order each time (as files are); write other inputs first.

    Shards, buckets and sorting jobs are sized by bytes. A sorting job holds at
    most ``queue_tuples`` tuples of a queue in memory, the rest on disk. Equal
    occurrences are reduced to one within each part before any exchange; a gram
    with many different surroundings is dealt over shards by a longer string.
    What is matched stays on the executors' disks until the marks are
    checkpointed, in few files; texts are exchanged twice. Columns of the input
    named ``__uid``, ``__text`` or ``_key`` come through as well.
    """
    clash = {c: f"__own{i}" for i, c in enumerate(docs.columns) if c in ("__uid", "__text", "_key")}
    if clash:
        renamed = docs.withColumnsRenamed(clash)
        done = remove_repeats(renamed, length, gram, shard_bytes, sort_bytes, queue_tuples, sample_bytes, clash.get(key, key), clash.get(text_col, text_col), whole)
        return done.withColumnsRenamed({v: k for k, v in clash.items()})
    source = docs.withColumn("__uid", F.monotonically_increasing_id())
    narrow = source.select(F.col(key).cast("long").alias("_key"), "__uid", F.col(text_col).cast("string").alias("__text"))
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))

    common = docs.sparkSession.sparkContext.broadcast(_common(narrow, gram, total, sample_bytes))  # at most 65,536 hashes
    occurrences = narrow.mapInArrow(by_text("__text", _scan(length, gram, shards, common), 4 << 20), "shard int, marked boolean, blob binary")
    dealt = occurrences.repartition("shard").sortWithinPartitions("shard")
    matched = dealt.mapInArrow(_match(shards, length), "bucket int, marked boolean, blob binary, n_bytes long").persist(StorageLevel.DISK_ONLY)
    try:
        todo = matched.where("not marked").select("bucket", "blob")
        to_sort = matched.agg(F.sum("n_bytes")).first()[0] or 0
        jobs = max(1, -(-to_sort // sort_bytes))
        marks = matched.where("marked").select("bucket", "blob")
        if to_sort:
            texts = _dealt(narrow, "__text", shards)
            stretches = texts.groupBy("bucket").cogroup(todo.groupBy("bucket")).applyInArrow(_stretches(length, gram, jobs), "shard int, __uid long, doc long, lo long, n long, core long, wide long, data binary")
            marks = marks.unionByName(stretches.groupBy("shard").applyInArrow(_sorted_shard(length, shards, queue_tuples), "bucket int, blob binary"))
        repeated = cut(marks.repartition(-(-shards // SHARDS_A_FILE)))
    finally:
        matched.unpersist()
    names = [c for c in docs.columns if c not in ("spans", "kept")]
    rows = source.select(*names, "__uid", F.col(text_col).cast("string").cast("binary").alias("__text"))
    out = schema(docs, *names, spans="array<struct<start:bigint,end:bigint>>", kept="binary")
    return _dealt(rows, "__text", shards).groupBy("bucket").cogroup(repeated.groupBy("bucket")).applyInArrow(_cut_out(length, names, whole), out)


def digest(removed: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and checksum for each row of :func:`remove_repeats`, a table so much smaller than the texts that it is gathered in few partitions."""
    n = F.octet_length(F.coalesce(F.col(text_col), F.lit("")))
    rows = removed.select(key, n.cast("long").alias("n_bytes"), (n - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return rows.hint("rebalance")
