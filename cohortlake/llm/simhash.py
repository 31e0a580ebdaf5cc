"""SimHash near-duplicates by anchors of a covering code.

The anchors are the product of two perfect Golay codes (length 23, covering
radius 3) on the low 46 bits and of all words on the high 18 bits (radius 0).
A pair within ``t`` bits has a point half-way between, at most h = ceil(t / 2)
from both; the anchor that covers this point is within 3, 3 and 0 of it block
by block, so each of the pair exceeds those radii by at most h in all. So
every fingerprint is replicated to all anchors within the covering radius plus
h, and only fingerprints at one anchor are compared: no pair is missed. As
both members are replicated, half the threshold suffices (a single-sided
scheme needs the whole of it, at fourteen times the copies).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import by_text, connected_components, cut, schema

GOLAY_POLYNOMIAL = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 divides x^23 + 1


@lru_cache(maxsize=4)
def _golay(h: int) -> list[np.ndarray]:
    """For excess e = 0..h: by syndrome, the error words that lead to codewords at radius 3 (e = 0: up to 3) plus e.

    ``x ^ error`` runs over the codewords at that distance of x. Rows hold the
    errors of one syndrome and are filled up with -1.
    """
    out = []
    for e in range(h + 1):
        picked = np.concatenate([_weighing(23, w) for w in range(4)]) if e == 0 else _weighing(23, 3 + e)
        s = _syndrome(picked)
        order = np.argsort(s, kind="stable")
        picked, s = picked[order], s[order]
        counts = np.bincount(s, minlength=2048)
        rows = np.full((2048, counts.max()), -1, np.int64)
        rows[s, np.arange(len(s)) - np.repeat(np.cumsum(counts) - counts, counts)] = picked
        out.append(rows)
    return out


def _weighing(bits: int, weight: int) -> np.ndarray:
    """The words of ``weight`` ones on ``bits`` bits."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(bits), weight)], np.int64)


def _syndrome(words: np.ndarray) -> np.ndarray:
    r = words.copy()
    for bit in range(22, 10, -1):
        r ^= ((r >> bit) & 1) * (GOLAY_POLYNOMIAL << (bit - 11))
    return r


@lru_cache(maxsize=4)
def _flips(h: int) -> list[np.ndarray]:
    """By weight 0..h, the words of that weight on 18 bits."""
    return [_weighing(18, e) for e in range(h + 1)]


def anchors(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and anchors of all (fingerprint, anchor) incidences within the covering radius plus half the threshold."""
    h = (threshold + 1) // 2
    fps = fps.astype(np.uint64)
    low, mid, high = (fps & np.uint64(0x7FFFFF)).astype(np.int64), ((fps >> np.uint64(23)) & np.uint64(0x7FFFFF)).astype(np.int64), (fps >> np.uint64(46)).astype(np.int64)
    codes, flips, s0, s1 = _golay(h), _flips(h), _syndrome(low), _syndrome(mid)
    rows, found = [], []
    for e0 in range(h + 1):
        for e1 in range(h + 1 - e0):
            for e2 in range(h + 1 - e0 - e1):
                a, b, c = codes[e0][s0], codes[e1][s1], flips[e2]
                ok = (a >= 0)[:, :, None] & (b >= 0)[:, None, :]
                i, j, k = np.nonzero(ok)
                pair = (low[i] ^ a[i, j]) | (mid[i] ^ b[i, k]) << 23
                for flip in c.tolist():
                    rows.append(i)
                    found.append(pair | (high[i] ^ flip) << 46)
    return np.concatenate(rows), np.concatenate(found)


def fingerprint(text: str) -> int:
    """64-bit SimHash of the 3-word shingles of ``text``, A-Z in lower case; 0 if it has no words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if len(words) < 3:
        return xxhash.xxh64_intdigest(b" ".join(words), 42) if words else 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    over = np.zeros(64, np.int64)
    total = len(words) - 2
    for at in range(0, total, 1 << 16):
        n = min(1 << 16, total - at)
        h = np.array([digest(joined[a:z], 42) for a, z in zip(starts[at : at + n].tolist(), ends[at + 2 : at + 2 + n].tolist(), strict=True)], "<u8")
        over += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * over > total, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``fp`` (the fingerprint's bits as a signed long) of every row; null texts count as empty."""

    def run(texts: list[str], part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fp)], [*keep, "fp"])

    source = df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    return source.mapInArrow(by_text("_text", run), schema(source, *keep, fp="long"))


def close_pairs(fps: np.ndarray, threshold: int, block: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``fps`` (distinct) within ``threshold`` bits, block against block."""
    for a in range(0, len(fps), block):
        for b in range(a, len(fps), block):
            near = np.bitwise_count(fps[a : a + block, None] ^ fps[None, b : b + block]) <= threshold
            i, j = np.nonzero(np.triu(near, 1) if a == b else near)
            yield i + a, j + b


def spanning_links(fps: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Index pairs that connect what pairs within ``threshold`` connect: at most one fewer than fingerprints."""
    parent = list(range(len(fps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i, j in close_pairs(fps, threshold):
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[ra] = rb
                links.append((a, b))
    return links


def _compare(threshold: int):
    """mapInArrow over rows sorted by anchor: links between fingerprints of one anchor."""

    def links(anchor: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        sizes = np.diff(np.r_[edge, len(anchor)])
        two = edge[sizes == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= threshold]
        src, dst = [fp[two]], [fp[two + 1]]
        for at, n in zip(edge[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own = fp[at : at + n]
            if found := spanning_links(own, threshold):
                i, j = np.array(found).T
                src.append(own[i])
                dst.append(own[j])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (src, dst)], ["src", "dst"])

    def run(batches):
        anchor, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for b in batches:
            anchor = np.concatenate([anchor, b.column(0).to_numpy()])
            fp = np.concatenate([fp, b.column(1).to_numpy().view(np.uint64)])
            other = np.flatnonzero(anchor != anchor[-1])
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                yield links(anchor[:last], fp[:last])
                anchor, fp = anchor[last:], fp[last:]
        if len(anchor):
            yield links(anchor, fp)

    return run


def near_links(distinct: DataFrame, threshold: int = 2) -> DataFrame:
    """``src, dst``: links between the distinct values of ``fp`` that connect all pairs within ``threshold`` bits.

    An anchor's fingerprints are distinct, so their number is bounded by the
    code (texts' copies are gone before); from an anchor only a spanning
    forest of its links is returned, never all pairs.
    """

    def replicate(batches):
        for b in batches:
            fp = b.column(0).to_numpy()
            for at in range(0, len(fp), 8192):
                own = fp[at : at + 8192]
                row, anchor = anchors(own.view(np.uint64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(own[row])], ["anchor", "fp"])

    dealt = distinct.select("fp").mapInArrow(replicate, "anchor long, fp long").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(_compare(threshold), "src long, dst long")


def near_duplicates(df: DataFrame, threshold: int = 2, text_col: str = "text", key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the ``carry`` columns, ``fp, component_id`` and ``component`` of every row: near-duplicate classes of texts.

    Rows whose fingerprints differ in at most ``threshold`` bits are linked;
    ``component_id`` is the smallest key reachable (null keys are passed over;
    null if there are no others); ``component`` is the class's smallest fingerprint. Rows with equal fingerprints count as copies
    and are gathered before any comparison. Empty and null texts have
    fingerprint 0, a text of one or two words that of its word sequence.
    An empty table gives no rows; other columns are not read.
    """
    docs = cut(fingerprints(df, text_col, (key, *carry)))
    classes = docs.groupBy("fp").agg(F.min(key).alias("_least"))
    found = connected_components(near_links(classes.select("fp"), threshold)).select(F.col("node").alias("fp"), "component")
    labelled = classes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("_least").alias("component_id"))
    by_fp = cut(labelled.join(least, "component").select("fp", "component_id", "component"))
    return docs.join(by_fp, "fp").select(key, *carry, "fp", "component_id", "component")
