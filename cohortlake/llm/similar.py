"""Near-duplicates of a Jaccard similarity, found by SimHash anchors and completed by an exact prefix filter.

Documents are compared as sets of ``width``-word shingles. A pair of similarity
0.8 usually differs in 3 to 16 of 64 SimHash bits, and anchors of a covering
code reach so far only with thousands of copies of every fingerprint. So they
give the closest pairs, and the others come from a prefix filter: of a set of n
shingles, ordered the same way for all, the first n - ceil(0.8 n) + 1 must hold
one of those of every similar set, and lengths and places in the order bound
what two sets can share. The parities of 1,024 classes of a set's hashes
bound from below by how many shingles two sets differ, which parts the sets of
a large family of near copies that have nothing but the family's common
shingles in their prefixes. Every candidate is counted exactly, so no pair is
missed and none is linked wrongly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import by_text, connected_components, cut, give_back, schema, sieve, sifted
from .simhash import near_links

PERCENT = 80  # least similarity, in whole numbers


def shingles(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``text``, A-Z in lower case; shorter texts are one shingle, empty ones none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    width = min(width, len(words))
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    pairs = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:z], 42) for a, z in pairs), np.uint64, len(words) - width + 1).view(np.int64))


def _fingerprint(hashes: np.ndarray) -> int:
    over = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        over += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * over > len(hashes), bitorder="little").view("<i8")[0])


def _hashed(df: DataFrame, text_col: str, keep: tuple[str, ...], width: int) -> DataFrame:
    """The ``keep`` columns and ``hashes`` of every row."""

    def run(texts: list[str], part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], _lists([shingles(t, width) for t in texts])], [*keep, "hashes"])

    source = df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    return source.mapInArrow(by_text("_text", run, 2 << 20), schema(source, *keep, hashes="array<long>"))


def _lists(arrays: list[np.ndarray], kind=np.int64) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in arrays])], pa.int32()), pa.array(np.concatenate(arrays).astype(kind)))


def _frequent(df: DataFrame, text_col: str, width: int, sample: int, fewest: int = 4, most: int = 100_000) -> np.ndarray:
    """Shingles in many sets of a sample. They only come last in the order, which is right for any choice."""
    share = max(1, df.count() // sample)
    some = df.where(F.pmod(F.xxhash64(text_col), F.lit(share)) == 0)
    seen = _hashed(some, text_col, (), width).select(F.explode("hashes").alias("h")).groupBy("h").count().where(F.col("count") >= fewest)
    return np.sort(np.array([r["h"] for r in seen.orderBy(F.desc("count"), "h").limit(most).collect()], np.int64))


def _prefix(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    n, last = len(hashes), np.zeros(len(hashes), bool)
    if len(frequent):
        last = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes
    return (np.r_[hashes[~last], hashes[last]] if last.any() else hashes)[: n - (PERCENT * n + 99) // 100 + 1]


def _brief(prefix: np.ndarray) -> np.ndarray:
    """Distinct values of the hashes' low 16 bits, ascending."""
    return np.unique(prefix.astype(np.int16))


def _parities(hashes: np.ndarray) -> bytes:
    """A bit for each of 1,024 classes of hashes: whether the set holds an odd number of them.

    Every shingle that is in one of two sets alone turns one bit, so sets differ in at least as many shingles as these in bits.
    """
    return np.packbits(np.bincount((hashes.view(np.uint64) >> np.uint64(54)).astype(np.int64), minlength=1024) & 1).tobytes()


def _rows(df: DataFrame, text_col: str, keep: tuple[str, ...], width: int, frequent: np.ndarray) -> DataFrame:
    """The ``keep`` columns, the set's hash ``id``, its size ``n``, fingerprint ``fp``, parities ``odd``, ``prefix``, and that in ``brief`` of every row."""
    shared = df.sparkSession.sparkContext.broadcast(frequent)

    def run(texts: list[str], part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [shingles(t, width) for t in texts]
        ids = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        sizes, fps = np.array([len(s) for s in sets], np.int64), np.array([_fingerprint(s) for s in sets], np.int64)
        prefixes = [_prefix(s, shared.value) for s in sets]
        odd = pa.array([_parities(s) for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, (ids, sizes, fps)), odd, _lists(prefixes), _lists([_brief(p) for p in prefixes], np.int16)], [*keep, "id", "n", "fp", "odd", "prefix", "brief"])

    source = df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    return cut(source.mapInArrow(by_text("_text", run, 2 << 20), schema(source, *keep, id="long", n="long", fp="long", odd="binary", prefix="array<long>", brief="array<short>")))


def _numbers(column: pa.Array) -> np.ndarray:
    """Whole numbers; of binary values one for every eight bytes."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), -1)
    return column.to_numpy()


def _groups(batches, make):
    """``make(rows)`` of each run of equal first columns, rows as one array of whole numbers; sorted by that column."""
    held: list[np.ndarray] = []
    for b in batches:
        if not b.num_rows:
            continue
        rows = np.column_stack([_numbers(c) for c in b.columns])
        edges = np.r_[0, np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1, len(rows)]
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if held and held[0][0, 0] != rows[a, 0]:
                if len(held) > 1 or len(held[0]) > 1:
                    yield from make(np.concatenate(held))
                held = []
            held.append(rows[a:z])
    if held and (len(held) > 1 or len(held[0]) > 1):
        yield from make(np.concatenate(held))


def _batched(rows, names: list[str], most: int = 1 << 16):
    """Record batches of about ``most`` rows from arrays."""
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += len(r)
        if n >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(held).T.copy()], names)
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(held).T.copy()], names)


def _possible(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets that share a shingle for the first time there (rows of h, id, n, at) can be similar, each of ``x`` with each of ``y``."""
    left, n = np.minimum((x[:, 2] - x[:, 3])[:, None], (y[:, 2] - y[:, 3])[None]), x[:, 2][:, None] + y[:, 2][None]
    return left * (100 + PERCENT) >= PERCENT * n


def _shared(batches, block: int = 1024):
    """Rows of shingles that two or more different sets have in their prefixes, copies once; of small groups those with a possible partner."""

    def make(rows):
        rows = rows[np.unique(rows[:, 1], return_index=True)[1]]
        if 1 < len(rows) <= block:
            ok = _possible(rows, rows)
            np.fill_diagonal(ok, False)
            rows = rows[ok.any(axis=0)]
        if len(rows) > 1:
            yield rows

    yield from _batched(_groups(batches, make), ["h", "id", "n", "at"])


def _place(h: int, *at: int) -> int:
    """A number for what is compared together, from a shingle and the blocks of its rows."""
    return xxhash.xxh3_64_intdigest(np.array([h, *at], np.int64).tobytes()) - (1 << 63)


def _stars(batches, hubs: int = 4, block: int = 1024):
    """Of each shingle's sets, by length: the pairs of each with the ``hubs`` at which it stands first, if it can be similar to them.

    What stands before a shingle is mostly what few sets have, so the hubs are
    the least changed of a large group of near copies, and similar to most of
    it. A set that is similar to one of them need not be paired with the
    others, so the group becomes one component in pairs that grow with its
    size, not with its square.
    """

    def make(rows):
        rows = rows[np.argsort(rows[:, 2], kind="stable")]
        mixed = rows[:, 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        a = 0
        while a < len(rows):
            z = int(np.searchsorted(rows[:, 2], rows[a, 2] * 100 // PERCENT, "right"))
            first = a + np.lexsort((mixed[a:z], rows[a:z, 3]))[:hubs]
            for at in range(a, z, block):
                own = np.arange(at, min(z, at + block))
                ok = _possible(rows[first], rows[own]) & (rows[first, 1][:, None] != rows[own, 1][None])
                x, y = np.nonzero(ok)
                if len(x):
                    x, y = rows[first[x], 1], rows[own[y], 1]
                    yield np.unique(np.column_stack([np.minimum(x, y), np.maximum(x, y), np.full(len(x), _place(int(rows[0, 0]), a, at))]), axis=0)
            a = z

    yield from _batched(_groups(batches, make), ["a", "b", "g"])


def _close(rows: np.ndarray, x: np.ndarray, y: np.ndarray, part: int = 1 << 14) -> np.ndarray:
    """Whether the parities (``rows`` from column 5) let the sets at ``x`` and ``y`` be similar; ``part`` pairs at once, so memory is bounded."""
    kept = [np.empty(0, bool)]
    for at in range(0, len(x), part):
        i, j = x[at : at + part], y[at : at + part]
        apart = np.bitwise_count((rows[i, 5:] ^ rows[j, 5:]).view(np.uint64)).sum(axis=1, dtype=np.int64)  # of signed numbers it counts the absolute values
        kept.append((100 + PERCENT) * apart <= (100 - PERCENT) * (rows[i, 2] + rows[j, 2]))
    return np.concatenate(kept)


def _remaining(batches, block: int = 1024):
    """All pairs of each shingle's sets that are not in one component yet and whose lengths, places and parities allow the similarity."""

    def make(rows):
        if (rows[:, 4] == rows[0, 4]).all():
            return
        rows = rows[np.argsort(rows[:, 2], kind="stable")]
        id_, n, component = rows[:, 1], rows[:, 2], rows[:, 4]
        for a in range(0, len(rows), block):
            i = slice(a, a + block)
            end = int(np.searchsorted(n, n[i].max() * 100 // PERCENT, "right"))
            for b in range(a, end, block):
                j = slice(b, b + block)
                ok = _possible(rows[i], rows[j]) & (component[i][:, None] != component[j][None])
                x, y = np.nonzero(np.triu(ok, 1) if a == b else ok)
                x, y = x + a, y + b
                near = _close(rows, x, y)
                if near.any():
                    x, y = id_[x[near]], id_[y[near]]
                    yield np.column_stack([np.minimum(x, y), np.maximum(x, y), np.full(len(x), _place(int(rows[0, 0]), a, b))])

    yield from _batched(_groups(batches, make), ["a", "b", "g"])


def _held(x: np.ndarray, y: np.ndarray) -> int:
    """How many values of ``x`` are in ``y``, both ascending and distinct."""
    if not len(x) or not len(y):
        return 0
    at = np.searchsorted(y, x)
    return int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))


def _compare(unread: bool):
    """Cogroup of the pairs and the sets of one bucket: the pairs that can be (``unread``) or are similar."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        out = pairs.select(["a", "b"])
        if not (pairs.num_rows and sets.num_rows):
            return out.slice(0, 0)
        ids, n = sets["id"].to_numpy(), sets["n"].to_numpy()
        lists = sets["h"].combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
        spare = sets["spare"].to_numpy()
        order = np.argsort(ids)
        place = [order[np.minimum(np.searchsorted(ids[order], pairs[c].to_numpy()), len(ids) - 1)] for c in "ab"]
        kept = []
        for a, b in zip(*(p.tolist() for p in place), strict=True):
            small, large = min(n[a], n[b]), max(n[a], n[b])
            most = 0
            if 100 * small >= PERCENT * large:
                x, y = flat[ends[a] : ends[a + 1]], flat[ends[b] : ends[b + 1]]
                most = _held(x, y) if len(x) <= len(y) else _held(y, x)
                if unread:  # values may stand for several shingles; behind the prefix that ends first, all of that set's rest may agree
                    most += min(spare[a], spare[b]) + max(n[a] - len(x) - spare[a], n[b] - len(y) - spare[b])
            kept.append((100 + PERCENT) * most >= PERCENT * (n[a] + n[b]))
        whole = [ids[p] == pairs[c].to_numpy() for p, c in zip(place, "ab", strict=True)]
        give_back()
        return out.filter(pa.array(np.array(kept, bool) & whole[0] & whole[1]))

    return run


def _counted(pairs: DataFrame, sets: DataFrame, unread: bool, at_once: int = 4096) -> DataFrame:
    """The ``pairs`` (a, b, and g: what they are compared with together) whose ``sets`` (id, n, h, spare) are similar, or can be.

    Pairs of about ``at_once`` are one bucket, by their place, so that sets in
    many pairs of a group travel once.
    """
    buckets = max(1, -(-pairs.count() // at_once))
    placed = pairs.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int"))
    wanted = placed.select(F.col("bucket").alias("to"), F.explode(F.array("a", "b")).alias("id")).distinct()
    near = wanted.join(sets, "id").groupBy("to")
    found = placed.groupBy("bucket").cogroup(near).applyInArrow(_compare(unread), "a long, b long")
    if unread:
        found = found.join(pairs.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "g"), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).select("a", "b", "g")
    return cut(found)


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def _labelled(links: DataFrame) -> DataFrame:
    return connected_components(links, "a", "b").select(F.col("node").alias("id"), "component")


def similar_documents(df: DataFrame, row: str, carry: tuple[str, ...] = (), text_col: str = "text", width: int = 5, threshold: int = 2, sample: int = 4_000) -> DataFrame:
    """``row``, the ``carry`` columns and ``component`` of every row: classes that pairs of Jaccard similarity 0.8 or more connect.

    ``row`` differs in every row. Rows of equal sets are copies (texts without words too: null, empty) and
    are compared once. Candidates are the SimHash pairs within ``threshold``
    bits, then stars in each shingle's group, by which most of a large group
    becomes one component, then all pairs of a group that are not in one
    component yet and whose parities do not rule the similarity out. Within a
    group these are looked up for every such pair, which costs its square in
    array operations; rows are made only for pairs that pass. Sets of several
    thousand shingles turn too many bits to be ruled out.
    Sets are kept only for candidates. An empty table gives no rows.
    """
    rows = _rows(df, text_col, (row, *carry), width, _frequent(df, text_col, width, sample))
    prefixes = rows.select(F.posexplode("prefix").alias("at", "h"), "id", "n").select("h", "id", "n", F.col("at").cast("long").alias("at"))
    shared = cut(prefixes.repartition("h").sortWithinPartitions("h").mapInArrow(_shared, "h long, id long, n long, at long"))
    fps = rows.where("n > 0").groupBy("fp").agg(F.min("id").alias("first"))
    same = rows.select("id", "n", "fp").join(fps, "fp").where("n > 0 and id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    near = near_links(fps.select("fp"), threshold).join(fps.select(F.col("fp").alias("src"), F.col("first").alias("a")), "src").join(fps.select(F.col("fp").alias("dst"), F.col("first").alias("b")), "dst").select("a", "b")
    closest = same.unionByName(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("a", "b").alias("g"))

    def similar(pairs: DataFrame) -> DataFrame:
        """The similar ones of ``pairs``: first by prefixes, then by whole sets, for which the texts of likely rows are exchanged."""
        pairs = cut(pairs.groupBy("a", "b").agg(F.min("g").alias("g")))
        wanted = cut(_ids(pairs))
        spare = (F.size("prefix") - F.size("brief")).cast("long").alias("spare")
        own = sifted(rows.select("id", "n", F.col("brief").alias("h"), spare), "id", sieve(wanted, "id"))
        likely = _counted(pairs, own.join(wanted, "id", "left_semi").dropDuplicates(["id"]), True, 16_384)
        firsts = cut(rows.select("id", "n", row).join(_ids(likely), "id", "left_semi").groupBy("id", "n").agg(F.min(row).alias(row)))
        texts = sifted(df.select(row, text_col), row, sieve(firsts, row)).join(firsts, row)
        whole = _hashed(texts, text_col, ("id", "n"), width).select("id", "n", F.col("hashes").alias("h"), F.lit(0).cast("long").alias("spare"))
        return _counted(likely, whole, False)

    links = similar(closest.unionByName(shared.mapInArrow(_stars, "a long, b long, g long")))
    known = shared.join(_labelled(links), "id", "left").join(rows.select("id", "odd").dropDuplicates(["id"]), "id").select("h", "id", "n", "at", F.coalesce("component", "id").alias("component"), "odd")
    rest = similar(known.repartition("h").sortWithinPartitions("h").mapInArrow(_remaining, "a long, b long, g long"))
    found = _labelled(links.unionByName(rest))
    return rows.select(row, *carry, "id").join(found, "id", "left").select(row, *carry, F.coalesce("component", "id").alias("component"))
