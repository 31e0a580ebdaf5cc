"""Near-duplicate vectors by a forest of random-projection trees.

Every tree splits recursively at the median of a random projection. Vectors
within a margin of the split go to both sides (spill), so near pairs are
rarely parted, and many trees make a miss in all of them negligible. Pairs of
one leaf are verified by their cosine in double precision; a pair that shares
several leaves counts in the first of them only.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import connected_components, cut, schema
from ._vectors import hashed_sample, matrix, usable


class Tree:
    """Splits fitted on a sample: node i sends projections up to ``cut + margin`` left and from ``cut - margin`` right."""

    def __init__(self, sample: np.ndarray, rows: float, leaf: int, margin: float, rng: np.random.Generator, fewest: int = 32):
        self.nodes: list[tuple[np.ndarray, float, int, int] | None] = []
        self.margin = margin
        self._grow(sample, rows, leaf, rng, fewest)

    def _grow(self, x: np.ndarray, rows: float, leaf: int, rng: np.random.Generator, fewest: int) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        if rows <= leaf or len(x) < fewest:
            return at
        best = None
        for _ in range(4):  # the direction that parts most of four
            way = rng.standard_normal(x.shape[1])
            p = x @ (way / np.linalg.norm(way))
            both = np.mean(np.abs(p - np.median(p)) <= self.margin)
            if best is None or both < best[0]:
                best = both, way / np.linalg.norm(way), p
        both, way, p = best
        if both > 0.8:
            return at
        cut_at = float(np.median(p))
        left, right = p <= cut_at + self.margin, p >= cut_at - self.margin
        a = self._grow(x[left], rows * left.mean(), leaf, rng, fewest)
        b = self._grow(x[right], rows * right.mean(), leaf, rng, fewest)
        self.nodes[at] = way, cut_at, a, b
        return at

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaf numbers: a row for each leaf that a vector reaches."""
        rows, found, todo = [], [], [(0, np.arange(len(x)))]
        while todo:
            at, own = todo.pop()
            if not len(own):
                continue
            node = self.nodes[at]
            if node is None:
                rows.append(own)
                found.append(np.full(len(own), at))
                continue
            way, cut_at, a, b = node
            p = x[own] @ way
            todo += [(a, own[p <= cut_at + self.margin]), (b, own[p >= cut_at - self.margin])]
        return np.concatenate(rows), np.concatenate(found)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, first by their largest component so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _meet_first(a: np.ndarray, b: np.ndarray, leaf: int) -> np.ndarray:
    """Whether no leaf below ``leaf`` is in both rows' lists of leaves (filled up with -1)."""
    out = np.ones(len(a), bool)
    for i in range(a.shape[1]):
        x = a[:, i]
        out &= ~((x >= 0) & (x < leaf) & (b == x[:, None]).any(axis=1))
    return out


def _spanning(i: np.ndarray, j: np.ndarray, parent: dict[int, int]) -> list[tuple[int, int]]:
    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            out.append((a, b))
    return out


def _padded(lists: pa.ChunkedArray) -> np.ndarray:
    """Lists of whole numbers as rows of a matrix, filled up with -1."""
    lists = lists.combine_chunks()
    sizes = lists.value_lengths().to_numpy()
    out = np.full((len(lists), int(sizes.max(initial=0))), -1, np.int64)
    out[np.arange(out.shape[1])[None] < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _compare(cosine: float):
    """applyInArrow over one pair of blocks of a leaf: links per vector, and links that span the components."""

    def run(t: pa.Table) -> pa.Table:
        ids, mult, x = t["id"].to_numpy(), t["copies"].to_numpy(), unit(matrix(t["vector"]))
        leaves = _padded(t["leaves"])
        leaf, half = t["leaf"][0].as_py(), t["block"].to_numpy()
        n_links = np.zeros(len(ids), np.int64)
        links, parent = [], {}
        one_block = t["i"][0].as_py() == t["j"][0].as_py()
        left = np.arange(len(ids)) if one_block else np.flatnonzero(half == t["i"][0].as_py())
        right = left if one_block else np.flatnonzero(half == t["j"][0].as_py())
        for at in range(0, len(left), 512):
            own = left[at : at + 512]
            i, j = np.nonzero(x[own] @ x[right].T >= cosine)
            i, j = own[i], right[j]
            if one_block:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 1 << 16):
                a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                first = _meet_first(leaves[a], leaves[b], leaf)
                a, b = a[first], b[first]
                np.add.at(n_links, a, mult[b])
                np.add.at(n_links, b, mult[a])
                links += _spanning(a, b, parent)
        linked = np.flatnonzero(n_links)
        src = [ids[linked], ids[[a for a, _ in links]] if links else np.empty(0, np.int64)]
        dst = [np.full(len(linked), -1), ids[[b for _, b in links]] if links else np.empty(0, np.int64)]
        n = [n_links[linked], np.zeros(len(links), np.int64)]
        is_link = np.r_[np.zeros(len(linked), bool), np.ones(len(links), bool)]
        return pa.Table.from_arrays([*(pa.array(np.concatenate(v).astype(np.int64)) for v in (src, dst, n)), pa.array(is_link)], ["src", "dst", "n", "is_link"])

    return run


def _route(forests: dict[int, list[Tree]]):
    """mapInArrow over vectors (third column): adds the list of their leaves; a length without trees is one leaf."""

    def run(batches):
        for b in batches:
            lengths = b.column(2).value_lengths().to_numpy()
            for n in np.unique(lengths):
                part = b.filter(pa.array(lengths == n))
                x = unit(matrix(part.column(2)))
                at, to = [], []
                for number, tree in enumerate(forests.get(int(n), [])):
                    r, f = tree.leaves(x)
                    at.append(r)
                    to.append(f + (number << 20))
                if not at:
                    at, to = [np.arange(len(x))], [np.zeros(len(x), np.int64)]
                at, to = np.concatenate(at), np.concatenate(to)
                order = np.lexsort((to, at))
                at, to = at[order], to[order]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(at, minlength=len(x)))], pa.int32()), pa.array(to, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "leaves"])

    return run


def _subtree(leaf: int, margin: float, seed: int):
    """applyInArrow over the sample of one large leaf: its tree, or nothing if no direction parts it."""

    def run(t: pa.Table) -> pa.Table:
        at, rows = t["leaf"][0].as_py(), t["n"][0].as_py()
        tree = Tree(unit(matrix(t["vector"])), rows, leaf, margin, np.random.default_rng([seed, at & 0xFFFFFFFF, at >> 32 & 0xFFFFFFFF]))
        found = [pickle.dumps(tree)] if len(tree.nodes) > 1 else []
        k = len(found)
        return pa.Table.from_arrays([t[c].slice(0, k) for c in GROUP] + [pa.array(found, pa.binary()), t["n"].slice(0, k)], [*GROUP, "tree", "n"])

    return run


def _divide(names: list[str]):
    """Cogroup of a part of a large leaf's vectors and the leaf's tree: the vectors by their new leaves, named by hash."""

    def run(rows: pa.Table, trees: pa.Table) -> pa.Table:
        rows = rows.select(names)
        if not (rows.num_rows and trees.num_rows):
            return rows
        at, to = pickle.loads(trees["tree"][0].as_py()).leaves(unit(matrix(rows["vector"])))
        own = rows["leaf"][0].as_py()
        new = {f: xxhash.xxh3_64_intdigest(f"{own}/{f}") >> 1 for f in np.unique(to).tolist()}
        out = rows.take(pa.array(at))
        return out.set_column(names.index("leaf"), "leaf", pa.array([new[f] for f in to.tolist()], pa.int64()))

    return run


GROUP = ["dim", "label", "leaf"]


def _deepened(routed: DataFrame, leaf: int, most: int, margin: float, sample: int, part: int, seed: int) -> DataFrame:
    """Splits leaves of more than ``most`` vectors by trees fitted on samples of their own, until none can be split.

    Every tree is fitted in a task on about ``sample`` vectors of one leaf, and
    the leaf's vectors are divided in parts of about ``part``, so nothing grows
    with the table but the number of leaves. Leaves that no direction parts
    (dense regions) stay as they are.
    """
    names, whole = routed.columns, None
    while True:
        large = cut(routed.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most))
        if large.isEmpty():
            break
        share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n"))
        low = F.pmod(F.xxhash64("id", "leaf", F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30)
        trees = cut(routed.join(large, GROUP).where(low).groupBy(*GROUP).applyInArrow(_subtree(leaf, margin, seed), schema(routed, *GROUP, tree="binary", n="long")))
        parts = trees.withColumn("parts", F.ceil(F.col("n") / part).cast("int"))
        spread = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        held = routed.join(parts.select(*GROUP, "parts"), GROUP).withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")).cast("int")).drop("parts")
        divided = held.groupBy(*GROUP, "part").cogroup(spread.groupBy(*GROUP, "part")).applyInArrow(_divide(names), schema(routed, *names))
        # leaves that no direction parts leave the loop, and so do small ones
        still = routed.join(large, GROUP, "left_anti").unionByName(routed.join(large.join(trees, GROUP, "left_anti"), GROUP, "left_semi"))
        whole = still if whole is None else whole.unionByName(still)
        routed = cut(divided)
    if whole is None:
        return routed
    rows = cut(whole.unionByName(routed))
    lists = rows.groupBy("id").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))  # some leaves for each tree
    return rows.drop("leaves").dropDuplicates(["id", "leaf"]).join(lists, "id")


def near_duplicates(df: DataFrame, cosine: float = 0.98, trees: int = 10, leaf: int = 1024, spill: float = 0.1, block: int = 4096, sample: int = 32_768, key: str = "vec_id", vector: str = "embedding", label: str = "label", seed: int = 11) -> DataFrame:
    """Links between vectors of one label with a cosine of at least ``cosine``.

    Returns a row for each row of ``df``: key, n_links (other rows linked
    directly), component_id (smallest key reachable) and kept (key equals it).
    Rows whose label or key is null or whose vector is null, zero, or holds
    null or non-finite components link with nothing. Copies (equal label and
    vector) are gathered first and counted, never compared or paired. Trees
    are fitted on samples, at most ``sample`` vectors of a length and then of
    every leaf that is still large; every vector is routed. A leaf holds about
    ``leaf`` vectors of the largest label. The 64 commonest lengths have trees;
    vectors of others are one leaf, compared whole. Leaves larger than
    ``block`` that no projection parts are compared block against block, each
    pair of blocks in a task of its own, so neither a hot label nor a dense
    region has to fit a task. An empty table gives no rows.
    """
    spark = df.sparkSession
    ok = usable(vector) & F.col(label).isNotNull() & F.col(key).isNotNull()
    rows = df.select(key, label, vector)
    good = rows.where(ok)
    classes = cut(good.groupBy(label, vector).agg(F.min(key).alias("id"), F.count(F.lit(1)).alias("copies")))
    by_label = classes.groupBy(F.size(vector).alias("dim"), label).agg(F.count(F.lit(1)).alias("n"))
    dims = by_label.groupBy("dim").agg(F.sum("n").alias("total"), F.max("n").alias("most")).orderBy(F.desc("total"), "dim").limit(64).collect()
    rng = np.random.default_rng(seed)
    forests: dict[int, list[Tree]] = {}
    margin = spill * math.sqrt(max(0.0, 2 - 2 * cosine))
    for dim, total, most in dims:
        if most <= leaf:
            continue  # one leaf
        some = unit(hashed_sample(classes.where(F.size(vector) == dim), "id", vector, max(64, min(sample, (64 << 20) // (8 * dim))), total)[1])
        forests[dim] = [Tree(some, most, leaf, margin, rng) for _ in range(trees)]
    shared = spark.sparkContext.broadcast(forests)  # at most trees x sample / 32 splits for each of 64 lengths

    def route(batches):
        yield from _route(shared.value)(batches)

    picked = classes.select("id", F.col(label).alias("label"), F.col(vector).alias("vector"), "copies")
    routed = picked.mapInArrow(route, schema(picked, *picked.columns, leaves="array<long>")).withColumn("leaf", F.explode("leaves")).withColumn("dim", F.size("vector"))
    routed = _deepened(cut(routed), leaf, max(block, 2 * leaf), margin, sample, 1 << 16, seed)
    large = routed.groupBy(*GROUP).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where("blocks > 1")
    few = large.count() <= 100_000  # about 4 MB
    placed = routed.join(F.broadcast(large) if few else large, GROUP, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    dealt = pairs.repartition(*GROUP, "i", "j")  # by all five: a leaf's pairs of blocks are apart
    found = cut(dealt.groupBy(*GROUP, "i", "j").applyInArrow(_compare(cosine), "src long, dst long, n long, is_link boolean"))
    links = found.where("not is_link").groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("others"))
    components = connected_components(found.where("is_link").select("src", "dst")).select(F.col("node").alias("id"), "component")
    by_class = classes.join(links, "id", "left").join(components, "id", "left").select(label, vector, (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = good.join(cut(by_class), [label, vector]).select(key, "n_links", "component_id")
    alone = rows.where(~F.coalesce(ok, F.lit(False))).select(key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
c(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id)::BIGINT AS n_links, (SELECT min(b) FROM c WHERE c.a = vec_id)::BIGINT AS component_id,
  vec_id = (SELECT min(b) FROM c WHERE c.a = vec_id) AS kept FROM embeddings"""
