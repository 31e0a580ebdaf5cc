"""Nearest neighbours by largest inner product over randomly rotated one-bit codes.

Vectors are dealt to cells of near centroids. A vector less its cell's centroid
is padded with zeros, rotated at random, and its signs are its code: one bit a
rotated dimension, packed to 64-bit words. Queries are rotated and rounded to
four bits a dimension, so the product of query and code is a sum of population
counts of ANDed words. With the vector's norm and the product between its
rotated direction and its code, this gives an unbiased estimate of the inner
product, off by at most ``slack`` standard errors but for a vanishing share of
pairs. Only vectors whose upper bound reaches the query's floor are reranked
by the exact measure.

A query's floor starts at its k-th best product with a bounded sample, below
which no result can lie, and rises with every chunk that it meets. Cells whose
products, by centroid and radius, stay below the floor are not probed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import cut, schema
from ._vectors import hashed_sample, matrix, usable

QUERY_BITS = 4


def code_bits(dim: int, expand: int) -> int:
    """Rotated dimensions: ``expand`` for each of the vector's, filled up to whole words."""
    return -(-dim * expand // 64) * 64


def rotation(dim: int, bits: int | None = None, seed: int = 7) -> np.ndarray:
    """The columns of a random rotation of ``bits`` dimensions that a vector padded with zeros meets."""
    bits = bits or dim
    q, r = np.linalg.qr(np.random.default_rng([seed, bits]).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:, :dim]


def length(x: np.ndarray) -> np.ndarray:
    """Lengths of the rows; they are scaled first, so that squares neither overflow nor vanish."""
    most = np.abs(x).max(axis=1, initial=0)
    return most * np.linalg.norm(x / np.where(most > 0, most, 1)[:, None], axis=1)


def encode(vectors: np.ndarray, centroid: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs (words of 64), norms and code alignments of the rows."""
    rest = vectors - centroid
    norm = length(rest)
    turned = (rest / np.where(norm > 0, norm, 1)[:, None]) @ turn.T
    fit = np.abs(turned).sum(axis=1) / math.sqrt(len(turn))
    return np.packbits(turned > 0, axis=1, bitorder="little").view("<u8"), norm, np.where(norm > 0, fit, 1.0)


@dataclass
class Rounded:
    """Rotated queries at ``QUERY_BITS`` bits a dimension: ``low + step * value``, the values as bit planes."""

    low: np.ndarray
    step: np.ndarray
    planes: np.ndarray  # queries x QUERY_BITS x words
    total: np.ndarray
    off: np.ndarray  # length of what rounding left out
    norm: np.ndarray


def round_queries(queries: np.ndarray, turn: np.ndarray) -> Rounded:
    turned = queries @ turn.T
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / ((1 << QUERY_BITS) - 1), 1e-300)
    value = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    near = low[:, None] + step[:, None] * value
    planes = np.stack([np.packbits(value >> b & 1, axis=1, bitorder="little").view("<u8") for b in range(QUERY_BITS)], axis=1)
    return Rounded(low, step, planes, near.sum(axis=1), length(turned - near), length(queries))


def bounds(queries: np.ndarray, codes: np.ndarray, norm: np.ndarray, fit: np.ndarray, centroid: np.ndarray, turn: np.ndarray, slack: float, rounded: Rounded | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of all inner products (queries x codes) and their error bounds; an infinite ``slack`` gives bounds that always hold."""
    q = rounded or round_queries(queries, turn)
    bits, root = len(turn), math.sqrt(len(turn))
    held = np.zeros((len(queries), len(codes)), np.int32)
    for w in range(codes.shape[1]):
        for b in range(QUERY_BITS):
            held += np.bitwise_count(q.planes[:, b, w, None] & codes[None, :, w]).astype(np.int32) << b
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int32)
    raw = held * (2 * q.step / root).astype(np.float32)[:, None]
    raw += np.outer((2 * q.low / root).astype(np.float32), ones.astype(np.float32))
    raw -= (q.total / root).astype(np.float32)[:, None]
    scale, rest, middle = (norm / fit).astype(np.float32), np.maximum(0, 1 - fit**2), queries @ centroid
    if math.isinf(slack):
        inner = np.minimum(np.abs(raw) + q.off[:, None], q.norm[:, None])
        error = scale * (inner * rest + np.sqrt(rest) * fit * q.norm[:, None] + q.off[:, None])
    else:  # the code's and the rounding's errors are independent
        error = slack * scale * np.sqrt(np.outer(q.norm**2 / max(1, bits - 1), rest) + (q.off**2 / bits)[:, None])
    digits = 1e-5 * (np.outer(q.norm, norm) + np.abs(middle)[:, None])  # of the estimate's single precision
    return raw * scale + middle.astype(np.float32)[:, None], (error + digits).astype(np.float32)


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    return np.cumsum(vectors * query, axis=1)[:, -1]


def _best(owner: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What to keep of each owner (the ``k`` best and all within its ``margin`` of the last of them), owners that have ``k``, and their k-th scores."""
    order = np.lexsort((ids, -score, owner))
    o, s = owner[order], score[order]
    heads = np.flatnonzero(np.r_[True, o[1:] != o[:-1]]) if len(o) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[heads, len(o)])
    last = np.full(len(heads), -np.inf)
    last[sizes >= k] = s[heads[sizes >= k] + k - 1]
    keep = s >= np.repeat(last, sizes) - margin[o]
    return order[keep], o[heads[sizes >= k]], last[sizes >= k]


def search_block(q_ids, queries, floor, ids, vectors, codes, norm, fit, centroid, turn, k: int, slack: float, at_once: int = 64, chunk: int = 4096):
    """Top ``k`` of one block of vectors for each query, but for products below its ``floor``: (query id, id, score) arrays."""
    found = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
    most = float(length(centroid[None])[0] + norm.max(initial=0)) or 1.0
    norm, middle, sizes = norm / most, centroid / most, length(queries)
    for at in range(0, len(q_ids), at_once):
        own, own_ids, least, size = (x[at : at + at_once] for x in (queries, q_ids, floor, sizes))
        least, unit, size = least.copy(), own / size[:, None], size * most
        rounded, margin = round_queries(unit, turn), 1e-9 * size  # the order of summation
        held = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for b in range(0, len(ids), chunk):
            part = slice(b, b + chunk)
            estimate, error = bounds(unit, codes[part], norm[part], fit[part], middle, turn, slack, rounded)
            i, j = np.nonzero((estimate + error >= ((least - margin) / size).astype(np.float32)[:, None]) & (ids[None, part] != own_ids[:, None]))
            score = np.concatenate([np.einsum("ij,ij->i", own[i[s : s + 32_768]], vectors[part][j[s : s + 32_768]]) for s in range(0, len(i), 32_768)] or [np.empty(0)])
            near = score >= least[i] - margin[i]
            held = tuple(np.concatenate(x) for x in zip(held, (i[near], b + j[near], score[near]), strict=True))
            kept, full, kth = _best(held[0], ids[held[1]], held[2], k, 2 * margin)
            held = tuple(x[kept] for x in held)
            least[full] = np.maximum(least[full], kth)
        i, j = held[0], held[1]
        score = np.concatenate([np.cumsum(vectors[j[s : s + 32_768]] * own[i[s : s + 32_768]], axis=1)[:, -1] for s in range(0, len(i), 32_768)] or [np.empty(0)])
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        for column, v in zip(found, (own_ids[i[best]], ids[j[best]], score[best]), strict=True):
            column.append(v)
    return [np.concatenate(x) for x in found]


@dataclass
class Cells:
    """Centroids of the commonest vector length, and the sample that they and queries' first floors come from."""

    dim: int
    centroids: np.ndarray
    keys: np.ndarray
    sample: np.ndarray

    def of(self, dim: int) -> np.ndarray:
        return self.centroids if dim == self.dim else np.zeros((1, dim))

    def floors(self, ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
        """The k-th best product of each query with the sample's other rows, less a margin; no result is below it."""
        out = np.full(len(ids), -np.inf)
        if queries.shape[1] != self.dim or len(self.keys) <= k:
            return out
        most = length(self.sample).max()
        for at in range(0, len(ids), 64):
            own = queries[at : at + 64]
            score = own @ self.sample.T
            score[ids[at : at + 64, None] == self.keys[None]] = -np.inf
            out[at : at + 64] = np.partition(score, -k, axis=1)[:, -k] - 1e-9 * most * length(own)
        return out


def fit_cells(rows: DataFrame, key: str, vector: str, block: int, sample: int, seed: int, rounds: int = 5) -> Cells:
    """Centroids, one for each ``block`` rows but 256 at most, by Lloyd's rounds on at most ``sample`` rows or 32 MB."""
    lengths = rows.groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if lengths is None:
        return Cells(0, np.zeros((1, 0)), np.empty(0, np.int64), np.empty((0, 0)))
    dim, total = lengths["dim"], lengths["count"]
    keys, some = hashed_sample(rows.where(F.size(vector) == dim), key, vector, max(64, min(sample, (32 << 20) // (8 * dim))), total)
    n = max(1, min(256, -(-total // block), len(some)))
    centres = some[np.random.default_rng([seed, n]).choice(len(some), n, replace=False)]
    for _ in range(rounds):
        own = nearest_centroid(some, centres)
        sizes = np.bincount(own, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, some)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return Cells(dim, centres, keys, some)


def nearest_centroid(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty(len(vectors), np.int64)
    for at in range(0, len(vectors), 4096):
        own = vectors[at : at + 4096]
        with np.errstate(over="ignore", invalid="ignore"):  # any cell is right, a near one is only cheaper
            out[at : at + 4096] = np.argmin((centroids**2).sum(axis=1) - 2 * own @ centroids.T, axis=1)
    return out


def index(df: DataFrame, cells: Cells, key: str = "vec_id", vector: str = "embedding", expand: int = 2, seed: int = 7) -> DataFrame:
    """Codes of all usable vectors: key, vector, dim, cell, code, norm and fit.

    Only the centroids, which shift error bounds but no result, are fitted on a
    sample; every row is indexed. Rows with null keys or unusable vectors are
    left out. Vectors of other lengths than the sample's are one cell of centroid zero.
    """
    rows = df.where(usable(vector) & F.col(key).isNotNull()).select(key, vector)
    shared = df.sparkSession.sparkContext.broadcast(cells.centroids)  # at most 256 vectors
    main = cells.dim

    def run(batches):
        turns: dict[int, np.ndarray] = {}
        for b in batches:
            lengths = b.column(1).value_lengths().to_numpy()
            for n in np.unique(lengths).tolist():
                part = b.filter(pa.array(lengths == n))
                x, centres = matrix(part.column(1)), shared.value if n == main else np.zeros((1, n))
                if n not in turns:
                    turns[n] = rotation(n, code_bits(n, expand), seed)
                own = nearest_centroid(x, centres)
                codes, norm, fit = encode(x, centres[own], turns[n])
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(x), n, np.int32)), pa.array(own.astype(np.int32)), packed, pa.array(norm), pa.array(fit)], [key, vector, "dim", "cell", "code", "norm", "fit"])

    return rows.mapInArrow(run, schema(rows, key, vector, dim="int", cell="int", code="binary", norm="double", fit="double"))


def _probes(cells: Cells, radius: dict[int, float], k: int):
    """mapInArrow over queries (key, vector): floor, length, and the cells whose products may reach the floor."""

    def run(batches):
        for b in batches:
            lengths = b.column(1).value_lengths().to_numpy()
            for n in np.unique(lengths).tolist():
                part = b.filter(pa.array(lengths == n))
                x, ids = matrix(part.column(1)), part.column(0).to_numpy()
                floor, centres = cells.floors(ids, x, k), cells.of(n)
                if n == cells.dim:
                    reach = np.array([radius.get(c, -np.inf) for c in range(len(centres))])
                    most = x @ centres.T + length(x)[:, None] * reach * (1 + 1e-9)
                    probed = [np.flatnonzero(r).tolist() for r in most >= floor[:, None]]
                else:
                    probed = [[0]] * len(x)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(floor), pa.array(np.full(len(x), n, np.int32)), pa.array(probed, pa.list_(pa.int32()))], ["query_id", "query", "floor", "dim", "cells"])

    return run


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", block: int = 16_384, query_block: int = 32_768, slack: float = 3.5, sample: int = 16_384, expand: int = 2, seed: int = 7) -> DataFrame:
    """The ``k`` rows of ``df`` of largest inner product with each row of ``queries`` but for those with its own key.

    Returns query_id, rank (from 1), vec_id and score, ties to the smaller key.
    Blocks of a cell meet blocks of the queries that must probe it, both of
    bounded sizes and numbered by hash, so no group grows with the data, and a
    third of all vectors in one cell are many blocks; each gives at most ``k``
    rows a query. With an infinite ``slack`` the result is exact. Copies beyond
    ``k`` tie at the bound and are all reranked. An empty side gives no rows.
    Rows that repeat a key all count, and those of one query's key share its
    ranks. Vectors meet only those of the same length.
    """
    spark = df.sparkSession
    good = df.where(usable(vector) & F.col(key).isNotNull()).select(key, vector)
    cells = fit_cells(good, key, vector, block, sample, seed)
    coded = cut(index(df, cells, key, vector, expand, seed))
    sizes = coded.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.max("norm").alias("radius"))
    main = sizes.where(F.col("dim") == cells.dim).collect()  # at most 256 rows
    radius = {r["cell"]: r["radius"] for r in main}
    asked = queries.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).alias("query_id"), F.col(vector).alias("query"))
    parts = max(1, -(-asked.count() // query_block))
    shared = spark.sparkContext.broadcast((cells, radius))  # at most 32 MB and 256 centroids

    def probe(batches):
        yield from _probes(*shared.value, k)(batches)

    probed = asked.mapInArrow(probe, schema(asked, "query_id", "query", floor="double", dim="int", cells="array<int>"))
    left = probed.withColumn("cell", F.explode("cells")).drop("cells").join(sizes.select("dim", "cell", "blocks"), ["dim", "cell"])
    left = left.withColumn("a", F.pmod(F.xxhash64("query_id", F.lit("a")), F.lit(parts)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    salt = F.monotonically_increasing_id()
    right = coded.join(sizes.select("dim", "cell", "blocks"), ["dim", "cell"]).withColumn("b", F.pmod(F.xxhash64(key, salt), F.col("blocks")).cast("int")).drop("blocks")
    right = right.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def meet(q: pa.Table, d: pa.Table) -> pa.Table:
        if not (q.num_rows and d.num_rows):
            empty = [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())]
            return pa.Table.from_arrays(empty, ["query_id", "vec_id", "score"])
        dim, cell = d["dim"][0].as_py(), d["cell"][0].as_py()
        bits = code_bits(dim, expand)
        codes = np.frombuffer(b"".join(d["code"].to_pylist()), "<u8").reshape(d.num_rows, bits // 64)
        centre = shared.value[0].of(dim)[cell]
        found = search_block(q["query_id"].to_numpy(), matrix(q["query"]), q["floor"].to_numpy(), d[key].to_numpy(), matrix(d[vector]), codes, d["norm"].to_numpy(), d["fit"].to_numpy(), centre, rotation(dim, bits, seed), k, slack)
        return pa.Table.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    group = ["dim", "cell", "a", "b"]
    met = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i]), lambda a, b: a + b) AS score
  FROM v AS q JOIN v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
