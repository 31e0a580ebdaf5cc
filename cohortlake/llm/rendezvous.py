"""Sharding by rendezvous hashing (DataFrame functions only).

Every record key scores each shard by ``-ln(u) / weight``, with ``u`` uniform
in (0, 1) and drawn from a 64-bit hash of (key, shard); the shard of least
score gets the record. A new shard only ever takes records to itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _score(key: Column, shard: int, weight: float) -> Column:
    """An exponential variate of rate ``weight``: the 53 high bits of the hash are the uniform number."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return -F.ln(u) / F.lit(float(weight))


def rendezvous_shard(df: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 40, grown_weight: float | None = 1.0) -> DataFrame:
    """Add ``shard`` and ``grown_shard`` (the shard if one of ``grown_weight`` is added; null without one).

    A shard of weight w gets w / sum of the weights of the distinct keys. Rows
    of one key, repeated or not, and all rows of the null key share a shard.
    No shuffle: the result is a function of the key and the weights alone.
    """
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    k = F.col(key)
    best = F.array_min(F.array(*[F.struct(_score(k, i, w).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]))
    out = df.withColumn("_best", best)
    grown = F.lit(None).cast("int")
    if grown_weight is not None:
        n = len(weights)
        grown = F.when(_score(k, n, grown_weight) < F.col("_best.score"), F.lit(n)).otherwise(F.col("_best.shard"))
    return out.withColumn("shard", F.col("_best.shard")).withColumn("grown_shard", grown).drop("_best")


def number_slots(df: DataFrame, shard: str = "shard", key: str = "doc_id", buckets: int = 256) -> DataFrame:
    """Add ``slot``: numbers from 0 without gaps within each shard.

    Shards are cut into hash buckets of the key. Buckets are numbered apart and
    start where the earlier buckets of their shard end, so no shard has to fit
    a task; only bucket counts (shards x ``buckets``, a fixed number) are
    broadcast. Order: bucket, key, then all other columns (nulls first), so a
    repeated run gives the same slots.
    """
    d = df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    counts = d.groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(shard, "_bucket").orderBy(key, *[c for c in df.columns if c not in (key, shard)])
    d = d.withColumn("_at", F.row_number().over(within) - 1)
    return d.join(F.broadcast(starts), [shard, "_bucket"]).withColumn("slot", F.col("_start") + F.col("_at")).drop("_bucket", "_at", "_start")


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * 40, overhead: int = 16) -> DataFrame:
    """The layout of ``docs`` over the shards: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes (null: 0) plus ``overhead``. Null texts
    have the crc of no bytes. Null doc_ids share a shard; repeated rows get
    slots of their own; an empty table gives no rows; other columns are not read.
    Only these narrow columns are shuffled, never texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = number_slots(rendezvous_shard(narrow, weights=weights))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


# The primes of XXH64.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _layers(source: str, value: str, steps: list[str]) -> str:
    """SQL: apply the steps one after the other to column ``h`` (unsigned, 64 bits in 128)."""
    sql = f"SELECT *, ({value})::UHUGEINT AS h FROM ({source})"
    for step in steps:
        sql = f"SELECT * REPLACE (({step}) AS h) FROM ({sql})"
    return sql


def oracle(shards: int = 40, overhead: int = 16, buckets: int = 256) -> str:
    """DuckDB SQL for :func:`shard_documents` with equal weights: XXH64 and CRC-32 in whole-number arithmetic."""
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in PRIMES)
    m = "18446744073709551616::UHUGEINT"
    mix = [x for a, b in ((33, p2), (29, p3)) for x in (f"xor(h, h >> {a})", f"h * {b} % {m}")] + ["xor(h, h >> 32)"]

    def turn(x: str, by: int) -> str:
        return f"((({x}) << {by}) % {m} | (({x}) >> {64 - by}))"

    key = f"(CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE doc_id END)::UHUGEINT"
    by_key = _layers("SELECT rn, doc_id, size, text_crc32 FROM d", f"xor((42 + {p5} + 8) % {m}, {turn(f'{key} * {p2} % {m}', 31)} * {p1} % {m})", [f"({turn('h', 27)} * {p1} % {m} + {p4}) % {m}", *mix])
    keyed = f"SELECT rn, doc_id, size, text_crc32, CASE WHEN doc_id IS NULL THEN 42 ELSE h END AS hk FROM ({by_key})"
    pairs = "SELECT k.*, s.shard FROM k, (SELECT unnest(range(0, {n})) AS shard) s".format(n=shards + 1)
    scored = _layers(pairs, f"xor((hk + {p5} + 4) % {m}, shard::UHUGEINT * {p1} % {m})", [f"({turn('h', 23)} * {p2} % {m} + {p3}) % {m}", *mix])
    return f"""
WITH crc AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END, n)) AS t),
b AS (SELECT row_number() OVER () AS rn, doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
d AS (SELECT rn, doc_id, (len(bytes) + {overhead})::BIGINT AS size, xor(4294967295::BIGINT, list_reduce(bytes, lambda c, x: xor(c // 256, t[(xor(c, x) % 256 + 1)::BIGINT]), 4294967295::BIGINT)) AS text_crc32 FROM b, crc),
k AS ({keyed}),
s AS (SELECT rn, shard, -ln(((h >> 11)::DOUBLE + 0.5) / 9007199254740992.0::DOUBLE) AS score FROM ({scored})),
g AS (SELECT rn, arg_min(shard, score) FILTER (WHERE shard < {shards}) AS shard, arg_min(shard, score) AS grown FROM s GROUP BY 1)
SELECT doc_id, size, text_crc32, 'key' AS law, g.shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY g.shard ORDER BY hk % {buckets}, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, g.grown::INTEGER AS grown_shard
FROM k JOIN g USING (rn)"""
