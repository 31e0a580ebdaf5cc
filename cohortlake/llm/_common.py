"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    The folder is the session's ``spark.checkpoint.dir``; one in the machine's
    temporary folder is set only where that is unset and all runs on one
    machine (tests, a laptop); elsewhere that is an error.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def schema(df: DataFrame, *kept: str, **added: str) -> StructType:
    """The ``kept`` columns of ``df`` and new ones by name and type, all nullable."""
    out = StructType([StructField(c, df.schema[c].dataType) for c in kept])
    for name, kind in added.items():
        out.add(name, DataType.fromDDL(kind))
    return out


def slices(batch: pa.RecordBatch, sizes: list[int], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` whose ``sizes`` sum to about ``most`` bytes, so a batch of long texts stays in memory bounds."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total + n > most and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def give_back() -> None:
    """Return memory that was freed to the machine: a worker that waits for its next task should hold little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def by_text(text_col: str, fn: Callable[[list, pa.RecordBatch], Iterator[pa.RecordBatch]], most: int = 8 << 20):
    """A mapInArrow function that calls ``fn(texts, part)`` on parts of about ``most`` bytes; a null text is empty."""

    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            lengths = [n or 0 for n in pa.compute.binary_length(batch.column(i)).to_pylist()]
            for part in slices(batch, lengths, most):
                yield from fn([t or "" for t in part.column(i).to_pylist()], part)
        give_back()

    return run


def sieve(ids: DataFrame, column: str, bits: int = 1 << 24, segments: int = 64):
    """A broadcast bitmap of ``bits`` bits, whatever the number of ``ids``: the hashes of all of them are set.

    With few ids for its size it lets little else through; with too many it
    lets all through, which is right as well. Built segment by segment.
    """
    wide = bits // segments

    def build(t: pa.Table) -> pa.Table:
        held = np.zeros(wide, bool)
        held[t["at"].to_numpy() % wide] = True
        return pa.table([pa.array([t["at"][0].as_py() // wide], pa.int64()), pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())], names=["segment", "held"])

    places = ids.select(_place(column, bits).alias("at")).distinct().withColumn("segment", F.floor(F.col("at") / wide))
    whole = np.zeros(bits // 8, np.uint8)
    for segment, held in places.groupBy("segment").applyInArrow(build, "segment long, held binary").collect():  # bits / 8 bytes in all
        whole[segment * wide // 8 : (segment + 1) * wide // 8] = np.frombuffer(held, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(whole)


def _place(column: str, bits: int):
    return F.pmod(F.xxhash64(column, F.lit("sieve")), F.lit(bits))


def sifted(df: DataFrame, column: str, held, inside: bool = True) -> DataFrame:
    """The rows of ``df`` that may be in the sieve, or those that surely are not."""
    bits = 8 * len(held.value)

    def run(batches):
        for b in batches:
            at = b.column(b.num_columns - 1).to_numpy()
            hit = (held.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            rows = b.filter(pa.array(hit if inside else ~hit))
            yield rows.select(range(b.num_columns - 1))

    return df.withColumn("_place", _place(column, bits)).mapInArrow(run, df.schema)


def without(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` is not in ``gone``: only those that a sieve lets through are exchanged."""
    held = sieve(gone, key)
    return sifted(df, key, held, False).unionByName(sifted(df, key, held).join(gone, key, "left_anti"))


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Connected components of an undirected edge list by alternating large and small stars.

    Returns ``node, component`` (the smallest node of the component) for every
    node with an edge to another one. Every round is a pre-aggregated minimum
    per node and an equi-join whose hub keys adaptive execution can split; its
    edges are checkpointed, so lineage stays short and nothing is collected.
    """
    e = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
