"""Releases: blocks of exact coordinates, made private once and replayed ever after."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import noise


def noised(blocks: DataFrame, release: str, secret: bytes, sensitivity: float, epsilon: float, upper: int = noise.LIMIT, mechanism: str = "laplace", sigma: float = 1.0, lower: int = 0) -> DataFrame:
    """``block, coord, value`` with calibrated noise, within [lower, upper], and the radii that hold one (``radius``) or all (``radius_all``) with 95 %.

    ``blocks`` is aggregated already. A coordinate's noise depends on the
    secret, the release's name, its block and its number alone, so a repeated
    or recomputed release is the same to the last digit. Mechanisms: laplace,
    convolution, gaussian, binomial.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, coords, values = (c.to_pylist() for c in b.columns)
            out = []
            for n, c, v in zip(names, coords, values, strict=True):
                streams = [noise.Stream(secret, f"{release}\x00{peer}\x00{n}", c) for peer in (0, 1)]
                if mechanism == "gaussian":
                    drawn = noise.discrete_gaussian(streams[0], sigma)
                elif mechanism == "binomial":
                    drawn = noise.binomial_gaussian(streams[0], sigma)
                elif mechanism == "convolution":
                    drawn = noise.convolution_laplace((streams[0], streams[1]), sensitivity, epsilon)
                else:
                    drawn = noise.discrete_laplace(streams[0], sensitivity, epsilon)
                out.append(min(upper, max(lower, noise.added(v, drawn))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], ["block", "coord", "value"])

    got = blocks.select("block", F.col("coord").cast("long").alias("coord"), F.col("value").cast("long").alias("value")).mapInArrow(run, "block string, coord long, value long")
    one = _radius(mechanism, sensitivity, epsilon, sigma, 1)
    counted = blocks.agg(F.count(F.lit(1)).cast("int").alias("_n"))
    wide = F.udf(lambda n: _radius(mechanism, sensitivity, epsilon, sigma, n), "long")  # one row, the number of coordinates
    return got.crossJoin(F.broadcast(counted.select(wide("_n").alias("radius_all")))).select("block", "coord", "value", F.lit(one).cast("long").alias("radius"), "radius_all")


def _radius(mechanism: str, sensitivity: float, epsilon: float, sigma: float, coordinates: int, alpha: float = 0.05) -> int:
    if not coordinates:
        return 0
    if mechanism in ("gaussian", "binomial"):
        return noise.gaussian_radius(sigma, alpha, coordinates)
    if mechanism == "convolution":
        return noise.plan_laplace(coordinates, epsilon, sensitivity, peers=2, alpha=alpha).radius
    return noise.laplace_radius(sensitivity, epsilon, alpha, coordinates)


def on_lattice(blocks: DataFrame, bits: int, shifts: dict[str, list[int]], uppers: dict[str, list[int]]) -> DataFrame:
    """Coordinates on one common lattice, with their upper bounds: counts move up by ``bits``, what is on the lattice already stays.

    ``shifts`` and ``uppers`` have a number for every coordinate of every block.
    """
    rows = [(b, i, s, u) for b in shifts for i, (s, u) in enumerate(zip(shifts[b], uppers[b], strict=True), 1)]
    if any(s not in (0, bits) for _, _, s, _ in rows):
        raise ValueError("a coordinate moves up by the lattice's bits or not at all")
    shape = blocks.sparkSession.createDataFrame(rows, "block string, coord long, shift int, upper long")
    moved = F.col("value") * F.pow(F.lit(2.0), F.col("shift")).cast("long")
    return blocks.join(F.broadcast(shape), ["block", "coord"]).select("block", "coord", moved.alias("value"), "upper")


def composed(budgets: list[tuple[float, float]], most_epsilon: float = 8.0) -> tuple[float, float]:
    """Sum of the budgets of all releases; refused beyond the policy's bounds."""
    epsilon, delta = sum(e for e, _ in budgets), sum(d for _, d in budgets)
    if epsilon > most_epsilon or delta >= 1:
        from .policy import Refused

        raise Refused("the privacy budget is spent")
    return epsilon, delta


class Ledger:
    """Releases by name in a shared folder of Parquet files: written once, read from then on."""

    def __init__(self, folder: str):
        self.folder = folder

    def release(self, name: str, make) -> DataFrame:
        """The stored release, or ``make()`` stored under ``name``.

        It is written under a name of its own and then renamed, so a release
        that dies leaves nothing under its name, and of two callers at once the
        first one's is kept for both.
        """
        from pyspark.sql import SparkSession

        spark, path = SparkSession.getActiveSession(), f"{self.folder}/{name}"
        to = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = to.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(to):
            own = f"{self.folder}/_{name}-{uuid.uuid4().hex}"
            make().write.parquet(own)
            made = spark._jvm.org.apache.hadoop.fs.Path(own)
            if files.exists(to) or not files.rename(made, to):
                files.delete(made, True)
            inside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_{name}-{own.rsplit('-', 1)[1]}")
            if files.exists(inside):  # some file systems move into a folder that came meanwhile
                files.delete(inside, True)
        return spark.read.parquet(path)
