"""Tables: scans, snapshots, catalogues and sinks."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.policy import NAME, DatasetDescriptor, Policy, Refused

ALLOWED = (T.BooleanType, T.NumericType, T.StringType, T.DateType, T.TimestampType, T.DayTimeIntervalType)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below the session's checkpoint folder, or, where none is set and all runs on one machine, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="shared-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder of Parquet files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Session:
    """Named tables of one user; a standardised copy is preferred to the table itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.standardised, self.frozen = spark, {}, {}, {}

    def assign(self, name: str, df: DataFrame) -> None:
        """The sink of aligned tables: a table under a new name, which SQL sees too."""
        if not NAME.match(name):
            raise ValueError(f"{name!r} is no table name")
        self.tables[name] = df
        df.createOrReplaceTempView(name)

    def resolve(self, name: str) -> DataFrame:
        found = self.standardised.get(name, self.tables.get(name))
        return found if found is not None else self.spark.table(name)

    def snapshot(self, name: str, descriptor: DatasetDescriptor, order: str | None = None, expected: str | None = None) -> DataFrame:
        """The table as a snapshot of a declared version, kept by its cache key.

        With ``order`` and ``expected`` its digest must be the declared one, which is checked once.
        """
        df = self.resolve(name)
        key = cache_key(descriptor, df)
        if key not in self.frozen:
            if expected is not None and digest(df, order).first()["sha256"] != expected:
                raise Refused("the snapshot is not the declared version")
            self.frozen[key] = snapshot(df)
        return self.frozen[key]


def cache_key(descriptor: DatasetDescriptor, df: DataFrame) -> str:
    """A snapshot's key: the declared version, the columns and the plan that reads them."""
    plan = f"{df.semanticHash():x}"
    return hashlib.sha256("|".join([descriptor.key, *(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema), plan]).encode()).hexdigest()


def snapshot(df: DataFrame) -> DataFrame:
    """All columns in byte order of their names; nested, binary and map columns are refused."""
    if len(set(df.columns)) != len(df.columns) or not all(df.columns):
        raise ValueError("column names must be unique and not empty")
    for f in df.schema:
        if not isinstance(f.dataType, ALLOWED):
            raise TypeError(f"column {f.name} has a type that is not allowed: {f.dataType.simpleString()}")
    return df.select(*sorted(df.columns, key=str.encode))


def digest(df: DataFrame, order: str, block: int = 65_536, fan: int = 4096, levels: int = 2) -> DataFrame:
    """One row with a SHA-256 over the rows' order: a tree of hashes, of ``block`` rows and then of ``fan`` hashes each.

    ``order`` is a column of distinct integers from 0. Every node is of a fixed
    size, so none grows with the table; ``levels`` of them above the blocks hold
    ``block`` x ``fan`` ^ ``levels`` rows before the last one grows.
    """
    snap = snapshot(df.drop(order))
    cells = [F.coalesce(F.concat(F.lit("v"), F.octet_length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("n")) for c in snap.columns]
    nodes = df.select(F.col(order).cast("long").alias("at"), F.sha2(F.concat(*cells), 256).alias("h"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("m"))
    for k, size in enumerate((block, *[fan] * levels)):
        own = F.array_sort(F.collect_list(F.struct("at", "h"))).alias("own")
        blocks = F.sum("m") if k else F.lit(1).cast("long")
        nodes = nodes.groupBy(F.floor(F.col("at") / size).alias("to")).agg(own, F.sum("n").alias("n"), blocks.alias("m")).select(F.col("to").alias("at"), F.sha2(F.array_join("own.h", ""), 256).alias("h"), "n", "m")
    whole = nodes.agg(F.array_sort(F.collect_list(F.struct("at", "h"))).alias("own"), F.sum("n").alias("n_rows"), F.sum("m").alias("n_blocks"))
    return whole.select(F.sha2(F.concat(F.lit(",".join(snap.columns)), F.array_join("own.h", "")), 256).alias("sha256"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "n_blocks")])


def catalogue(spark: SparkSession, policy: Policy) -> DataFrame:
    """Published columns: name, kind and role. No data are read."""
    rows = [(policy.unit, "identifier", "unit")]
    rows += [(c, "numeric", "bounded") for c in policy.bounds] + [(c, "categorical", "declared") for c in policy.levels]
    return spark.createDataFrame(sorted(rows), "column string, kind string, role string")


def declared_levels(spark: SparkSession, policy: Policy, column: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in policy.levels[column]], "level string")


def drop_temporary(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """``df`` without the columns of a prefix, and their names."""
    gone = [c for c in df.columns if c.startswith(prefix) and c not in keep]
    return df.drop(*gone), gone
