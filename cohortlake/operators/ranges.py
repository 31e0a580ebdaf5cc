"""Whole-table orders without a whole-table window: rows are dealt to ranges, each range is ordered by itself.

The ranges' bounds are fixed first, from a bounded sample, so a row's range
depends on its columns alone and is the same wherever it is evaluated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

PART = "_part"


def bounds(df: DataFrame, order: list[str], parts: int, sample: int = 20_000) -> list[Row]:
    """At most ``parts`` - 1 ascending keys that cut the rows to ranges of about the same size (nulls come first)."""
    n = df.count()
    some = df.select(*order).sample(min(1.0, sample / max(1, n)), seed=1).limit(2 * sample)
    rows = some.distinct().orderBy(*order).collect()  # at most 2 x sample keys
    step = max(1, -(-len(rows) // parts))
    return rows[step::step]


def part_of(df: DataFrame, order: list[str], cuts: list[Row]) -> Column:
    """The number of a row's range: a binary search written as nested conditions."""
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    at = [F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(f"k{i}") for i, (c, v) in enumerate(zip(order, cut, strict=True))]) for cut in cuts]

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < at[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(cuts))


def ranged(df: DataFrame, order: list[str], parts: int) -> tuple[DataFrame, list[Row]]:
    """``df`` with the number of each row's range, and the bounds."""
    cuts = bounds(df, order, parts)
    return df.withColumn(PART, part_of(df, order, cuts)), cuts


def searched(df: DataFrame, order: list[str], parts: int) -> tuple[DataFrame, list[Row]]:
    """``df`` with the number of each row's range, and the bounds.

    The number is that of the bounds at or below the row's key: a binary search
    in a constant array, one projection a step, so the code that runs for each
    row stays small enough to be compiled however many ranges there are. A
    condition on the number must not be pushed below it: it would grow
    threefold at each step. So only running sums use this form.
    """
    cuts = bounds(df, order, parts)
    if not cuts:
        return df.withColumn(PART, F.lit(0)), cuts
    kind = T.StructType([T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(order)])
    table = df.sparkSession.createDataFrame([([tuple(c) for c in cuts],)], T.StructType([T.StructField("cuts", T.ArrayType(kind))])).scalar()
    d = df.withColumns({PART: F.lit(0), "_key": F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])})
    step = 1 << (len(cuts).bit_length() - 1)
    while step:
        at = F.col(PART) + step
        d = d.withColumn(PART, F.when(F.col("_key") >= F.get(table, at - 1), at).otherwise(F.col(PART)))  # null beyond the last bound
        step //= 2
    return d.drop("_key"), cuts


def starts(d: DataFrame, total: Column, name: str) -> DataFrame:
    """For every range, ``total`` of all ranges before it: at most one row a range."""
    per = d.groupBy(PART).agg(total.alias("_total"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # over ranges, not rows
    return F.broadcast(per.select(PART, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias(name)))


def numbered(df: DataFrame, order: list[str], name: str, parts: int = 200) -> DataFrame:
    """Numbers from 0 in ``order``."""
    d, _ = ranged(df, order, parts)
    within = F.row_number().over(Window.partitionBy(PART).orderBy(*order)) - 1
    first = starts(d, F.count(F.lit(1)), "_start")
    return d.withColumn("_at", within).join(first, PART).withColumn(name, F.col("_start") + F.col("_at")).drop(PART, "_at", "_start")


def values_at(df: DataFrame, column: str, ranks: list[int], parts: int = 200) -> dict[int, object]:
    """The values of these ranks (from 0) among the values of a column that are not null: only the ranges that hold them are ordered."""
    d, _ = ranged(df.where(F.col(column).isNotNull()).select(column), [column], parts)
    sizes = {r[PART]: r["n"] for r in d.groupBy(PART).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a range
    wanted, before = [], 0
    for part in sorted(sizes):
        wanted += [(part, k - before, k) for k in ranks if before <= k < before + sizes[part]]
        before += sizes[part]
    if not wanted:
        return {}
    rows = d.where(F.col(PART).isin(*{p for p, _, _ in wanted})).withColumn("_at", F.row_number().over(Window.partitionBy(PART).orderBy(column)) - 1)
    pick = F.lit(False)
    for p, at, _ in wanted:
        pick = pick | ((F.col(PART) == p) & (F.col("_at") == at))
    got = {(r[PART], r["_at"]): r[column] for r in rows.where(pick).collect()}  # one row a rank
    return {k: got[p, at] for p, at, k in wanted}
