"""Exact integer statistics of bounded units, as blocks of coordinates.

Every family returns ``block, coord, value``: the block's name, a coordinate
from 1 in the block's fixed order, and a whole number. Domains come from the
policy, so empty cells are zeros and the shape never depends on the data.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import bin_right_closed, lattice
from ..plans.policy import Policy
from . import bound


def _block(units: DataFrame, name: str, terms: list[Column]) -> DataFrame:
    """Aggregates of a frame as the coordinates of one block."""
    return blocks(units, [(name, terms)]).select("block", "coord", "value")


def blocks(units: DataFrame, parts: list[tuple[str, list[Column]]], bad: Column | None = None) -> DataFrame:
    """``at, block, coord, value``: the aggregates of several blocks in one pass, refused as a whole where the aggregate ``bad`` holds."""
    terms = [t for _, own in parts for t in own]
    gate = [] if bad is None else [bad.alias("_bad")]
    got = units.agg(*[t.alias(f"t{i}") for i, t in enumerate(terms)], *gate)
    if bad is not None:
        got = got.where(bound.refused_if(F.col("_bad")))
    names = [(at, name, coord) for at, (name, own) in enumerate(parts) for coord in range(1, len(own) + 1)]
    cells = F.array(*[F.struct(F.lit(at).alias("at"), F.lit(name).alias("block"), F.lit(coord).cast("long").alias("coord"), F.coalesce(F.col(f"t{i}"), F.lit(0)).cast("long").alias("value")) for i, (at, name, coord) in enumerate(names)])
    return got.select(F.explode(cells).alias("c")).select("c.*")


def _sum(term: Column, where: Column) -> Column:
    return F.sum(F.when(where, term))


def _z(policy: Policy, column: str, v: Column) -> Column:
    lo, hi = policy.bounds[column]
    return (v - F.lit(float(lo))) / F.lit(float(hi - lo))


def admitted_count(df: DataFrame, policy: Policy, name: str = "admitted_count") -> DataFrame:
    """The units of the table, if the policy admits them."""
    return _block(bound.admitted(df, policy), name, [F.max("n_units")])


def moments_terms(policy: Policy, column: str, v: str) -> list[Column]:
    z, s, has = _z(policy, column, F.col(v)), policy.scale, F.col(v).isNotNull()
    return [_sum(t, has) for t in (F.lit(1), lattice(z, s), lattice(z * z, s))]


def moments(units: DataFrame, policy: Policy, column: str, v: str = "v", name: str | None = None) -> DataFrame:
    """Count, sum and sum of squares of the scaled values, each term on the lattice."""
    return _block(units, name or f"numeric:{column}", moments_terms(policy, column, v))


def pair_terms(policy: Policy, x: str, y: str, vx: str, vy: str) -> list[Column]:
    a, b, s = _z(policy, x, F.col(vx)), _z(policy, y, F.col(vy)), policy.scale
    both = F.col(vx).isNotNull() & F.col(vy).isNotNull()
    return [_sum(t, both) for t in (F.lit(1), *(lattice(t, s) for t in (a, b, a * a, b * b, a * b)))]


def pair_moments(units: DataFrame, policy: Policy, x: str, y: str, vx: str, vy: str, name: str | None = None) -> DataFrame:
    """Count, both sums, both sums of squares and the sum of products over units that have both values."""
    return _block(units, name or f"pair:{x},{y}", pair_terms(policy, x, y, vx, vy))


def all_moments(units: DataFrame, policy: Policy, columns: list[str]) -> DataFrame:
    """``block, coord, value``: the moments of every column and of every pair of columns, in the order given.

    Pairs are rows, not columns, of the aggregate: a unit's values are exploded
    to its pairs, which are summed before the exchange, so the width of the
    plan does not grow with the square of the columns.
    """
    spark, s, k = units.sparkSession, policy.scale, len(columns)
    z = F.array(*[_z(policy, c, F.col(c)) for c in columns])
    first = units.select(z.alias("z")).select("z", F.posexplode("z").alias("i", "x")).where("x is not null")
    second = first.select("i", "x", F.posexplode(F.slice("z", F.col("i") + 1, F.lit(k))).alias("j", "y")).where("y is not null")
    x, y = F.col("x"), F.col("y")
    own = F.when(F.col("j") == 0, F.lit(-1)).otherwise(F.col("i") + F.col("j"))  # the value itself stands for the column's moments
    sums = [F.count(F.lit(1)), *[F.sum(lattice(t, s)) for t in (x, y, x * x, y * y, x * y)]]
    got = second.groupBy("i", own.alias("j")).agg(*[t.alias(f"s{n}") for n, t in enumerate(sums)])
    domain = [(i, -1, f"numeric:{c}", [0, 1, 3]) for i, c in enumerate(columns)]
    domain += [(i, j, f"pair:{columns[i]},{columns[j]}", list(range(6))) for i in range(k) for j in range(i + 1, k)]
    shape = spark.createDataFrame([(n, *d) for n, d in enumerate(domain)], "at int, i int, j int, block string, picked array<int>")
    cells = F.array(*[f"s{n}" for n in range(6)])
    rows = shape.join(got, ["i", "j"], "left").select("at", "block", F.posexplode(F.transform("picked", lambda p: F.coalesce(F.get(cells, p), F.lit(0)))).alias("coord", "value"))
    return rows.select("at", "block", (F.col("coord") + 1).cast("long").alias("coord"), F.col("value").cast("long").alias("value"))


def gaussian_terms(policy: Policy, outcome: str, predictors: list[str], intercept: bool = True) -> list[Column]:
    names = sorted(predictors, key=str.encode)
    xs = [*([F.lit(1.0)] if intercept else []), *(_z(policy, n, F.col(n)) for n in names)]
    y, s = _z(policy, outcome, F.col(outcome)), policy.scale
    terms = [F.lit(1)] + [lattice(xs[i] * xs[j], s) for j in range(len(xs)) for i in range(j + 1)]
    terms += [lattice(x * y, s) for x in xs] + [lattice(y * y, s)]
    return [_sum(t, _complete(outcome, names)) for t in terms]


def _complete(*names) -> Column:
    whole = F.lit(True)
    for n in (x for y in names for x in ([y] if isinstance(y, str) else y)):
        whole = whole & F.col(n).isNotNull()
    return whole


def gaussian(units: DataFrame, policy: Policy, outcome: str, predictors: list[str], intercept: bool = True, name: str | None = None) -> DataFrame:
    """Count, upper triangle of X'X by columns, X'y and y'y over complete units; terms rounded to the lattice.

    Columns of ``units`` are named as in the policy. Predictors come in byte
    order, the intercept first; its own product is the count times the scale.
    """
    return _block(units, name or f"gaussian:{outcome}", gaussian_terms(policy, outcome, predictors, intercept))


def gaussian_cross_terms(policy: Policy, outcome: str, predictors: list[str], intercept: bool = True) -> list[Column]:
    names, s = sorted(predictors, key=str.encode), policy.scale
    whole = F.lit(s).cast("long")
    xs = [*([whole] if intercept else []), *(lattice(_z(policy, n, F.col(n)), s) for n in names)]
    y = lattice(_z(policy, outcome, F.col(outcome)), s)

    def times(a: Column, b: Column) -> Column:
        return F.shiftright(a * b, policy.grid_bits)  # a floor for negative products too

    terms = [whole] + [times(xs[i], xs[j]) for j in range(len(xs)) for i in range(j + 1)] + [times(x, y) for x in xs] + [times(y, y)]
    return [_sum(t, _complete(outcome, names)) for t in terms]


def gaussian_cross(units: DataFrame, policy: Policy, outcome: str, predictors: list[str], intercept: bool = True, name: str | None = None) -> DataFrame:
    """As :func:`gaussian` across owners: inputs are rounded first and products floored, the count is on the lattice too."""
    return _block(units, name or f"gaussian_cross:{outcome}", gaussian_cross_terms(policy, outcome, predictors, intercept))


def histogram_terms(grid: list[float], v: str, has: Column | None = None) -> list[Column]:
    """``has``: which rows are units of the owner, if others are among them."""
    at = bin_right_closed(F.col(v), grid[:-1])
    own = F.lit(True) if has is None else has
    return [*[F.count_if(F.col(v).isNotNull() & (at == i)) for i in range(1, len(grid) + 1)], F.count_if(own & F.col(v).isNull())]


def histogram(units: DataFrame, column: str, grid: list[float], v: str = "v", name: str | None = None) -> DataFrame:
    """Units by right-closed bins, the last one up to the upper bound; then the units without a value."""
    return _block(units, name or f"histogram:{column}", histogram_terms(grid, v))


def marginals_terms(policy: Policy, column: str, v: str) -> list[Column]:
    return [F.count_if(F.col(v) == x) for x in policy.levels[column]]


def marginals(units: DataFrame, policy: Policy, column: str, v: str = "level", name: str | None = None) -> DataFrame:
    return _block(units, name or f"categorical:{column}", marginals_terms(policy, column, v))


def pairs_terms(rows: tuple[str, ...], cols: tuple[str, ...], r: str, c: str, scale: int = 1) -> list[Column]:
    return [F.count_if((F.col(r) == a) & (F.col(c) == b)) * scale for b, a in product(cols, rows)]


def pairs(units: DataFrame, policy: Policy, row: str, col: str, r: str = "r", c: str = "c", name: str | None = None, scaled: bool = False) -> DataFrame:
    """Units by cell, columns one after the other; ``scaled`` counts are on the lattice."""
    return _block(units, name or f"categories:{row},{col}", pairs_terms(policy.levels[row], policy.levels[col], r, c, policy.scale if scaled else 1))


def pairs_cross(left: DataFrame, left_policy: Policy, row: str, right: DataFrame, right_policy: Policy, col: str, name: str | None = None) -> DataFrame:
    """Cells of two owners' categories: each side takes its one level of a unit, then units are joined."""
    a = bound.bounded_category(left, left_policy, row, "r").where("r is not null")
    b = bound.bounded_category(right, right_policy, col, "c").where("c is not null")
    return _block(a.join(b, "unit"), name or f"categories_cross:{row},{col}", pairs_terms(left_policy.levels[row], right_policy.levels[col], "r", "c", left_policy.scale))


def survival_terms(policy: Policy, event: str, censor: str, grid: list[float], delayed: bool = False) -> list[Column]:
    causes = [censor, *[x for x in policy.levels[event] if x != censor]]
    t, e = bin_right_closed(F.col("time"), grid[:-1]), bin_right_closed(F.col("entry"), grid[:-1])
    bins = range(1, len(grid) + 1)
    tests = [F.col("valid") & (e == i) for i in bins] if delayed else []
    tests += [F.col("valid") & (F.col("outcome") == c) & (t == i) for c, i in product(causes, bins)]
    return [F.count_if(t) for t in (*tests, ~F.col("valid"))]


def survival(units: DataFrame, policy: Policy, event: str, censor: str, grid: list[float], delayed: bool = False, name: str = "survival") -> DataFrame:
    """Entry bins (if delayed), then time bins of every outcome, the censored first, then invalid units."""
    return _block(units, name, survival_terms(policy, event, censor, grid, delayed))


def describe(df: DataFrame, policy: Policy, grids: dict[str, list[float]], digits: int | None = None) -> DataFrame:
    """For each variable in the order given: moments, then histogram, of means of scaled rows."""
    out = None
    for column, grid in grids.items():
        lo, hi = policy.bounds[column]
        units = bound.bounded_normalised(df, policy, column, digits)
        s, z = policy.scale, F.col("z")
        at = bin_right_closed(z, [(g - lo) / (hi - lo) for g in grid[:-1]])
        terms = [F.count("z"), F.sum(lattice(z, s)), F.sum(lattice(z * z, s)), *[F.count_if(z.isNotNull() & (at == i)) for i in range(1, len(grid) + 1)], F.count_if(z.isNull())]
        block = _block(units, f"describe:{column}", terms)
        out = block if out is None else out.unionByName(block)
    return out


def correlation(block: DataFrame, scale: int) -> DataFrame:
    """Correlation of each block of :func:`pair_moments`, from its sums on the lattice."""
    wide = block.groupBy("block").agg(*[F.max(F.when(F.col("coord") == i, F.col("value"))).cast("double").alias(n) for i, n in enumerate(("n", "x", "y", "xx", "yy", "xy"), 1)])

    def c(a: str, b: str, ab: str) -> Column:
        return F.col("n") * F.col(ab) * float(scale) - F.col(a) * F.col(b)

    return wide.select("block", F.col("n").cast("long").alias("n"), (c("x", "y", "xy") / F.sqrt(c("x", "x", "xx") * c("y", "y", "yy"))).alias("correlation"))


def one_row_a_unit(df: DataFrame, unit: str, most: int) -> DataFrame:
    """``df``, refused if a unit is null, blank or has several rows, or if there are more than ``most`` rows."""
    per = df.groupBy(F.col(unit).alias("u")).agg(F.count(F.lit(1)).alias("n"))
    over = (F.count_if(bound.blank(F.col("u"))) > 0) | (F.coalesce(F.max("n"), F.lit(0)) > 1) | (F.count(F.lit(1)) > most)
    passed = bound.refused_if(F.col("_bad"), "rows must be of different units") & (F.spark_partition_id() >= 0)
    return df.crossJoin(F.broadcast(per.agg(over.alias("_bad")))).where(passed).drop("_bad")  # one row


def frequency(df: DataFrame, levels: tuple[str, ...], column: str) -> DataFrame:
    """``level, n`` for every declared level; other values are passed over."""
    spark: SparkSession = df.sparkSession
    domain = spark.createDataFrame([(i, x) for i, x in enumerate(sorted(levels, key=str.encode), 1)], "coord long, level string")
    n = df.groupBy(F.col(column).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return domain.join(n, "level", "left").select("coord", "level", F.coalesce("n", F.lit(0)).alias("n"))


def numeric_by_category(units: DataFrame, policy: Policy, column: str, category: str, v: str = "v", level: str = "level", name: str | None = None) -> DataFrame:
    """Moments of a column within every declared level of a category, levels one after the other."""
    z, s = _z(policy, column, F.col(v)), policy.scale
    terms = [_sum(t, (F.col(level) == x) & F.col(v).isNotNull()) for x in policy.levels[category] for t in (F.lit(1), lattice(z, s), lattice(z * z, s))]
    return _block(units, name or f"numeric_by_category:{column},{category}", terms)


def cross_moment(units: DataFrame, policy: Policy, x: str, y: str, name: str | None = None) -> DataFrame:
    """Count and sum of products over units that have both values, columns named as in the policy."""
    both, term = _complete(x, y), lattice(_z(policy, x, F.col(x)) * _z(policy, y, F.col(y)), policy.scale)
    return _block(units, name or f"numeric_cross_moment:{x},{y}", [_sum(F.lit(1), both), _sum(term, both)])


def vector(parts: list[DataFrame]) -> DataFrame:
    """Blocks one after the other: adds ``at`` by block order, which is fixed before any data are read."""
    out = None
    for i, b in enumerate(parts):
        part = b.select(F.lit(i).alias("at"), "block", "coord", "value")
        out = part if out is None else out.unionByName(part)
    return out
