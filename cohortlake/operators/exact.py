"""Exact aggregates behind small-cell guards."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import digamma, finite, trigamma
from ..plans.policy import Disclosure, Refused
from . import ranges
from .bound import refused_if


def observation_count(df: DataFrame, columns: list[str] | None, guard: Disclosure) -> DataFrame:
    """Rows, or rows without nulls in ``columns``; null below the floor."""
    d = df.dropna(subset=columns) if columns else df
    return d.agg(F.count(F.lit(1)).alias("n")).select(F.when(F.col("n") >= guard.floor, F.col("n")).alias("n_obs"))


def complete_cases(df: DataFrame, columns: list[str] | None = None, ids: tuple[str, ...] = ("id", "patient_id")) -> DataFrame:
    """Rows without nulls; identifiers are not looked at unless named."""
    return df.dropna(subset=columns or [c for c in df.columns if c not in ids])


def complete_case_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("n_before"), F.count_if(whole).alias("n_after")).select("n_before", "n_after", (F.col("n_before") - F.col("n_after")).alias("n_dropped"))


def crosstab(df: DataFrame, a: str, b: str, most_levels: int = 1000) -> DataFrame:
    """``a, b, n, na, nb``: counts of all pairs of observed levels over complete rows, with both margins.

    The levels are taken from the counts, one pass over the table; more than
    ``most_levels`` of either column are refused, which bounds the table.
    """
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    counts = d.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    cells = counts.agg(F.collect_set("a").alias("as"), F.collect_set("b").alias("bs"), F.map_from_entries(F.collect_list(F.struct(F.struct("a", "b"), "n"))).alias("n"))
    few = refused_if((F.size("as") > most_levels) | (F.size("bs") > most_levels), "too many levels")
    wide = cells.where(few).select("n", "bs", F.explode("as").alias("a")).select("n", "a", F.explode("bs").alias("b"))
    whole = wide.select("a", "b", F.coalesce(F.element_at("n", F.struct("a", "b")), F.lit(0)).cast("long").alias("n"))
    rows, cols = (Window.partitionBy(c).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing) for c in ("a", "b"))
    return whole.withColumn("na", F.sum("n").over(rows)).withColumn("nb", F.sum("n").over(cols))


def contingency(df: DataFrame, a: str, b: str, guard: Disclosure, suppress: bool = False) -> DataFrame:
    """``a, b, n`` for all observed levels over complete rows, ``row_total``, ``col_total`` and ``suppressed``.

    A cell or margin from 1 to below the floor refuses the table; with
    ``suppress`` it becomes 0, its flag is set, and the level of a small margin
    is masked. Small cells beside open margins could be told from them, so the
    margins of rows and columns that hold one are withheld too.
    """
    cells, floor = crosstab(df, a, b), guard.min_cell
    tiny = (F.col("n") > 0) & (F.col("n") < floor)
    small = tiny | (F.col("na") < floor) | (F.col("nb") < floor)
    if not suppress:
        bad = cells.agg(F.max(small).alias("_bad"))
        kept = cells.crossJoin(F.broadcast(bad)).where(refused_if(F.col("_bad"), "a cell is too small"))  # one row
        return kept.select("a", "b", "n", F.col("na").alias("row_total"), F.col("nb").alias("col_total"), F.lit(False).alias("suppressed"))
    rows, cols = (Window.partitionBy(c).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing) for c in ("a", "b"))
    d = cells.withColumn("_s", small).withColumn("_ra", F.max("_s").over(rows)).withColumn("_cb", F.max("_s").over(cols))

    def label(c: str, total: str):
        return F.when(F.col(total) < floor, F.lit("<suppressed>")).otherwise(F.col(c).cast("string")).alias(c)

    return d.select(label("a", "na"), label("b", "nb"), F.when(F.col("_s"), 0).otherwise(F.col("n")).alias("n"), F.when(~F.col("_ra"), F.col("na")).alias("row_total"), F.when(~F.col("_cb"), F.col("nb")).alias("col_total"), F.col("_s").alias("suppressed"))


def contingency_totals(df: DataFrame, a: str, b: str, guard: Disclosure) -> DataFrame:
    """``n`` complete rows (null below the floor) and ``n_na`` others."""
    whole = F.col(a).isNotNull() & F.col(b).isNotNull()
    got = df.agg(F.count_if(whole).alias("n"), F.count_if(~whole).alias("n_na"))
    return got.select(F.when(F.col("n") >= guard.floor, F.col("n")).alias("n"), "n_na")


def joint_release(tables: list[tuple[DataFrame, str, str]], guard: Disclosure) -> DataFrame:
    """``item, a, b, n`` of several tables, all or none: refused if any positive cell or margin of any of them is below the floor."""
    out = None
    for i, (df, a, b) in enumerate(tables):
        part = crosstab(df, a, b).select(F.lit(i).alias("item"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "n", "na", "nb")
        out = part if out is None else out.unionByName(part)
    least = F.least(F.min(F.when(F.col("n") > 0, F.col("n"))), F.min("na"), F.min("nb"))
    bad = out.agg(F.coalesce(least < guard.min_cell, F.lit(False)).alias("_bad"))
    return out.crossJoin(F.broadcast(bad)).where(refused_if(F.col("_bad"), "a cell is too small")).select("item", "a", "b", "n")  # one row


def chi_square(cells: DataFrame) -> DataFrame:
    """``chi2, df`` of a whole table of counts (``a, b, n``)."""
    rows, cols = Window.partitionBy("a"), Window.partitionBy("b")
    d = cells.withColumn("_a", F.sum("n").over(rows)).withColumn("_b", F.sum("n").over(cols))
    d = d.crossJoin(F.broadcast(cells.agg(F.sum("n").alias("_n"), F.countDistinct("a").alias("_r"), F.countDistinct("b").alias("_c"))))  # one row
    e = F.col("_a") * F.col("_b") / F.col("_n")
    return d.agg(F.sum((F.col("n") - e) * (F.col("n") - e) / e).alias("chi2"), ((F.max("_r") - 1) * (F.max("_c") - 1)).cast("long").alias("df"))


def histogram(df: DataFrame, column: str, edges: list[float], guard: Disclosure, suppress: bool = True) -> DataFrame:
    """``bin, n`` by left-closed bins, the last closed on both sides; bin 0 counts what is below, bin k + 1 what is above, bin -1 the nulls."""
    if not 2 <= len(edges) <= 1001 or any(a >= b for a, b in zip(edges, edges[1:], strict=False)):
        raise ValueError("edges must ascend")
    x, k = F.col(column).cast("double"), len(edges) - 1
    tests = {-1: x.isNull() | F.isnan(x), 0: x < edges[0], k + 1: x > edges[-1]}
    for i in range(k):
        tests[i + 1] = (x >= edges[i]) & ((x <= edges[i + 1]) if i == k - 1 else (x < edges[i + 1]))
    keys = sorted(tests)
    got = df.agg(*[F.count_if(tests[i]).alias(f"n{i}") for i in keys])
    out = got.select(F.explode(F.array(*[F.struct(F.lit(i).alias("bin"), F.col(f"n{i}").alias("n")) for i in keys])).alias("c")).select("c.bin", "c.n")
    small = (F.col("bin") > 0) & (F.col("bin") <= k) & (F.col("n") > 0) & (F.col("n") < guard.min_cell)
    if not suppress and not out.where(small).isEmpty():
        raise Refused("a bin is too small")
    return out.withColumn("n", F.when(small, 0).otherwise(F.col("n")))


def local_moments(df: DataFrame, column: str, guard: Disclosure, extrema: bool = False) -> DataFrame:
    """n, mean and standard deviation (and extrema) of finite values; nulls below the floor."""
    x = F.when(finite(F.col(column)), F.col(column).cast("double"))
    parts = {"mean": F.avg(x), "sd": F.stddev_samp(x)} | ({"lo": F.min(x), "hi": F.max(x)} if extrema else {})
    got = df.agg(F.count(x).alias("n"), *[v.alias(k) for k, v in parts.items()])
    return got.select("n", *[F.when(F.col("n") >= guard.floor, F.col(k)).alias(k) for k in parts])


def nb_moments(df: DataFrame, column: str) -> DataFrame:
    y = F.col(column).cast("double")
    return df.agg(F.count(y).alias("n"), F.sum(y).alias("sum_y"), F.sum(y * y).alias("sum_y2"), F.avg(y).alias("mean"), F.var_samp(y).alias("variance"))


def nb_profile(df: DataFrame, column: str, theta: float) -> DataFrame:
    """Sums of psi(y + theta) and psi'(y + theta): values are counted first, so each function is taken once for each distinct y."""
    y = F.col(column).cast("double")
    counts = df.where(y.isNotNull()).groupBy(y.alias("y")).agg(F.count(F.lit(1)).alias("n"))
    at = F.col("y") + F.lit(float(theta))
    return counts.agg(F.sum("n").alias("n"), F.sum(F.col("n") * digamma(at)).alias("sum_psi"), F.sum(F.col("n") * trigamma(at)).alias("sum_psi1"))


def _guarded(per_cluster: DataFrame, guard: Disclosure, n: str) -> DataFrame:
    """Per-cluster rows, refused before any is returned if a cluster has fewer rows than the floor."""
    bad = per_cluster.agg((F.min(n) < guard.floor).alias("_bad"))
    passed = refused_if(F.col("_bad"), "a cluster is too small") & (F.spark_partition_id() >= 0)
    return per_cluster.crossJoin(F.broadcast(bad)).where(passed).drop("_bad")  # one row


def cluster_sizes(df: DataFrame, cluster: str, guard: Disclosure) -> DataFrame:
    """Rows of each cluster; refused if one is below the floor."""
    return _guarded(df.groupBy(F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("n")), guard, "n")


def cluster_residuals(df: DataFrame, cluster: str, residual: Column, guard: Disclosure) -> DataFrame:
    """Sums of residuals and their squares by cluster; refused if a cluster is below the floor."""
    d = df.select(F.col(cluster).alias("cluster"), residual.alias("r"))
    per = d.groupBy("cluster").agg(F.sum("r").alias("sum_r"), F.sum(F.col("r") * F.col("r")).alias("sum_r2"), F.count("r").alias("n"))
    return _guarded(per, guard, "n")


def cluster_ztz(df: DataFrame, cluster: str, slopes: list[Column], guard: Disclosure) -> DataFrame:
    """Z'Z of each cluster for the intercept and the slopes: upper triangle by columns; refused if a cluster is below the floor."""
    z = [F.lit(1.0), *slopes]
    d = df.select(F.col(cluster).alias("cluster"), *[c.alias(f"z{i}") for i, c in enumerate(z)])
    per = d.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"z{i}{j}") for j in range(len(z)) for i in range(j + 1)])
    return _guarded(per, guard, "_n").drop("_n")


def column_sums(df: DataFrame, vector: str, guard: Disclosure, name: str = "value") -> DataFrame:
    """``j, value``: sums of the columns of a matrix whose rows are arrays; refused over too few rows."""
    per = df.select(F.posexplode(vector).alias("j", "v")).groupBy("j").agg(F.sum("v").alias(name), F.count("v").alias("n"))
    return _guarded(per, guard, "n").select("j", name)


def stored_sums(parts: list[tuple[str, DataFrame, Column]], guard: Disclosure) -> DataFrame:
    """``key, position, total``: sums kept under a key, in the order in which they are appended; each is refused over too few rows."""
    out, seen = None, {}
    for key, df, value in parts:
        at = seen[key] = seen.get(key, -1) + 1
        got = df.agg(F.sum(value).alias("total"), F.count(value).alias("_n")).where(refused_if(F.col("_n") < guard.floor, "too few rows"))
        part = got.select(F.lit(key).alias("key"), F.lit(at).alias("position"), F.col("total").cast("double").alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


def variance_components(df: DataFrame, y: str, cluster: str) -> DataFrame:
    """One-way analysis of variance: k clusters, n rows, mean, within and between sums of squares."""
    v = F.col(y).cast("double")
    per = df.where(v.isNotNull()).groupBy(cluster).agg(F.count(v).alias("n"), F.sum(v).alias("s"), (F.var_pop(v) * F.count(v)).alias("ssw"))
    mean = F.col("s") / F.col("n")
    got = per.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ssw").alias("ssw"), F.sum(F.col("n") * mean * mean).alias("q"))
    return got.select("k", "n", (F.col("s") / F.col("n")).alias("mean"), "ssw", (F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("ssb"))


def within_covariance(df: DataFrame, columns: list[str], cluster: str) -> DataFrame:
    """Pooled cross products about the cluster means: ``i, j, value``, and the degrees of freedom.

    From per-cluster sums, n and products: two aggregations, no window over clusters.
    """
    d = df.dropna(subset=columns)
    k = range(len(columns))
    x = [F.col(c).cast("double") for c in columns]
    per = d.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for j in k for i in range(j + 1)]).where("n > 1")
    got = per.agg(F.sum(F.col("n") - 1).alias("df"), *[F.sum(F.col("n") * F.col(f"c{i}_{j}")).alias(f"c{i}_{j}") for j in k for i in range(j + 1)])
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}_{j}").alias("value")) for j in k for i in range(j + 1)]
    return got.select("df", F.explode(F.array(*cells)).alias("c")).select("c.i", "c.j", "c.value", "df")


def gram(df: DataFrame, columns: list[Column], y: Column | None = None, guard: Disclosure | None = None) -> DataFrame:
    """``i, j, value``: X'X by columns, then with j = -1 X'y, and (-1, -1) y'y; with a guard, refused if there are too many columns for the rows."""
    terms = {(i, j): columns[i] * columns[j] for j in range(len(columns)) for i in range(j + 1)}
    if y is not None:
        terms |= {(i, -1): x * y for i, x in enumerate(columns)} | {(-1, -1): y * y}
    got = df.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(t).alias(f"g{n}") for n, t in enumerate(terms.values())])
    if guard is not None:
        got = got.where(refused_if(guard.too_wide(F.col("_n"), len(columns)), "too many columns for the rows"))
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"g{n}").alias("value")) for n, (i, j) in enumerate(terms)]
    return got.select(F.explode(F.array(*cells)).alias("c")).select("c.i", "c.j", "c.value")


def gls_gram(df: DataFrame, columns: list[str], y: str | None, cluster: str, shares: DataFrame, guard: Disclosure, unit_length: bool = False, scales: dict[str, float] | None = None) -> DataFrame:
    """The Gram matrix of columns transformed by their cluster's share, the intercept last.

    ``scales`` divide raw columns; ``unit_length`` divides the transformed
    ones (not y) by their length. Returns ``i, j, value`` as :func:`gram` and,
    with i = -2, the length that column j was divided by.
    """
    raw = df.select(*df.columns)
    for c, k in (scales or {}).items():
        raw = raw.withColumn(c, F.col(c).cast("double") / F.lit(float(k)))
    d = gls_transform(raw, [*columns, *([y] if y else [])], cluster, shares)
    names = [f"{c}_t" for c in columns] + ["intercept_t"]
    got = gram(d, [F.col(n) for n in names], F.col(f"{y}_t") if y else None, guard)
    if not unit_length:
        return got
    lengths = got.where("i = j and i >= 0").select(F.col("i").alias("k"), F.sqrt("value").alias("length"))
    lengths = lengths.select("k", F.when(F.col("length") > 0, F.col("length")).otherwise(1.0).alias("length"))
    own = F.broadcast(lengths)  # one row a column
    left, right = own.select(F.col("k").alias("i"), F.col("length").alias("_a")), own.select(F.col("k").alias("j"), F.col("length").alias("_b"))
    scaled = got.join(left, "i", "left").join(right, "j", "left").select("i", "j", (F.col("value") / F.coalesce("_a", F.lit(1.0)) / F.coalesce("_b", F.lit(1.0))).alias("value"))
    return scaled.unionByName(lengths.select(F.lit(-2).alias("i"), F.col("k").alias("j"), F.col("length").alias("value")))


def cross_product(left: DataFrame, left_id: str, x: str, right: DataFrame, right_id: str, y: str, guard: Disclosure) -> DataFrame:
    """``n, xy``: the inner product of two owners' columns over matched units; refused over too few."""
    a, b = left.select(F.col(left_id).alias("_id"), F.col(x).alias("_x")), right.select(F.col(right_id).alias("_id"), F.col(y).alias("_y"))
    got = a.join(b, "_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_x") * F.col("_y")).alias("xy"))
    return got.where(refused_if(F.col("n") < guard.floor, "too few rows"))


def segment_sums(df: DataFrame, position: str, value: str, length: int) -> DataFrame:
    """Sums of consecutive segments of a long vector (positions from 0)."""
    return df.groupBy(F.floor(F.col(position) / length).alias("segment")).agg(F.sum(value).alias("total"))


def guarded_sum(df: DataFrame, value: Column, guard: Disclosure, name: str = "total") -> DataFrame:
    """One row with the sum; refused over too few rows."""
    got = df.agg(F.sum(value).alias(name), F.count(value).alias("_n"))
    return got.where(refused_if(F.col("_n") < guard.floor, "too few rows")).select(name)


def level_names(column: str, levels: list[str], prefix: str | None = None) -> list[str]:
    """Names for dummies: all but letters, digits, dots and underscores become dots; names that meet get a number."""
    out: list[str] = []
    for x in levels:
        name = plain = f"{prefix or column}{re.sub(r'[^A-Za-z0-9._]', '.', x)}"
        n = 1
        while name in out:
            name, n = f"{plain}.{n}", n + 1
        out.append(name)
    return out


def _no_small_level(df: DataFrame, column: str, levels: list[str], guard: Disclosure) -> DataFrame:
    """``df``, refused if a level has rows, but fewer than the floor."""
    counts = [F.count_if(F.col(column) == x) for x in levels]
    small = F.lit(False)
    for c in counts:
        small = small | ((c > 0) & (c < guard.min_cell))
    bad = df.agg(small.alias("_bad"))
    return df.crossJoin(F.broadcast(bad)).where(refused_if(F.col("_bad"), "a level is too small") & (F.spark_partition_id() >= 0)).drop("_bad")  # one row


def factor_dummies(df: DataFrame, column: str, levels: list[str], guard: Disclosure, drop_first: bool = True, prefix: str | None = None) -> DataFrame:
    """0/1 columns for the levels in byte order; nulls give zeros. Refused if a level has rows, but fewer than the floor."""
    kept = sorted(levels, key=str.encode)[1 if drop_first else 0 :]
    d = _no_small_level(df, column, levels, guard)
    return d.select("*", *[F.when(F.col(column) == x, 1).otherwise(0).alias(n) for x, n in zip(kept, level_names(column, kept, prefix), strict=True)])


def one_hot_margins(df: DataFrame, column: str, levels: list[str], guard: Disclosure) -> DataFrame:
    """``level, n`` over rows that are not null; refused if a level has fewer rows than the floor."""
    got = df.agg(*[F.count_if(F.col(column) == x).alias(f"n{i}") for i, x in enumerate(levels)])
    small = F.exists(F.array(*[f"n{i}" for i in range(len(levels))]), lambda n: (n > 0) & (n < guard.min_cell))
    return got.where(refused_if(small, "a level is too small")).select(F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(f"n{i}").alias("n")) for i, x in enumerate(levels)])).alias("c")).select("c.level", "c.n")


def one_hot(df: DataFrame, column: str, levels: list[str], guard: Disclosure) -> DataFrame:
    """Rows that are not null with ``one_hot``, a 0/1 array over the levels; refused if a level has rows, but fewer than the floor."""
    return _no_small_level(df, column, levels, guard).where(F.col(column).isNotNull()).withColumn("one_hot", F.array(*[(F.col(column) == x).cast("int") for x in levels]))


def standardise(df: DataFrame, columns: list[str], mode: str = "full", missing: str = "fail") -> DataFrame:
    """Columns scaled in place: ``full`` (x - mean) / sd, ``scale_only`` x / sd, ``none`` x; an sd below 1e-10 counts as 1.

    Missing and non-finite values refuse the table, or with ``mean`` take the mean first.
    """
    xs = {c: F.when(finite(F.col(c)), F.col(c).cast("double")) for c in columns}
    got = df.agg(F.count(F.lit(1)).alias("n"), *[f(x).alias(f"{k}_{c}") for c, x in xs.items() for k, f in (("m", F.avg), ("s", F.stddev_samp), ("n", F.count))]).first()
    out = {}
    for c, x in xs.items():
        mean, sd = got[f"m_{c}"], got[f"s_{c}"]
        if got[f"n_{c}"] < got["n"] and missing == "fail":
            raise Refused("values are missing")
        sd = 1.0 if sd is None or sd < 1e-10 else sd
        v = F.coalesce(x, F.lit(mean)) if missing == "mean" else x
        out[c] = {"full": (v - F.lit(mean)) / F.lit(sd), "scale_only": v / F.lit(sd), "none": v}[mode]
    return df.withColumns(out)


def quantiles(df: DataFrame, column: str, shares: list[float], parts: int = 200) -> list[float]:
    """Interpolated quantiles of the values that are not null: only the ranges of values that hold them are ordered."""
    d = df.select(F.col(column).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    n = d.count()
    if not n:
        return [None] * len(shares)
    places = [(n - 1) * p for p in shares]
    got = ranges.values_at(d, "_x", sorted({int(f(x)) for x in places for f in (math.floor, math.ceil)}), parts)
    return [got[math.floor(x)] + (x - math.floor(x)) * (got[math.ceil(x)] - got[math.floor(x)]) for x in places]


def quartiles(df: DataFrame, column: str, name: str, parts: int = 200) -> DataFrame:
    """Q1 to Q4 by interpolated quantiles, right-closed, the least value in Q1."""
    q = quantiles(df, column, [0.25, 0.5, 0.75], parts)
    x = F.col(column).cast("double")
    return df.withColumn(name, F.when(x.isNull(), None).when(x <= q[0], "Q1").when(x <= q[1], "Q2").when(x <= q[2], "Q3").otherwise("Q4"))


def _hashed(id_col: str, salt: str) -> Column:
    """A whole number below 2^48 from the salted MD5 of an identifier, which SQL engines share."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col(id_col).cast("string"))), 1, 12), 16, 10).cast("long")


def hash_clusters(df: DataFrame, id_col: str, clusters: int, name: str = "cluster") -> DataFrame:
    """A cluster from 1 by the identifier's hash, whatever the order of rows."""
    return df.withColumn(name, (_hashed(id_col, "") % clusters + 1).cast("int"))


def block_clusters(df: DataFrame, position: str, size: int, name: str = "cluster") -> DataFrame:
    return df.withColumn(name, (F.floor(F.col(position) / size) + 1).cast("int"))


def inject_nulls(df: DataFrame, column: str, id_col: str, fraction: float, seed: int, name: str | None = None) -> DataFrame:
    """Null for the share of rows whose seeded hash of the identifier is low."""
    low = _hashed(id_col, f"{seed}|") % 1_000_000 < int(fraction * 1_000_000)
    return df.withColumn(name or column, F.when(~low, F.col(column)))


def synthetic_survival(df: DataFrame, id_col: str, covariate: str, beta: float = 0.05, scale: float = 20.0, event_rate: float = 0.6, seed: int = 13) -> DataFrame:
    """Exponential times and Bernoulli events from hashes of the identifier."""
    u = [(_hashed(id_col, f"{seed}|{i}|") + 0.5) / float(1 << 48) for i in (1, 2)]
    return df.withColumn("time", -F.ln(u[0]) * scale * F.exp(-beta * F.col(covariate))).withColumn("event", (u[1] < event_rate).cast("int"))


def expand_cluster_weights(df: DataFrame, cluster: str, weights: DataFrame, name: str = "w") -> DataFrame:
    """The cluster's weight (``cluster, w``) for every row; 1 where there is none."""
    w = weights.select(F.col("cluster").alias(cluster), F.col("w").alias("_w"))
    return df.join(w, cluster, "left").withColumn(name, F.coalesce("_w", F.lit(1.0))).drop("_w")


def gls_transform(df: DataFrame, columns: list[str], cluster: str, shares: DataFrame, suffix: str = "_t") -> DataFrame:
    """x less its cluster's share of the cluster mean (0 where that is null), and the transformed intercept.

    ``shares``: ``cluster, share`` for each cluster; rows of a cluster without
    one, or of a null cluster, get zeros and the intercept 1. Means pass over nulls.
    """
    means = df.groupBy(cluster).agg(*[F.avg(F.col(c).cast("double")).alias(f"_m_{c}") for c in columns])
    means = means.join(shares.select(F.col("cluster").alias("_c"), F.col("share").cast("double").alias("_share")), F.col(cluster) == F.col("_c"), "left").drop("_c").withColumnRenamed(cluster, "_k")
    d = df.join(means, df[cluster].eqNullSafe(means["_k"]))
    out = [F.coalesce(F.col(c).cast("double") - F.col("_share") * F.col(f"_m_{c}"), F.lit(0.0)).alias(c + suffix) for c in columns]
    return d.select(*[df[c] for c in df.columns], *out, F.coalesce(1 - F.col("_share"), F.lit(1.0)).alias("intercept" + suffix))
