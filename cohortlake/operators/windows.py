"""Ordered operators: running sums, neighbours within a cluster, person-periods and risk sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.policy import Disclosure, Refused
from . import ranges
from .bound import refused_if


def running_sum(df: DataFrame, value: Column, order: list[str], strata: list[str] | None = None, reverse: bool = False, name: str = "running", mask: Column | None = None, parts: int = 200) -> DataFrame:
    """Running sum over the rows in ``order``, within strata if there are any, from the first row or, in reverse, from the last.

    Rows whose ``mask`` is not 1 add nothing. Rows are dealt to ranges of
    strata and order, so neither the whole table nor a large stratum is one
    task's. A stratum that lies in several ranges is that of one of their
    bounds; its sums of the ranges before (or behind) are added.
    """
    strata = list(strata or [])
    term = value if mask is None else F.when(mask == 1, value).otherwise(F.lit(0))
    d, cuts = ranges.searched(df.withColumn("_term", term), [*strata, *order], parts)
    # a frame to the end is summed anew for each row, so in reverse the rows are sorted from the last one
    w = Window.partitionBy(ranges.PART, *strata).orderBy(*[F.col(c).desc_nulls_last() if reverse else F.col(c).asc_nulls_first() for c in order])
    d = d.withColumn("_own", F.sum("_term").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    divided = _divided(d, strata, cuts)
    if divided is None:
        return d.withColumn(name, F.col("_own")).drop("_term", "_own", ranges.PART)
    aside = Window.partitionBy(*[f"_s{i}" for i in range(len(strata))]).orderBy(F.col(ranges.PART).desc() if reverse else F.col(ranges.PART))
    offsets = divided.withColumn("_add", F.sum("_sum").over(aside.rowsBetween(Window.unboundedPreceding, -1))).drop("_sum")
    same = d[ranges.PART] == offsets[ranges.PART]
    for i, c in enumerate(strata):
        same = same & d[c].eqNullSafe(offsets[f"_s{i}"])
    kept = [d[c] for c in df.columns if c != name]
    return d.join(F.broadcast(offsets), same, "left").select(*kept, F.coalesce(F.col("_own") + F.col("_add"), "_own", "_add").alias(name))


def _divided(d: DataFrame, strata: list[str], cuts: list) -> DataFrame | None:
    """Sums of ``_term`` by range of the strata of the bounds: at most two rows a range, and one a bound."""
    if not cuts:
        return None
    if not strata:
        return d.groupBy(ranges.PART).agg(F.sum("_term").alias("_sum"))
    values = {tuple(c[: len(strata)]) for c in cuts}
    held = d.sparkSession.createDataFrame(list(values), ", ".join(f"_h{i} {d.schema[c].dataType.simpleString()}" for i, c in enumerate(strata)))
    same = F.lit(True)
    for i, c in enumerate(strata):
        same = same & d[c].eqNullSafe(held[f"_h{i}"])
    own = d.join(F.broadcast(held), same, "left_semi")
    return own.groupBy(ranges.PART, *[F.col(c).alias(f"_s{i}") for i, c in enumerate(strata)]).agg(F.sum("_term").alias("_sum"))


def grouped_running_sum(df: DataFrame, key: str, values: dict[str, Column], reverse: bool = False, parts: int = 200) -> DataFrame:
    """Running sums over the distinct keys: rows are summed by key first, so only one row a key is ordered, range by range."""
    per = df.groupBy(F.col(key).alias("key")).agg(*[F.sum(v).alias(n) for n, v in values.items()])
    d, _ = ranges.ranged(per, ["key"], parts)
    order = F.col("key").desc() if reverse else F.col("key").asc()
    w = Window.partitionBy(ranges.PART).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = d.groupBy(ranges.PART).agg(*[F.sum(n).alias(f"_t_{n}") for n in values])
    before = Window.orderBy(F.col(ranges.PART).desc() if reverse else F.col(ranges.PART)).rowsBetween(Window.unboundedPreceding, -1)  # over ranges
    offsets = total.select(ranges.PART, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values])
    own = d.select(ranges.PART, "key", *[F.sum(n).over(w).alias(n) for n in values])
    return own.join(F.broadcast(offsets), ranges.PART).select("key", *[(F.col(n) + F.col(f"_o_{n}")).alias(n) for n in values])


def neighbours(df: DataFrame, cluster: str, order: list[str], value: str) -> DataFrame:
    """Lag and lead (0 where there is none) and flags for rows with both, a next and a previous one; the order must be strict."""
    w = Window.partitionBy(cluster).orderBy(*order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    has = [F.lag(F.lit(1)).over(w).isNotNull(), F.lead(F.lit(1)).over(w).isNotNull()]
    v, zero = F.col(value), F.lit(0).cast(df.schema[value].dataType)
    return df.select(
        "*",
        F.coalesce(before, zero).alias("lag"),
        F.coalesce(after, zero).alias("lead"),
        F.when(has[0], v).otherwise(zero).alias("nonfirst"),
        F.when(has[1], v).otherwise(zero).alias("nonlast"),
        F.when(has[0] & has[1], v).otherwise(zero).alias("interior"),
    )


def check_strict_order(df: DataFrame, cluster: str, order: list[str]) -> None:
    if not df.groupBy(cluster, *order).count().where("count > 1").isEmpty():
        raise Refused("the order within a cluster has ties")


def dense_ids(df: DataFrame, column: str, name: str, parts: int = 200) -> DataFrame:
    """Numbers from 1 by the sorted distinct values; only distinct values are ordered, range by range. Rows with a null have none."""
    ids = df.select(column).where(F.col(column).isNotNull()).distinct()
    ids = ranges.numbered(ids, [column], "_id", parts).select(F.col(column).alias("_v"), (F.col("_id") + 1).cast("int").alias(name))
    return df.join(ids, df[column] == ids["_v"], "left").drop("_v")


def broadcast_clusters(owner: DataFrame, unit: str, cluster: str, other: DataFrame, other_unit: str, guard: Disclosure, name: str = "cluster_id", parts: int = 200) -> DataFrame:
    """The other owner's rows with the number of their unit's cluster at the first owner.

    Clusters are numbered from 1 in order. Missing clusters and clusters below
    the floor fail the query before any row is returned.
    """
    ids = dense_ids(owner.select(unit, cluster), cluster, name, parts).select(F.col(unit).alias("_unit"), cluster, name)
    sizes = owner.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    bad = sizes.agg((F.count_if(F.col(cluster).isNull()) > 0).alias("_missing"), (F.min("n") < guard.floor).alias("_small"))
    passed = refused_if(F.col("_missing"), "a cluster is missing") & refused_if(F.col("_small"), "a cluster is too small")
    joined = other.join(ids.drop(cluster), other[other_unit] == F.col("_unit")).drop("_unit")
    return joined.crossJoin(F.broadcast(bad)).where(passed).drop("_missing", "_small")  # one row


def person_periods(df: DataFrame, time: str, event: Column, breaks: list[float]) -> DataFrame:
    """A row for each right-closed bin at whose start the row is at risk: ``bin, at_risk, event``."""
    end = F.lit(1)
    for b in breaks[:-1]:
        end = end + F.when(F.col(time) > b, 1).otherwise(0)
    d = df.withColumn("_end", end).withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(len(breaks)))))
    return d.withColumn("at_risk", (F.col("bin") <= F.col("_end")).cast("int")).withColumn("event", (event & (F.col("bin") == F.col("_end"))).cast("int")).drop("_end")


def check_risk_sets(periods: DataFrame, guard: Disclosure) -> None:
    got = periods.groupBy("bin").agg(F.sum("at_risk").alias("n")).agg(F.min(F.when(F.col("n") > 0, F.col("n")))).first()[0]
    guard.check_clusters(got)


def event_time_mask(df: DataFrame, time: str, event: Column, most: int = 10_000) -> DataFrame:
    """Rows by distinct event time up to their own time: ``tick`` and whether the row's event is there (``event``).

    Event times are collected and refused beyond ``most``, so the masks' width
    is bounded; a row is exploded only to the ticks at which it is at risk.
    """
    ticks = df.where(event).select(F.col(time).cast("double").alias("t")).distinct().limit(most + 1).collect()
    if len(ticks) > most:
        raise Refused("too many event times")
    grid = F.array(*[F.lit(t) for t in sorted(r["t"] for r in ticks)]).cast("array<double>")
    d = df.withColumn("tick", F.explode(F.filter(grid, lambda g: F.col(time) >= g)))
    return d.withColumn("event", (event & (F.col("tick") == F.col(time))).cast("int"))


def risk_sums(df: DataFrame, entry: Column, stop: Column, event: Column, x: Column | list[Column], beta: float | list[float], grid: list[float]) -> DataFrame:
    """For each tick g of ``grid``: events that stop in its interval, and weighted sums over rows with entry < g <= stop.

    One covariate gives ``sum_x, s0, s1, s2``; a list gives arrays ``sum_x``,
    ``s1`` and ``s2`` (upper triangle by columns). Ticks are few and public:
    each row is exploded only to the ticks at which it is at risk, then summed
    by tick, which combines before the exchange. Ticks without anyone at risk
    have zeros, so the shape never depends on the data.
    """
    xs, betas = (x, list(beta)) if isinstance(x, list) else ([x], [beta])
    names = [f"x{i}" for i in range(len(xs))]
    ticks = F.array_compact(F.array(*[F.when((entry < g) & (stop >= g), F.lit(float(g))) for g in grid]))
    final = F.array_max(F.array(*[F.when(stop >= g, F.lit(float(g))) for g in grid]))
    rows = df.select(final.alias("final"), event.alias("event"), *[c.cast("double").alias(n) for c, n in zip(xs, names, strict=True)], ticks.alias("ticks"))
    d = rows.select("final", "event", *names, F.explode("ticks").alias("tick"))
    eta = F.lit(0.0)
    for n, b in zip(names, betas, strict=True):
        eta = eta + F.lit(float(b)) * F.col(n)
    w, dies = F.exp(eta), F.col("event") & (F.col("tick") == F.col("final"))
    upper = [(a, b) for j, b in enumerate(names) for a in names[: j + 1]]
    sums = {"sum_x": [F.sum(F.when(dies, F.col(n)).otherwise(0.0)) for n in names], "s1": [F.sum(w * F.col(n)) for n in names], "s2": [F.sum(w * F.col(a) * F.col(b)) for a, b in upper]}
    flat = {f"{k}_{i}": t for k, own in sums.items() for i, t in enumerate(own)}
    got = d.groupBy("tick").agg(F.count(F.lit(1)).alias("at_risk"), F.count_if(dies).alias("events"), F.sum(w).alias("s0"), *[t.alias(n) for n, t in flat.items()])
    domain = df.sparkSession.createDataFrame([(float(g),) for g in grid], "tick double")
    got = domain.join(F.broadcast(got), "tick", "left").na.fill(0)  # one row a tick
    if not isinstance(x, list):
        return got.select("tick", "at_risk", "events", F.col("sum_x_0").alias("sum_x"), "s0", F.col("s1_0").alias("s1"), F.col("s2_0").alias("s2"))
    return got.select("tick", "at_risk", "events", "s0", *[F.array(*[f"{k}_{i}" for i in range(len(own))]).alias(k) for k, own in sums.items()])


def permute(df: DataFrame, position: str, permutation: DataFrame) -> DataFrame:
    """Rows at the new positions of ``permutation`` (``source, target``)."""
    p = permutation.select(F.col("source").alias(position), "target")
    return df.join(p, position).drop(position).withColumnRenamed("target", position)
