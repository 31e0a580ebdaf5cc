"""Admission of units, and one bounded value of each unit.

Every frame of units is gated: if a unit is null or blank, if there are more
units than the policy's capacity, or if a unit has too many records, the query
fails with one message before any row is returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip, finite
from ..plans.policy import Policy, Refused

REFUSAL = "the snapshot does not meet its policy"


def blank(u: Column) -> Column:
    return u.isNull() | (F.trim(u.cast("string")) == "")


def violations(policy: Policy, unit: Column, rows: Column) -> Column:
    """Over a frame with one row a unit: whether the snapshot must be refused. An aggregate."""
    over = (F.count(F.lit(1)) > policy.capacity) | (F.coalesce(F.max(rows), F.lit(0)) > policy.max_records) | (F.count_if(blank(unit)) > 0)
    return over | (F.count(F.lit(1)) != policy.cohort) if policy.cohort is not None else over


def refused_if(bad: Column, message: str = REFUSAL) -> Column:
    """True, or the query fails where ``bad`` holds."""
    return F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))


def gated(units: DataFrame, policy: Policy, rows: str = "_rows") -> DataFrame:
    """``units`` (one row a unit, with its number of records in ``rows``) if the policy admits them all.

    The gate is an aggregate of the same exchange, one row that is met by all
    others. The partition number makes the filter one that the optimizer moves
    no other condition below: a later join's "unit is not null" would otherwise
    take null units away before the gate sees them.
    """
    bad = units.agg(violations(policy, F.col("unit"), F.col(rows)).alias("_bad"))
    passed = refused_if(F.col("_bad")) & (F.spark_partition_id() >= 0)
    return units.crossJoin(F.broadcast(bad)).where(passed).drop("_bad", rows)  # one row


def admitted(df: DataFrame, policy: Policy) -> DataFrame:
    """One row with the number of units, ``n_units``, if the policy admits them."""
    per_unit = df.groupBy(F.col(policy.unit).alias("unit")).agg(F.count(F.lit(1)).alias("_rows"))
    got = per_unit.agg(F.count(F.lit(1)).alias("n_units"), violations(policy, F.col("unit"), F.col("_rows")).alias("_bad"))
    return got.where(refused_if(F.col("_bad"))).select("n_units")


def admit(df: DataFrame, policy: Policy) -> int:
    """The number of units, or one refusal: for a null or blank unit, too many units, or too many records of one."""
    per_unit = df.groupBy(F.col(policy.unit).alias("unit")).agg(F.count(F.lit(1)).alias("_rows"))
    got = per_unit.agg(F.count(F.lit(1)).alias("units"), violations(policy, F.col("unit"), F.col("_rows")).alias("bad")).first()
    if got["bad"]:
        raise Refused(REFUSAL)
    return got["units"]


def _mean(x: Column, digits: int | None, most: float = float("inf")) -> Column:
    """Mean of finite values; with ``digits`` summed in whole numbers of the last digit, so that no order of rows can change it.

    ``most`` bounds the sum's absolute value: what doubles hold exactly is
    summed as longs, anything larger as decimals.
    """
    if digits is None:
        return F.avg(x)
    if most * 10.0**digits < 2**53:
        return F.sum(F.rint(x * F.lit(10.0**digits)).cast("long")) / F.lit(10.0**digits) / F.count(x)
    return F.sum(x.cast(f"decimal(28,{digits})")).cast("double") / F.count(x)


def _most(policy: Policy, column: str) -> float:
    """The largest sum of a unit's clipped values."""
    return max(map(abs, policy.bounds[column])) * policy.max_records


def _per_unit(df: DataFrame, policy: Policy, *aggregates: Column) -> DataFrame:
    return df.groupBy(F.col(policy.unit).alias("unit")).agg(F.count(F.lit(1)).alias("_rows"), *aggregates)


def bounded_numeric(df: DataFrame, policy: Policy, column: str, digits: int | None = None, name: str = "v") -> DataFrame:
    """``unit, v``: the mean of a unit's finite values, each clipped first; null for a unit without any."""
    lo, hi = policy.bounds[column]
    x = F.col(column).cast("double")
    clipped = F.when(finite(x), clip(x, lo, hi))
    per = _per_unit(df, policy, clip(_mean(clipped, digits, _most(policy, column)), lo, hi).alias("_m"), F.count(clipped).alias("_n"))
    return gated(per.select("unit", F.when(F.col("_n") > 0, F.col("_m")).alias(name), "_rows"), policy)


def bounded_numerics(df: DataFrame, policy: Policy, columns: dict[str, str], digits: int | None = None) -> DataFrame:
    """``unit`` and, for every ``name: column``, what :func:`bounded_numeric` gives: one pass over the table."""
    out = {}
    for name, column in columns.items():
        lo, hi = policy.bounds[column]
        x = F.col(column).cast("double")
        clipped = F.when(finite(x), clip(x, lo, hi))
        out[name] = F.when(F.count(clipped) > 0, clip(_mean(clipped, digits, _most(policy, column)), lo, hi)).alias(name)
    return gated(_per_unit(df, policy, *out.values()).select("unit", *out, "_rows"), policy)


def bounded_normalised(df: DataFrame, policy: Policy, column: str, digits: int | None = None, name: str = "z") -> DataFrame:
    """As :func:`bounded_numeric`, but rows are scaled to [0, 1] before the mean."""
    lo, hi = policy.bounds[column]
    x = F.col(column).cast("double")
    z = F.when(finite(x), (clip(x, lo, hi) - lo) / (hi - lo))
    return gated(_per_unit(df, policy, _mean(z, digits, float(policy.max_records)).alias(name)), policy)


def bounded_category(df: DataFrame, policy: Policy, column: str, name: str = "level") -> DataFrame:
    """``unit, level``: the one declared level of a unit's rows; null if it has none or several."""
    c = F.col(column)
    ok = F.when(c.isin(*policy.levels[column]), c)
    per = _per_unit(df, policy, F.min(ok).alias("_a"), F.max(ok).alias("_b"))
    return gated(per.select("unit", F.when(F.col("_a") == F.col("_b"), F.col("_a")).alias(name), "_rows"), policy)


def bounded_pair(df: DataFrame, policy: Policy, row: str, col: str) -> DataFrame:
    """``unit, r, c``: the one declared pair of levels of a unit's rows; nulls if it has none or several."""
    ok = F.when(F.col(row).isin(*policy.levels[row]) & F.col(col).isin(*policy.levels[col]), F.struct(F.col(row).alias("r"), F.col(col).alias("c")))
    both = _per_unit(df, policy, F.min(ok).alias("_a"), F.max(ok).alias("_b"))
    one = F.when(F.col("_a") == F.col("_b"), F.col("_a"))
    return gated(both.select("unit", one.getField("r").alias("r"), one.getField("c").alias("c"), "_rows"), policy)


def survival_key(policy: Policy, time: str, event: str, censor: str, entry: str | None = None) -> Column:
    """A struct whose minimum over a unit's records is the record that counts."""
    t, o = F.col(time).cast("double"), F.col(event)
    levels = [censor, *[x for x in policy.levels[event] if x != censor]]
    valid = finite(t) & F.coalesce(o.isin(*levels), F.lit(False))
    e = F.col(entry).cast("double") if entry else F.lit(0.0)
    if entry:
        valid = valid & finite(e) & (e <= t)
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, levels)), o), F.lit(0))
    return F.struct(
        F.when(~valid, 2).when(o != censor, 0).otherwise(1).alias("kind"),
        F.when(~valid, 0.0).when(o != censor, t).otherwise(-t).alias("at"),
        F.when(rank == 0, F.lit(len(levels) + 1)).otherwise(rank.cast("int")).alias("rank"),
        F.when(valid, e).otherwise(0.0).alias("entry"),
    )


def survival_unit(df: DataFrame, policy: Policy, time: str, event: str, censor: str, entry: str | None = None) -> DataFrame:
    """``unit, valid, time, outcome, entry``: the earliest event of a unit, else its latest censored record, else an invalid one.

    Ties go to the level first declared, then to the earlier entry. A minimum
    of structs, so records combine before the exchange.
    """
    levels = [censor, *[x for x in policy.levels[event] if x != censor]]
    best = gated(_per_unit(df, policy, F.min(survival_key(policy, time, event, censor, entry)).alias("k")), policy)
    ok = F.col("k.kind") < 2
    outcome = F.element_at(F.array(*map(F.lit, levels)), F.col("k.rank"))
    return best.select("unit", ok.alias("valid"), F.when(ok, F.when(F.col("k.kind") == 0, F.col("k.at")).otherwise(-F.col("k.at"))).alias("time"), F.when(ok, outcome).alias("outcome"), F.when(ok, F.col("k.entry")).alias("entry"))
