"""Capsules: all blocks of a workload, one pass over each table.

Owners that share a unit are one space: each table is reduced to one row a unit
with everything its blocks need, the owners' units are joined fully, and one
aggregate gives all coordinates and decides on admission.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.policy import Policy
from . import bound, families


@dataclass
class Owner:
    """One owner's table: aggregates by unit, and columns made of them, by name."""

    name: str
    table: DataFrame
    policy: Policy
    aggregates: dict[str, Column] = field(default_factory=dict)
    columns: dict[str, Column] = field(default_factory=dict)

    def numeric(self, name: str, column: str, digits: int | None = None) -> Owner:
        """The mean of the finite values, each clipped first."""
        lo, hi = self.policy.bounds[column]
        x = F.col(column).cast("double")
        clipped = F.when(bound.finite(x), bound.clip(x, lo, hi))
        self.aggregates |= {f"_m_{name}": bound.clip(bound._mean(clipped, digits, bound._most(self.policy, column)), lo, hi), f"_n_{name}": F.count(clipped)}
        self.columns[name] = F.when(F.col(f"_n_{name}") > 0, F.col(f"_m_{name}"))
        return self

    def category(self, name: str, *columns: str) -> Owner:
        """The one declared level of a unit's rows (of several columns: a struct of levels), null if it has none or several."""
        ok = F.lit(True)
        for c in columns:
            ok = ok & F.col(c).isin(*self.policy.levels[c])
        value = F.when(ok, F.struct(*columns) if len(columns) > 1 else F.col(columns[0]))
        self.aggregates |= {f"_a_{name}": F.min(value), f"_b_{name}": F.max(value)}
        self.columns[name] = F.when(F.col(f"_a_{name}") == F.col(f"_b_{name}"), F.col(f"_a_{name}"))
        return self

    def units(self) -> DataFrame:
        rows = F.count(F.lit(1)).alias(self.rows)
        per = self.table.groupBy(F.col(self.policy.unit).alias("unit")).agg(rows, *[a.alias(n) for n, a in self.aggregates.items()])
        return per.select("unit", self.rows, *[c.alias(n) for n, c in self.columns.items()])

    @property
    def rows(self) -> str:
        return f"_rows_{self.name}"

    def bad(self) -> Column:
        """An aggregate over the joined units: whether the policy refuses this owner's."""
        own = F.col(self.rows).isNotNull()
        over = (F.count(self.rows) > self.policy.capacity) | (F.coalesce(F.max(self.rows), F.lit(0)) > self.policy.max_records)
        over = over | (F.count_if(own & bound.blank(F.col("unit"))) > 0)
        return over | (F.count(self.rows) != self.policy.cohort) if self.policy.cohort is not None else over


def space(owners: list[Owner], parts: list[tuple[str, list[Column]]]) -> DataFrame:
    """``at, block, coord, value`` of all ``parts`` (name, aggregates over units) of owners that share a unit."""
    units, bad = owners[0].units(), owners[0].bad()
    for o in owners[1:]:
        units, bad = units.join(o.units(), "unit", "full_outer"), bad | o.bad()
    return families.blocks(units, parts, bad)


def capsule(spaces: list[tuple[list[Owner], list[tuple[int, str, list[Column]]]]]) -> DataFrame:
    """All spaces' blocks; each part has its number in the capsule's fixed order first."""
    out = None
    for owners, parts in spaces:
        order = F.array(*[F.lit(n) for n, _, _ in parts])
        got = space(owners, [(name, terms) for _, name, terms in parts]).withColumn("at", F.get(order, F.col("at")))
        out = got if out is None else out.unionByName(got)
    return out
