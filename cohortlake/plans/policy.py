"""Declared domains, bounds and guards of a data set."""

from __future__ import annotations

import hashlib
import hmac
import json
import re
from dataclasses import dataclass, field
from math import isfinite

NAME = re.compile(r"^[a-zA-Z._][a-zA-Z0-9._]*$")


class Refused(ValueError):
    """A guard does not allow this answer; nothing of it is released."""


@dataclass(frozen=True)
class Policy:
    """What may be asked of a table: its privacy unit, the units' limits, and every column's domain."""

    unit: str
    capacity: int
    max_records: int
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    levels: dict[str, tuple[str, ...]] = field(default_factory=dict)
    grid_bits: int = 16
    adjacency: str = "add_remove"
    cohort: int | None = None  # the fixed number of units, if there is one

    def __post_init__(self):
        if not 8 <= self.grid_bits <= 18:
            raise ValueError("grid_bits must be from 8 to 18")
        if self.adjacency not in ("add_remove", "replace_one"):
            raise ValueError("adjacency must be add_remove or replace_one")
        if self.adjacency == "replace_one" and self.cohort is not None and not 0 < self.cohort <= self.capacity:
            raise ValueError("a fixed cohort must fit the capacity")
        for name, (lo, hi) in self.bounds.items():
            if not (isfinite(lo) and isfinite(hi) and hi > lo and isfinite((hi - lo) ** 2)):
                raise ValueError(f"bounds of {name} must be finite and of positive width")
        for name in (*self.bounds, *self.levels, self.unit):
            if not NAME.match(name):
                raise ValueError(f"{name!r} is no column name")
        object.__setattr__(self, "levels", {k: tuple(sorted(set(v), key=str.encode)) for k, v in self.levels.items()})

    @property
    def scale(self) -> int:
        """Steps of the lattice on which statistics are counted."""
        return 1 << self.grid_bits

    @property
    def adjacency_multiplier(self) -> int:
        return 1 if self.adjacency == "add_remove" else 2


@dataclass(frozen=True)
class Disclosure:
    """Floors for exact answers."""

    min_cell: int = 3
    min_subset: int = 3
    max_parameters: float = 0.33
    privacy_level: int = 5

    @property
    def floor(self) -> int:
        return max(3, self.min_subset, self.privacy_level)

    def check_cells(self, counts: list[int], floor: int | None = None) -> None:
        """Refuse if a cell that is not empty has fewer rows than the floor."""
        if any(0 < n < (floor or self.min_cell) for n in counts):
            raise Refused("a cell is too small")

    def check_clusters(self, least: int | None) -> None:
        if least is not None and least < self.floor:
            raise Refused("a cluster is too small")

    def check_count(self, n: int) -> None:
        if n < self.floor:
            raise Refused("too few rows")

    def too_wide(self, n, p: int):
        """Whether a matrix of p columns has too few rows, as a column expression over their number."""
        from pyspark.sql import functions as F

        return (n < max(self.floor, 5 * p)) | (F.lit(float(p)) / F.greatest(n, F.lit(1)) > 0.2)

    def check_model(self, n: int, p: int) -> None:
        """Refuse a matrix of p columns over too few rows."""
        if n < max(self.floor, 5 * p) or p / max(n, 1) > 0.2:
            raise Refused("too many columns for the rows")


@dataclass(frozen=True)
class SourceDescriptor:
    """What an owner declares of a table before it is aligned."""

    id_col: str
    name: str
    version: str
    purpose: str = "record-alignment"
    unit: str | None = None

    def __post_init__(self):
        for name in (self.id_col, self.unit or self.id_col):
            if not NAME.match(name):
                raise ValueError(f"{name!r} is no column name")
        if not self.name or not self.version:
            raise ValueError("a source needs a name and a version")


@dataclass(frozen=True)
class DatasetDescriptor:
    """A version of a data set, with which policies and releases are bound."""

    name: str
    version: str

    def __post_init__(self):
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}", self.name) or not self.version:
            raise ValueError("a data set needs a name and a version")

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


@dataclass(frozen=True)
class DescribeSpec:
    """Variables of a description, each with its grid, and how a budget is split over the families of statistics."""

    grids: dict[str, tuple[float, ...]]
    weights: tuple[float, float, float, float] = (0.25, 0.25, 0.25, 0.25)  # count, sum, sum of squares, histogram

    def check(self, policy: Policy) -> None:
        if not self.grids or abs(sum(self.weights) - 1) > 1e-12 or min(self.weights) <= 0:
            raise ValueError("a description needs variables, and weights that sum to 1")
        for name, grid in self.grids.items():
            lo, hi = policy.bounds[name]
            if not grid or list(grid) != sorted(set(grid)) or grid[0] <= lo or grid[-1] != hi:
                raise ValueError(f"the grid of {name} must ascend from above the lower to the upper bound")

    @property
    def coordinates(self) -> int:
        return sum(4 + len(g) for g in self.grids.values())

    def plan(self, policy: Policy, epsilon: float) -> list[tuple[str, int, float, float]]:
        """(variable, coordinate, epsilon, sensitivity) of every coordinate; the budget is split evenly over variables."""
        self.check(policy)
        shares = [epsilon * w / len(self.grids) for w in self.weights]
        steps = policy.adjacency_multiplier
        moments = (float(steps), float(policy.scale), float(policy.scale))
        out = []
        for name, grid in self.grids.items():
            out += [(name, i + 1, shares[i], moments[i]) for i in range(3)]
            out += [(name, 4 + i, shares[3], float(steps)) for i in range(len(grid) + 1)]
        return out


@dataclass(frozen=True)
class SurvivalSpec:
    """A survival histogram: its time, event and entry columns, the censored level, and the grid."""

    time: str
    event: str
    censor: str
    grid: tuple[float, ...]
    entry: str | None = None

    def check(self, policy: Policy) -> None:
        if self.censor not in policy.levels[self.event] or len(policy.levels[self.event]) < 2:
            raise ValueError("the censored level and a cause must be declared")
        lo, hi = policy.bounds[self.time]
        if not self.grid or list(self.grid) != sorted(set(self.grid)) or self.grid[0] <= lo or self.grid[-1] != hi:
            raise ValueError("the grid must ascend from above the lower to the upper bound")
        if self.entry is not None and self.entry not in policy.bounds:
            raise ValueError("the entry column must have bounds")

    def coordinates(self, policy: Policy) -> int:
        return len(self.grid) * (len(policy.levels[self.event]) + (self.entry is not None)) + 1


@dataclass(frozen=True)
class GlmSpec:
    """A registered model of bounded columns."""

    family: str
    outcome: str
    predictors: tuple[str, ...]
    bounds: dict[str, tuple[float, float]]
    weight: str | None = None
    offset: str | None = None
    grid_bits: int = 16
    block_rows: int = 4096

    def __post_init__(self):
        if self.family not in ("binomial", "poisson"):
            raise ValueError("the family must be binomial or poisson")
        used = [self.outcome, *self.predictors, *([self.weight] if self.weight else []), *([self.offset] if self.offset else [])]
        if len(set(used)) != len(used) or any(c not in self.bounds for c in used):
            raise ValueError("every column of a model must be another one and have bounds")
        object.__setattr__(self, "predictors", tuple(sorted(self.predictors, key=str.encode)))


@dataclass(frozen=True)
class CoxSpec:
    """A bounded proportional-hazards model on a grid, and the budget of its private fit."""

    grid: tuple[float, ...]
    bounds: dict[str, tuple[float, float]]
    capacity: int
    covariate_norm: float
    beta_norm: float
    ridge: float = 0.0
    least_at_risk: int = 1
    delayed: bool = False
    epsilon: float = 1.0
    delta: float = 1e-6
    iterations: int = 10
    step: float = 0.5

    def __post_init__(self):
        if not self.grid or list(self.grid) != sorted(set(self.grid)) or self.capacity < 1:
            raise ValueError("the grid must ascend, and the capacity be positive")
        if min(self.covariate_norm, self.beta_norm, self.epsilon) <= 0 or not 0 < self.delta < 1 or self.ridge < 0:
            raise ValueError("norms and epsilon must be positive, delta between 0 and 1")
        if not isfinite(2 * self.covariate_norm * self.beta_norm) or 2 * self.covariate_norm * self.beta_norm > 700:
            raise ValueError("the norms have no finite sensitivity")


def canonical_json(value) -> str:
    """JSON that is the same for equal values: sorted keys, no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def hmac_hex(secret: bytes, value) -> str:
    """HMAC-SHA256 of the canonical JSON of a value."""
    return hmac.new(secret, canonical_json(value).encode(), hashlib.sha256).hexdigest()


def whole_numbers(values: list[float], positive: bool = False) -> list[int]:
    """The values as exact whole numbers within 2^53; refused otherwise."""
    out = []
    for v in values:
        if isinstance(v, bool) or v is None or not isfinite(v) or v != int(v) or abs(v) >= 2**53 or (positive and v <= 0):
            raise Refused("values must be exact whole numbers")
        out.append(int(v))
    return out
