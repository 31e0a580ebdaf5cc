"""Model steps and fits: every step is one aggregate of the table, the solve is of the size of the model."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip, digamma, exp_clipped, finite, lattice, linear, sigmoid, softplus, trigamma
from ..plans.policy import Refused
from .bound import refused_if


def mean_of(family: str, eta: Column) -> Column:
    return {"gaussian": eta, "binomial": sigmoid(eta), "poisson": exp_clipped(eta)}[family]


def checked(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """``df``, refused before any row is returned if ``bad`` holds for one of its rows."""
    found = df.agg(F.coalesce(F.max(bad), F.lit(False)).alias("_bad"))
    return df.crossJoin(F.broadcast(found)).where(refused_if(F.col("_bad"), message) & (F.spark_partition_id() >= 0)).drop("_bad")  # one row


def with_weights(df: DataFrame, column: str, name: str = "weight") -> DataFrame:
    """Adds validated weights: numbers, finite and not negative in every row."""
    w = F.col(column).cast("double")
    return checked(df, ~(finite(w) & (w >= 0)), "weights must be finite and not negative").withColumn(name, w)


def with_offset(df: DataFrame, column: str, most: float = 30.0, name: str = "offset") -> DataFrame:
    """Registers an offset of the linear predictor: finite and within ``most`` in every row."""
    o = F.col(column).cast("double")
    return checked(df, ~(finite(o) & (F.abs(o) <= most)), "offsets must be finite and bounded").withColumn(name, o)


def without_offset(df: DataFrame, name: str = "offset") -> DataFrame:
    """Clears the offset: predictors are plain again."""
    return df.drop(name)


def design(df: DataFrame, xs: list[str], y: str | None = None, keep: tuple[str, ...] = (), order: list[str] | None = None) -> DataFrame:
    """Complete rows with the design as an array ``x`` (an intercept first, then ``order`` or the columns as given) and ``y``."""
    names = order or xs
    if sorted(names) != sorted(xs):
        raise ValueError("the order must hold every column once")
    whole = df.dropna(subset=[*xs, *([y] if y else [])])
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in names])
    return whole.select(*keep, x.alias("x"), *([F.col(y).cast("double").alias("y")] if y else []))


def bind_columns(left: DataFrame, right: DataFrame, key: str, x: str = "x") -> DataFrame:
    """Rows of two matrices side by side: arrays of one key joined."""
    return left.select(key, F.col(x).alias("_l")).join(right.select(key, F.col(x).alias("_r")), key).select(key, F.concat("_l", "_r").alias(x))


def column(x: str, j: int) -> Column:
    """Column ``j`` (from 0) of a matrix whose rows are arrays."""
    return F.get(F.col(x), F.lit(j))


def multiple_eta(xs: list[Column], betas: dict[str, list[float]], offset: Column | None = None) -> dict[str, Column]:
    """Linear predictors of several classes at once, each with its intercept first."""
    return {k: linear(xs, b[1:], b[0], offset) for k, b in betas.items()}


def indicator_residual(classes: Column, level: str, p: Column) -> Column:
    """1 where the class is ``level``, else 0 (also for null), less its probability."""
    return F.when(classes == level, 1.0).otherwise(0.0) - p


def gee_intercept(df: DataFrame, name: str = "intercept") -> DataFrame:
    """A constant-1 column of the design."""
    return df.withColumn(name, F.lit(1.0))


def shaped(df: DataFrame, own: int, peer: int, x: str = "x") -> DataFrame:
    """Splits the rows of a joint design at the first owner's columns; rows of another width fail the query."""
    if own < 0 or peer < 0:
        raise ValueError("widths must not be negative")
    d = checked(df, F.size(x) != own + peer, "the design has another shape")
    return d.withColumn("own", F.slice(x, 1, own)).withColumn("peer", F.slice(x, own + 1, peer)).drop(x)


def nb_eta(df: DataFrame, y: str, own: Column, peer: Column, guard, most: float = 5.0) -> DataFrame:
    """Rows with an outcome, and their joint predictor: each owner's part is kept within ``most``; refused over too few rows."""
    d = df.where(F.col(y).isNotNull())
    total = d.agg(F.count(F.lit(1)).alias("_n"))
    passed = refused_if(F.col("_n") < guard.floor, "too few rows") & (F.spark_partition_id() >= 0)
    return d.crossJoin(F.broadcast(total)).where(passed).drop("_n").withColumn("eta", clip(own, -most, most) + clip(peer, -most, most))  # one row


def nb_shifted(y: Column, theta: float) -> Column:
    """y + theta, at which the negative binomial takes its digamma."""
    return y.cast("double") + F.lit(float(theta))


def lmm_residual(y: Column, own: Column, peer: Column) -> Column:
    """The outcome less both owners' parts of the predictor, nulls as 0."""
    return F.coalesce(y.cast("double"), F.lit(0.0)) - F.coalesce(own, F.lit(0.0)) - F.coalesce(peer, F.lit(0.0))


def gradient(df: DataFrame, xs: list[Column], y: Column, family: str, beta: list[float], intercept: float = 0.0, weight: Column | None = None, offset: Column | None = None, guard=None) -> DataFrame:
    """Score X'(mu - y) with the intercept first: ``j, value``.

    With a guard, refused if there are too many columns for the rows or, for a
    binomial outcome, if one of its two classes is too small.
    """
    eta = linear(xs, beta, intercept, offset)
    r = mean_of(family, eta) - y
    r = r if weight is None else weight * r
    got = df.agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum(y), F.lit(0.0)).alias("_y"), *[F.sum(x * r).alias(f"g{j}") for j, x in enumerate([F.lit(1.0), *xs])])
    if guard is not None:
        bad = guard.too_wide(F.col("_n"), len(xs) + 1)
        if family == "binomial":
            bad = bad | ((F.col("_y") > 0) & (F.col("_y") < guard.floor)) | ((F.col("_n") - F.col("_y") > 0) & (F.col("_n") - F.col("_y") < guard.floor))
        got = got.where(refused_if(bad, "too many columns for the rows"))
    return got.select(F.posexplode(F.array(*[F.col(f"g{j}") for j in range(len(xs) + 1)])).alias("j", "value"))


def deviance_sums(df: DataFrame, y: Column, eta: Column, family: str) -> DataFrame:
    """Parts of the deviance: squares of residuals, softplus and cross sums, or means and null terms."""
    if family == "gaussian":
        return df.agg(F.sum((y - eta) * (y - eta)).alias("rss"))
    if family == "binomial":
        return df.agg(F.sum(softplus(eta)).alias("sum_softplus"), F.sum(y * eta).alias("sum_y_eta"))
    return df.agg(F.sum(exp_clipped(eta)).alias("sum_mu"), F.sum(y * eta).alias("sum_y_eta"), F.sum(F.when(y > 0, y * F.ln(y)).otherwise(0.0) - y).alias("null_term"))


def pearson_r2(y: Column, eta: Column, family: str) -> Column:
    """Squared Pearson residual; means are kept 1e-8 off their limits, exponents at most 50."""
    if family == "gaussian":
        return (y - eta) * (y - eta)
    if family == "binomial":
        mu = clip(sigmoid(eta), 1e-8, 1 - 1e-8)
        return (y - mu) * (y - mu) / (mu * (1 - mu))
    mu = F.greatest(F.exp(F.least(eta, F.lit(50.0))), F.lit(1e-8))
    return (y - mu) * (y - mu) / mu


def weighted_sums(df: DataFrame, y: Column, mu: Column, w: Column) -> DataFrame:
    r = mu - y
    return df.agg(F.sum(w * r).alias("sum_wr"), F.sum(F.sqrt(w) * r).alias("sum_rwr"), F.sum(w).alias("sum_w"))


def normal_equations(df: DataFrame, xs: list[Column], working: Column, weight: Column) -> tuple[np.ndarray, np.ndarray]:
    """X'WX and X'Wz with an intercept, in one aggregate."""
    x = [F.lit(1.0), *xs]
    k = len(x)
    terms = [F.sum(weight * x[i] * x[j]) for j in range(k) for i in range(j + 1)] + [F.sum(weight * c * working) for c in x]
    got = list(df.agg(*[t.alias(f"t{n}") for n, t in enumerate(terms)]).first())
    a = np.zeros((k, k))
    n = 0
    for j in range(k):
        for i in range(j + 1):
            a[i, j] = a[j, i] = got[n]
            n += 1
    return a, np.array(got[n:], float)


def fit_glm(df: DataFrame, xs: list[Column], y: Column, family: str = "gaussian", iterations: int = 25, tolerance: float = 1e-9, ridge: float = 0.0) -> np.ndarray:
    """Coefficients, intercept first, by iteratively reweighted least squares: one aggregate of the table a step."""
    beta = np.zeros(len(xs) + 1)
    for _ in range(iterations):
        eta = linear(xs, beta[1:].tolist(), float(beta[0]))
        mu = mean_of(family, eta)
        w = {"gaussian": F.lit(1.0), "binomial": F.greatest(mu * (1 - mu), F.lit(1e-10)), "poisson": F.greatest(mu, F.lit(1e-10))}[family]
        a, b = normal_equations(df, xs, eta + (y - mu) / w, w)
        new = np.linalg.solve(a + ridge * np.diag([0.0, *np.ones(len(xs))]), b)
        if np.max(np.abs(new - beta)) < tolerance:
            return new
        beta = new
        if family == "gaussian":
            return beta
    return beta


def fit_nb_theta(df: DataFrame, y: Column, start: float = 1.0, iterations: int = 50) -> float:
    """Profile estimate of the dispersion of a negative binomial sample, by Newton steps on the value counts."""
    counts = df.where(y.isNotNull()).groupBy(y.cast("double").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    n, s = counts.agg(F.sum("n"), F.sum(F.col("n") * F.col("y"))).first()
    mean, theta = s / n, start
    for _ in range(iterations):
        at = F.col("y") + F.lit(theta)
        p, q, u, v = counts.agg(F.sum(F.col("n") * digamma(at)), F.sum(F.col("n") * trigamma(at)), F.sum(F.col("n") * (at / (theta + mean))), F.sum(F.col("n") * at)).first()
        one = counts.limit(1).select(digamma(F.lit(theta)), trigamma(F.lit(theta))).first()
        score = p - n * one[0] + n * math.log(theta) + n - n * math.log(theta + mean) - u
        slope = q - n * one[1] + n / theta - 2 * n / (theta + mean) + v / (theta + mean) ** 2
        step = score / slope
        theta = max(theta / 4, theta - step)
        if abs(step) < 1e-8 * theta:
            break
    return theta


def softmax_gradient(df: DataFrame, xs: list[Column], classes: Column, levels: list[str], betas: dict[str, list[float]]) -> DataFrame:
    """Gradients of a multinomial model with a base level: ``level, j, value`` of X'(p - 1[y = level])."""
    x = [F.lit(1.0), *xs]
    e = {k: F.exp(linear(xs, b[1:], b[0])) for k, b in betas.items()}
    total = F.lit(1.0)
    for v in e.values():
        total = total + v
    picked = [k for k in levels if k in betas]
    sums = [F.sum(c * (e[k] / total - F.when(classes == k, 1.0).otherwise(0.0))).alias(f"g{a}_{j}") for a, k in enumerate(picked) for j, c in enumerate(x)]
    cells = [F.struct(F.lit(k).alias("level"), F.lit(j).alias("j"), F.col(f"g{a}_{j}").alias("value")) for a, k in enumerate(picked) for j in range(len(x))]
    return df.agg(*sums).select(F.explode(F.array(*cells)).alias("c")).select("c.level", "c.j", "c.value")


def ordinal_class(indicators: list[Column], most: int = 100) -> Column:
    """Class from 1 to K of cumulative indicators: K less the number that hold."""
    if not 1 <= len(indicators) < most:
        raise Refused("an ordinal outcome has two classes or more, but not too many")
    held = F.lit(0)
    for i in indicators:
        held = held + i.cast("int")
    return F.lit(len(indicators) + 1) - held


def impute_mean(df: DataFrame, column: str, name: str) -> DataFrame:
    """Nulls and non-finite values by the mean."""
    x = F.when(finite(F.col(column)), F.col(column).cast("double"))
    mean = df.agg(F.avg(x).alias("_mean"))
    return df.crossJoin(F.broadcast(mean)).withColumn(name, F.coalesce(x, F.col("_mean"))).drop("_mean")  # one row


def impute_mode(df: DataFrame, column: str, name: str) -> DataFrame:
    """Nulls by the most frequent level, the first in order if several are."""
    mode = df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(1).select(F.col(column).alias("_mode"))
    return df.crossJoin(F.broadcast(mode)).withColumn(name, F.coalesce(column, "_mode")).drop("_mode")  # one row


def _uniform(id_col: str, seed: int, i: int) -> Column:
    """A number in (0, 1) by a seeded hash of the identifier."""
    return (F.pmod(F.xxhash64(id_col, F.lit(seed), F.lit(i)), F.lit(1 << 30)) + 0.5) / float(1 << 30)


def _posterior(beta: np.ndarray, precision: np.ndarray, rng: np.random.Generator, variance: float = 1.0) -> np.ndarray:
    """A draw about ``beta`` whose covariance is the inverse of ``precision`` times ``variance``."""
    covariance = np.linalg.inv(precision) * variance + 1e-12 * np.eye(len(beta))
    return beta + np.linalg.cholesky(covariance) @ rng.standard_normal(len(beta))


def _penalty(k: int, alpha: float) -> np.ndarray:
    return alpha * np.diag([0.0, *np.ones(k - 1)])  # the intercept is free


def impute_ridge(df: DataFrame, column: str, xs: list[str], id_col: str, name: str, seed: int = 1, alpha: float = 1.0, sigma: float | None = None) -> DataFrame:
    """Single imputation from a Bayesian ridge regression: a seeded draw of coefficients, and noise by the row's hash.

    ``sigma`` 0 takes the posterior mean and no noise.
    """
    y, x = F.col(column).cast("double"), [F.col(c).cast("double") for c in xs]
    d = df.dropna(subset=[column, *xs])
    a, b = normal_equations(d, x, y, F.lit(1.0))
    n, yy = a[0, 0], d.agg(F.sum(y * y)).first()[0]
    precision = a + _penalty(len(b), alpha)
    beta = np.linalg.solve(precision, b)
    variance = max(1e-12, (yy - 2 * beta @ b + beta @ a @ beta) / max(1.0, n - len(beta)))
    draw = beta if sigma == 0 else _posterior(beta, precision, np.random.default_rng(seed), variance)
    noise = F.sqrt(-2 * F.ln(_uniform(id_col, seed, 1))) * F.cos(2 * math.pi * _uniform(id_col, seed, 2)) * (math.sqrt(variance) if sigma is None else sigma)
    return df.withColumn(name, F.coalesce(y, linear(x, draw[1:].tolist(), float(draw[0])) + noise))


def _class_fit(d: DataFrame, x: list[Column], level: Column, levels: list[str], alpha: float, iterations: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Penalised coefficients of all levels but the first, and their precisions: one aggregate of the table a step, Newton steps class by class."""
    k = len(x) + 1
    one = [F.lit(1.0), *x]
    beta = {c: np.zeros(k) for c in levels[1:]}
    pairs = [(i, j) for j in range(k) for i in range(j + 1)]
    for _ in range(iterations):
        e = {c: F.exp(clip(linear(x, b[1:].tolist(), float(b[0])), -40, 40)) for c, b in beta.items()}
        total = F.lit(1.0)
        for v in e.values():
            total = total + v
        sums = []
        for c in beta:
            p = e[c] / total
            w = F.greatest(p * (1 - p), F.lit(1e-6))
            r = F.when(level == c, 1.0).otherwise(0.0) - p
            sums += [F.sum(w * one[i] * one[j]) for i, j in pairs] + [F.sum(r * v) for v in one]
        got = list(d.agg(*[t.alias(f"t{n}") for n, t in enumerate(sums)]).first())
        moved, precision, width = 0.0, {}, len(pairs) + k
        for n, c in enumerate(beta):
            own = got[n * width : (n + 1) * width]
            h = np.zeros((k, k))
            for (i, j), v in zip(pairs, own, strict=False):
                h[i, j] = h[j, i] = v
            h += _penalty(k, alpha)
            step = np.linalg.solve(h, np.array(own[len(pairs) :]) - _penalty(k, alpha) @ beta[c])
            beta[c], precision[c] = beta[c] + step, h
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-6:
            break
    return beta, precision


def impute_class(df: DataFrame, column: str, xs: list[str], id_col: str, name: str, seed: int = 1, alpha: float = 1.0, draw: bool = True, most_levels: int = 100) -> DataFrame:
    """Single imputation of a column of levels: a penalised logistic model (two levels) or its multinomial form.

    Coefficients are drawn about their estimates and levels by the row's hash;
    without ``draw`` the likeliest level is taken. The levels are those found,
    in order, at least two and at most ``most_levels``.
    """
    x = [F.col(c).cast("double") for c in xs]
    d = df.dropna(subset=[column, *xs])
    levels = sorted(r[0] for r in d.select(column).distinct().limit(most_levels + 1).collect())
    if not 2 <= len(levels) <= most_levels:
        raise ValueError("the column must have two levels or more, but not too many")
    beta, precision = _class_fit(d, x, F.col(column), levels, alpha, 25 if len(levels) == 2 else 30)
    rng = np.random.default_rng(seed)
    used = {c: _posterior(b, precision[c], rng) if draw else b for c, b in beta.items()}
    odds = [F.lit(1.0), *[F.exp(clip(linear(x, b[1:].tolist(), float(b[0])), -40, 40)) for b in used.values()]]
    total = odds[0]
    for o in odds[1:]:
        total = total + o
    if draw:
        u, picked = _uniform(id_col, seed, 3) * total, F.lit(levels[-1])
        for c, o in reversed(list(zip(levels[:-1], [sum_of(odds[: i + 1]) for i in range(len(levels) - 1)], strict=True))):
            picked = F.when(u <= o, F.lit(c)).otherwise(picked)
    else:
        best = F.greatest(*odds)
        picked = F.lit(levels[-1])
        for c, o in reversed(list(zip(levels[:-1], odds[:-1], strict=True))):
            picked = F.when(o >= best, F.lit(c)).otherwise(picked)
    return df.withColumn(name, F.coalesce(F.col(column), picked))


def sum_of(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def predictors(df: DataFrame, column: str, output: str) -> list[str]:
    """Columns an imputation may use: numbers without nulls, but for earlier imputations (``__mi_`` and a number)."""
    import re

    from pyspark.sql.types import NumericType

    names = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in (column, output) and not re.search(r"__mi_[0-9]+$", f.name)]
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names]).first() if names else {}
    return [c for c in names if not nulls[c]]


def cox_rows(df: DataFrame, xs: list[str], spec) -> DataFrame:
    """Rows of fixed shape: those that are not valid, or leave the covariates' bounds, become zero rows.

    Takes ``valid, entry_index, stop_index, status`` and the covariates. Missing
    or impossible indices, statuses or covariates fail the query.
    """
    grid = len(spec.grid)
    bad = F.col("valid").isNull() | F.col("entry_index").isNull() | F.col("stop_index").isNull() | ~F.coalesce(F.col("status").isin(0, 1), F.lit(False))
    bad = bad | (F.col("entry_index") < 0) | (F.col("entry_index") >= grid) | (F.col("stop_index") < 1) | (F.col("stop_index") > grid)
    square, inside = F.lit(0.0), F.lit(True)
    for c in xs:
        lo, hi = spec.bounds[c]
        bad = bad | ~finite(F.col(c))
        square = square + F.col(c) * F.col(c)
        inside = inside & (F.col(c) >= lo) & (F.col(c) <= hi)
    ok = F.col("valid") & (F.col("entry_index") < F.col("stop_index")) & inside & (F.sqrt(square) <= spec.covariate_norm + 8 * 2.0**-52)
    d = checked(df, bad, "rows of the model are not of its shape").withColumn("_ok", ok)
    zero = {c: F.when(F.col("_ok"), F.col(c)).otherwise(0.0) for c in xs}
    return d.withColumns({**zero, "valid": F.col("_ok"), "status": F.when(F.col("_ok"), F.col("status")).otherwise(0), "entry_index": F.when(F.col("_ok"), F.col("entry_index")).otherwise(0), "stop_index": F.when(F.col("_ok"), F.col("stop_index")).otherwise(1)}).drop("_ok")


def cox_parts(risk: DataFrame, beta: float, ridge: float = 0.0) -> tuple[float, float, float]:
    """Breslow log-likelihood, score and information from the sums per tick (:func:`windows.risk_sums`)."""
    some = risk.where("events > 0")
    r = some.agg(F.sum(F.lit(float(beta)) * F.col("sum_x") - F.col("events") * F.ln("s0")), F.sum(F.col("sum_x") - F.col("events") * F.col("s1") / F.col("s0")), F.sum(F.col("events") * (F.col("s2") / F.col("s0") - (F.col("s1") / F.col("s0")) ** 2))).first()
    return (r[0] or 0.0) - ridge * beta * beta / 2, (r[1] or 0.0) - ridge * beta, (r[2] or 0.0) + ridge


def cox_at(df: DataFrame, xs: list[str], beta: list[float], spec) -> tuple[float, np.ndarray, np.ndarray]:
    """Penalised Breslow log-likelihood, score and information of several covariates: one aggregate of the rows to one row a tick."""
    from .windows import risk_sums

    grid = [float(g) for g in range(1, len(spec.grid) + 1)]
    rows = df.where("valid")
    risk = risk_sums(rows, F.col("entry_index").cast("double"), F.col("stop_index").cast("double"), F.col("status") == 1, [F.col(c) for c in xs], list(beta), grid).collect()
    p, b = len(xs), np.array(beta, float)
    loglik, score, information = 0.0, np.zeros(p), np.zeros((p, p))
    for r in risk:
        if not r["events"]:
            continue
        if r["at_risk"] < spec.least_at_risk:
            raise Refused("too few rows are at risk at an event")
        mean, square, sums = np.array(r["s1"]) / r["s0"], np.zeros((p, p)), np.array(r["sum_x"])
        at = 0
        for j in range(p):
            for i in range(j + 1):
                square[i, j] = square[j, i] = r["s2"][at] / r["s0"]
                at += 1
        loglik += float(b @ sums) - r["events"] * math.log(r["s0"])
        score += sums - r["events"] * mean
        information += r["events"] * (square - np.outer(mean, mean))
    penalty = spec.capacity * spec.ridge
    return loglik - penalty * float(b @ b) / 2, score - penalty * b, information + penalty * np.eye(p)


def _within(beta: np.ndarray, bound: float) -> np.ndarray:
    norm = float(np.linalg.norm(beta))
    return beta * bound / norm if norm > bound else beta


def fit_cox_bounded(df: DataFrame, xs: list[str], spec, iterations: int = 100, tolerance: float = 1e-9) -> dict:
    """Coefficients within the norm bound of the specification, by Newton steps that are halved until the likelihood rises.

    Refused if the penalised curvature does not identify them. On the boundary
    the step is projected, and the fit ends when it no longer gains.
    """
    beta = np.zeros(len(xs))
    value, score, information = cox_at(df, xs, beta, spec)
    for _ in range(iterations):
        step, size = np.linalg.solve(information, score), 1.0
        while True:
            new = _within(beta + size * step, spec.beta_norm)
            got = cox_at(df, xs, new, spec)
            if got[0] >= value or size < 1e-6:
                break
            size /= 2
        moved = float(np.abs(new - beta).max())
        beta, (value, score, information) = new, got
        if moved < tolerance:
            break
    else:
        raise Refused("the fit did not converge")
    curvature = np.linalg.eigvalsh(information / spec.capacity)
    if curvature.min() <= max(1e-10, 1.5e-8 * max(1.0, float(np.abs(curvature).max()))):
        raise Refused("the coefficients are not identified")
    return {"beta": beta, "loglik": value, "score_norm": float(np.linalg.norm(score)), "on_boundary": float(np.linalg.norm(beta)) >= spec.beta_norm * (1 - 1e-8), "least_curvature": float(curvature.min())}


def cox_sensitivity(spec) -> tuple[float, float]:
    """L2 sensitivity of the normalised score to one unit, and the Gaussian noise of each of the iterations.

    Without entry times the reciprocals of the risk sets sum to log(n + 1) at
    most; with delayed entry risk sets can grow, and the bound is n.
    """
    n, cz = spec.capacity, spec.covariate_norm
    reciprocals = float(n) if spec.delayed else math.log(n + 1)
    sensitivity = 4 * cz / n + math.exp(2 * cz * spec.beta_norm) * (2 * cz + cz * cz) * reciprocals / n
    sigma = sensitivity * math.sqrt(spec.iterations / spec.epsilon * (2 * math.log(1 / spec.delta) / spec.epsilon + 1))
    return sensitivity, sigma


def fit_cox_private(df: DataFrame, xs: list[str], spec, noise: np.ndarray) -> np.ndarray:
    """Coefficients after a fixed number of projected, noisy gradient steps; ``noise`` has a standard normal row for each."""
    if noise.shape != (spec.iterations, len(xs)):
        raise ValueError("the noise must have a row for each iteration")
    beta, sigma = np.zeros(len(xs)), cox_sensitivity(spec)[1]
    for z in noise:
        _, score, _ = cox_at(df, xs, beta.tolist(), spec)
        plain = (score + spec.capacity * spec.ridge * beta) / spec.capacity
        beta = _within(beta + spec.step * (plain - spec.ridge * beta + sigma * z), spec.beta_norm)
    return beta


def fit_cox(df: DataFrame, entry: Column, stop: Column, event: Column, x: Column, grid: list[float], ridge: float = 0.0, iterations: int = 25) -> float:
    """Coefficient of one covariate by Newton steps on the grid."""
    from .windows import risk_sums

    beta = 0.0
    for _ in range(iterations):
        _, score, information = cox_parts(risk_sums(df, entry, stop, event, x, beta, grid), beta, ridge)
        step = score / information
        beta += max(-1.0, min(1.0, step))
        if abs(step) < 1e-10:
            break
    return beta


def glm_block(df: DataFrame, spec, position: str, block: int | None = None) -> DataFrame:
    """Source rows of a bounded GLM on the lattice: ``block, position, weight, x`` (intercept first)``, y, offset``.

    Every value is kept within its bounds and rounded to the lattice; a row with
    a missing or non-finite value is a zero row, so blocks have a fixed shape.
    """
    scale, names = 1 << spec.grid_bits, spec.predictors
    used = [*names, spec.outcome, *([spec.offset] if spec.offset else []), *([spec.weight] if spec.weight else [])]
    ok = F.lit(True)
    for c in used:
        ok = ok & finite(F.col(c))
    ok = ok & F.col(spec.outcome).isin(0, 1) if spec.family == "binomial" else ok & (F.col(spec.outcome) >= 0)

    def on_lattice(c: str) -> Column:
        lo, hi = spec.bounds[c]
        return lattice(clip(F.col(c).cast("double"), lo, hi), scale)

    def or_zero(v: Column) -> Column:
        return F.when(ok, v).otherwise(F.lit(0).cast("long"))

    one = F.lit(scale).cast("long")
    d = df.withColumn("block", F.floor(F.col(position) / spec.block_rows))
    d = d if block is None else d.where(F.col("block") == block)
    x = F.array(or_zero(one), *[or_zero(on_lattice(c)) for c in names])
    return d.select("block", F.col(position).cast("long").alias("position"), or_zero(on_lattice(spec.weight) if spec.weight else one).alias("weight"), x.alias("x"), or_zero(on_lattice(spec.outcome)).alias("y"), or_zero(on_lattice(spec.offset) if spec.offset else F.lit(0).cast("long")).alias("offset"))


def formula(text: str) -> tuple[str, list[str]]:
    """Outcome and sorted predictors of ``y ~ x1 + x2``; main effects only."""
    import re

    m = re.fullmatch(r"\s*([A-Za-z.][\w.]*)\s*~\s*([A-Za-z.][\w.]*(?:\s*\+\s*[A-Za-z.][\w.]*)*)\s*", text)
    if not m:
        raise ValueError("a formula is an outcome, ~, and predictors joined by +")
    xs = sorted({p.strip() for p in m[2].split("+")}, key=str.encode)
    if m[1] in xs:
        raise ValueError("the outcome cannot be a predictor")
    return m[1], xs
