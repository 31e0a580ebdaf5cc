"""Whole-table orders, guards that refuse, bounded models, manifests, plans and stored releases."""

import hashlib
import hmac
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.functions import noise, scalar
from cohortlake.operators import align, exact, families, models, ranges, windows
from cohortlake.plans import policy, release
from cohortlake.plans.policy import CoxSpec, Disclosure, Refused
from cohortlake.sources import tables

GUARD = Disclosure()


def rows_of(n, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice("aaaaaaaabc"), rng.choice([None, *range(50)]), rng.randint(-9, 9)) for i in range(n)]


def key(r):
    return (r[2] is not None, r[2] or 0, r[0])


@pytest.mark.parametrize("parts", [1, 7, 40])
@pytest.mark.parametrize("reverse", [False, True])
def test_running_sums_over_ranges(spark, parts, reverse):
    rows = rows_of(600)
    df = spark.createDataFrame(rows, "id int, s string, t int, v int").repartition(5)
    whole, within, masked = 0, {}, 0
    want = {}
    for r in sorted(rows, key=key, reverse=reverse):
        whole += r[3]
        within[r[1]] = within.get(r[1], 0) + r[3]
        masked += r[3] if r[3] > 0 else 0
        want[r[0]] = (whole, within[r[1]], masked)
    got = {r.id: r.running for r in windows.running_sum(df, F.col("v"), ["t", "id"], reverse=reverse, parts=parts).collect()}
    by = {r.id: r.running for r in windows.running_sum(df, F.col("v"), ["t", "id"], ["s"], reverse, parts=parts).collect()}
    some = {r.id: r.running for r in windows.running_sum(df, F.col("v"), ["t", "id"], reverse=reverse, mask=(F.col("v") > 0).cast("int"), parts=parts).collect()}
    assert {i: (got[i], by[i], some[i]) for i in want} == want and len(got) == len(by) == 600


@pytest.mark.parametrize("strata", [None, ["s"]])
def test_reverse_sums_are_not_summed_anew_for_each_row(spark, strata):
    rows = [(i, "ab"[i % 2], i // 2, None if i < 20 or i >= 80 else i) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, s string, t int, v int").repartition(3)
    for reverse in (False, True):
        d = windows.running_sum(df, F.col("v"), ["t", "id"], strata, reverse, parts=9)
        assert "unboundedfollowing" not in d._jdf.queryExecution().toString().lower()
        want = {}
        for i, s, _, _ in rows:
            known = [r[3] for r in rows if r[3] is not None and (r[0] >= i if reverse else r[0] <= i) and (strata is None or r[1] == s)]
            want[i] = sum(known) if known else None
        assert {r.id: r.running for r in d.collect()} == want


def test_reverse_sums_within_two_strata(spark):
    rows = [(i, "ab"[i % 20 == 0], None if i % 3 == 0 else i % 3, None if i >= 150 else i) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, s string, u int, v int").repartition(3)
    d = windows.running_sum(df, F.col("v"), ["id"], ["s", "u"], True, parts=12)
    assert "unboundedfollowing" not in d._jdf.queryExecution().toString().lower()
    known = {r[0]: [x[3] for x in rows if x[1:3] == r[1:3] and x[0] >= r[0] and x[3] is not None] for r in rows}
    assert {r.id: r.running for r in d.collect()} == {i: sum(v) if v else None for i, v in known.items()}


def test_ranges_are_found_in_an_array_of_bounds(spark):
    rows = rows_of(600, 3)
    df = spark.createDataFrame(rows, "id int, s string, t int, v int").repartition(5)
    for parts in (1, 2, 9, 200):
        d, cuts = ranges.searched(df, ["t", "id"], parts)
        assert {r.id: r[ranges.PART] for r in d.collect()} == {r[0]: sum(key((c.id, None, c.t)) <= key(r) for c in cuts) for r in rows}
        assert d.columns == [*df.columns, ranges.PART]


def test_numbers_quantiles_and_dense_ids(spark):
    rows = rows_of(500, 2)
    df = spark.createDataFrame(rows, "id int, s string, t int, v int").repartition(3)
    numbers = {r.id: r.n for r in ranges.numbered(df, ["t", "id"], "n", parts=9).collect()}
    assert [i for i, _ in sorted(numbers.items(), key=lambda x: x[1])] == [r[0] for r in sorted(rows, key=key)]
    known = [r[2] for r in rows if r[2] is not None]
    assert np.allclose(exact.quantiles(df, "t", [0.0, 0.25, 0.5, 0.9, 1.0], parts=6), np.quantile(known, [0.0, 0.25, 0.5, 0.9, 1.0]))
    assert exact.quantiles(df.where("false"), "t", [0.5]) == [None]
    ids = {(r.t, r.c) for r in windows.dense_ids(df, "t", "c", parts=5).collect()}
    assert ids == {(None, None)} | {(v, i) for i, v in enumerate(sorted(set(known)), 1)}
    totals = {r.key: r.q for r in windows.grouped_running_sum(df.where("t is not null"), "t", {"q": F.col("v")}, reverse=True, parts=4).collect()}
    assert totals == {t: sum(r[3] for r in rows if r[2] is not None and r[2] >= t) for t in set(known)}


def refuses(df, match):
    with pytest.raises(Exception, match=match):
        df.collect()


def test_small_clusters_and_levels_are_refused(spark):
    rows = [("a", 1.0, "x")] * 6 + [("b", 2.0, "y")] * 2
    df = spark.createDataFrame(rows, "c string, v double, g string")
    whole = df.where("c = 'a'")
    calls = [
        lambda d: exact.cluster_sizes(d, "c", GUARD),
        lambda d: exact.cluster_residuals(d, "c", F.col("v"), GUARD),
        lambda d: exact.cluster_ztz(d, "c", [F.col("v")], GUARD),
        lambda d: windows.broadcast_clusters(d.withColumn("u", F.monotonically_increasing_id()), "u", "c", d.withColumn("u", F.monotonically_increasing_id()).select("u"), "u", GUARD),
    ]
    for call in calls:
        refuses(call(df), "a cluster is too small")
        assert call(whole).count() > 0
    for call in (lambda d: exact.factor_dummies(d, "g", ["x", "y"], GUARD), lambda d: exact.one_hot(d, "g", ["x", "y"], GUARD), lambda d: exact.one_hot_margins(d, "g", ["x", "y"], GUARD)):
        refuses(call(df), "a level is too small")
        assert call(whole).count() > 0
    refuses(exact.joint_release([(whole, "c", "g"), (df, "c", "g")], GUARD), "a cell is too small")
    assert exact.joint_release([(whole, "c", "g")], GUARD).count() == 1
    refuses(exact.crosstab(df, "c", "g", most_levels=1), "too many levels")
    refuses(exact.guarded_sum(df.where("c = 'b'"), F.col("v"), GUARD), "too few rows")
    refuses(exact.gram(whole, [F.lit(1.0), F.col("v")], guard=GUARD), "too many columns")
    refuses(windows.broadcast_clusters(spark.createDataFrame([(1, None)] * 6, "u int, c string"), "u", "c", spark.createDataFrame([(1,)], "u int"), "u", GUARD), "a cluster is missing")
    refuses(families.one_row_a_unit(df, "c", 100), "different units")


def test_binomial_gradient_guard(spark):
    df = spark.createDataFrame([(float(i % 7), float(i < 2)) for i in range(60)], "x double, y double")
    refuses(models.gradient(df, [F.col("x")], F.col("y"), "binomial", [0.1], guard=GUARD), "too many columns")
    assert models.gradient(df, [F.col("x")], F.col("y"), "binomial", [0.1]).count() == 2


def test_suppressed_table_masks_margins(spark):
    rows = [("a", "x")] * 9 + [("a", "y")] * 2 + [("b", "x")] * 7 + [("c", "x")] * 2
    got = {(r.a, r.b): (r.n, r.row_total, r.col_total) for r in exact.contingency(spark.createDataFrame(rows, "p string, q string"), "p", "q", GUARD, suppress=True).collect()}
    assert got["a", "x"] == (9, None, None) and got["b", "x"] == (7, None, None) if ("b", "x") in got else True
    assert ("c", "x") not in got and any(a == "<suppressed>" for a, _ in got) and all(n == 0 or n >= 3 for n, _, _ in got.values())


def test_weights_and_offsets(spark):
    df = spark.createDataFrame([(1.0, 0.5), (2.0, 0.1)], "w double, o double")
    assert models.with_weights(df, "w").columns == ["w", "o", "weight"] and models.without_offset(models.with_offset(df, "o")).columns == ["w", "o"]
    for bad in (None, -1.0, math.inf, math.nan):
        refuses(models.with_weights(df.union(spark.createDataFrame([(bad, 0.0)], df.schema)), "w"), "weights")
    for bad in (None, 31.0, math.inf, math.nan):
        refuses(models.with_offset(df.union(spark.createDataFrame([(1.0, bad)], df.schema)), "o"), "offsets")


def test_gls_of_null_clusters_and_values(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("a", None), (None, 3.0), ("b", 5.0)], "c string, x double")
    shares = spark.createDataFrame([("a", 0.5)], "cluster string, share double")
    got = sorted((r.c or "", r.x or 0, r.x_t, r.intercept_t) for r in exact.gls_transform(df, ["x"], "c", shares).collect())
    assert got == [("", 3.0, 0.0, 1.0), ("a", 0, 0.0, 0.5), ("a", 2.0, 0.5, 0.5), ("a", 4.0, 2.5, 0.5), ("b", 5.0, 0.0, 1.0)]


def test_names_of_levels_stay_apart():
    assert exact.level_names("v", ["a b", "a-b", "c"]) == ["va.b", "va.b.1", "vc"]


@pytest.fixture(scope="module")
def hazard():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        x = rng.uniform(-1, 1, 2)
        entry, stop = int(rng.integers(0, 3)), int(rng.integers(1, 7))
        rows.append((bool(rng.random() < 0.95), entry, stop, int(rng.random() < 0.6), float(x[0]), float(x[1]) * (3 if i % 50 == 0 else 1)))
    return rows


SPEC = CoxSpec((1.0, 2.0, 3.0, 4.0, 5.0, 6.0), {"x1": (-1.0, 1.0), "x2": (-1.0, 1.0)}, 400, 1.5, 2.0, ridge=1e-3, delayed=True)
SCHEMA = "valid boolean, entry_index int, stop_index int, status int, x1 double, x2 double"


def naive_cox(rows, beta):
    value, score, info = 0.0, np.zeros(2), np.zeros((2, 2))
    kept = [(e, s, d, np.array([a, b])) for v, e, s, d, a, b in rows if v and e < s and abs(a) <= 1 and abs(b) <= 1 and math.hypot(a, b) <= 1.5]
    for g in range(1, 7):
        risk = [x for e, s, _, x in kept if e < g <= s]
        dead = [x for e, s, d, x in kept if d and s == g]
        if not dead:
            continue
        w = np.array([math.exp(x @ beta) for x in risk])
        x = np.array(risk)
        mean = w @ x / w.sum()
        value += sum(x @ beta for x in dead) - len(dead) * math.log(w.sum())
        score += sum(dead) - len(dead) * mean
        info += len(dead) * ((x * w[:, None]).T @ x / w.sum() - np.outer(mean, mean))
    k = 400 * 1e-3
    return value - k * beta @ beta / 2, score - k * beta, info + k * np.eye(2)


def test_vector_cox(spark, hazard):
    df = models.cox_rows(spark.createDataFrame(hazard, SCHEMA), ["x1", "x2"], SPEC).cache()
    for beta in ([0.0, 0.0], [0.4, -0.3]):
        for got, want in zip(models.cox_at(df, ["x1", "x2"], beta, SPEC), naive_cox(hazard, np.array(beta)), strict=True):
            assert np.allclose(got, want, atol=1e-8)
    fit = models.fit_cox_bounded(df, ["x1", "x2"], SPEC)
    assert np.abs(naive_cox(hazard, fit["beta"])[1]).max() < 1e-6 and not fit["on_boundary"]
    tight = models.fit_cox_bounded(df, ["x1", "x2"], replace(SPEC, beta_norm=0.05))
    assert tight["on_boundary"] and abs(np.linalg.norm(tight["beta"]) - 0.05) < 1e-9
    quiet = models.fit_cox_private(df, ["x1", "x2"], replace(SPEC, iterations=3), np.zeros((3, 2)))
    beta = np.zeros(2)
    for _ in range(3):
        _, score, _ = naive_cox(hazard, beta)
        beta = beta + 0.5 * score / 400
        beta = beta * min(1.0, 2.0 / max(np.linalg.norm(beta), 1e-300))
    assert np.allclose(quiet, beta)
    with pytest.raises(Refused):
        models.cox_at(df, ["x1", "x2"], [0.0, 0.0], replace(SPEC, least_at_risk=10_000))


def test_cox_rows_refuse_and_zero(spark, hazard):
    got = models.cox_rows(spark.createDataFrame(hazard, SCHEMA), ["x1", "x2"], SPEC).collect()
    for r in got:
        assert r.valid or (r.entry_index, r.stop_index, r.status, r.x1, r.x2) == (0, 1, 0, 0.0, 0.0)
    for bad in ((None, 0, 1, 0, 0.0, 0.0), (True, -1, 1, 0, 0.0, 0.0), (True, 0, 7, 0, 0.0, 0.0), (True, 0, 1, 2, 0.0, 0.0), (True, 0, 1, 0, math.nan, 0.0)):
        refuses(models.cox_rows(spark.createDataFrame([*hazard[:3], bad], SCHEMA), ["x1", "x2"], SPEC), "not of its shape")


def test_cox_sensitivity():
    s, sigma = models.cox_sensitivity(replace(SPEC, delayed=False))
    assert abs(s - (4 * 1.5 / 400 + math.exp(6) * (3 + 2.25) * math.log(401) / 400)) < 1e-12
    assert abs(sigma - s * math.sqrt(10 * (2 * math.log(1e6) + 1))) < 1e-9
    assert abs(models.cox_sensitivity(SPEC)[0] - (4 * 1.5 / 400 + math.exp(6) * (3 + 2.25))) < 1e-9


def test_class_imputation(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=600)
    p = 1 / (1 + np.exp(-(0.5 + 2 * x)))
    two = np.where(rng.random(600) < p, "yes", "no")
    three = np.where(x + 0.4 * rng.normal(size=600) > 0.6, "high", np.where(x > -0.6, "middle", "low"))
    rows = [(i, float(a), None if i % 4 == 0 else str(b), None if i % 4 == 0 else str(c)) for i, (a, b, c) in enumerate(zip(x, two, three, strict=True))]
    df = spark.createDataFrame(rows, "id int, x double, a string, b string").cache()
    for column, truth in (("a", two), ("b", three)):
        likely = {r.id: r.f for r in models.impute_class(df, column, ["x"], "id", "f", draw=False).collect()}
        drawn = {r.id: r.f for r in models.impute_class(df, column, ["x"], "id", "f", seed=3).collect()}
        again = {r.id: r.f for r in models.impute_class(df.repartition(7), column, ["x"], "id", "f", seed=3).collect()}
        assert drawn == again and all(drawn[i] == truth[i] for i in range(600) if i % 4)
        assert np.mean([likely[i] == truth[i] for i in range(0, 600, 4)]) > 0.75
        shares = [np.mean([drawn[i] == v for i in range(0, 600, 4)]) - np.mean(truth == v) for v in set(truth)]
        assert max(map(abs, shares)) < 0.15
    beta, _ = models._class_fit(df.dropna(), [F.col("x")], F.col("a"), ["no", "yes"], 1.0, 25)
    known = np.array([i % 4 != 0 for i in range(600)])
    mu = 1 / (1 + np.exp(-(beta["yes"][0] + beta["yes"][1] * x[known])))
    r = (two[known] == "yes") - mu
    assert abs(r.sum()) < 1e-4 and abs((r * x[known]).sum() - beta["yes"][1]) < 1e-4
    with pytest.raises(ValueError):
        models.impute_class(df.withColumn("a", F.lit("one")), "a", ["x"], "id", "f")
    assert models.predictors(df.withColumn("y__mi_1", F.lit(1.0)).withColumn("z", F.when(F.col("id") > 3, 1.0)), "a", "f") == ["id", "x"]


def test_manifest_binds_rows_and_order(spark):
    rows = [(i, f"id-{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "row_pos int, id string")
    bound = align.manifest(df.repartition(4), key="k")
    align.check_manifest(df, bound, key="k")
    align.check_consistent(df.withColumn("x", F.lit(1)), df.repartition(3), key="k")
    moved = df.withColumn("row_pos", F.when(F.col("row_pos") == 3, 4).when(F.col("row_pos") == 4, 3).otherwise(F.col("row_pos")))
    for other in (df.where("row_pos < 49"), moved, df.withColumn("id", F.when(F.col("row_pos") == 7, "x").otherwise(F.col("id")))):
        with pytest.raises(Refused):
            align.check_manifest(other, bound, key="k")
    assert align.contract([align.Offer("b", 10), align.Offer("a", 7)]) == ("a", 10)
    with pytest.raises(ValueError):
        align.contract([align.Offer("a", 1), align.Offer("a", 2)])


def test_bits(spark):
    for bits in ([], [1], [0, 1, 1, 0, 0, 0, 0, 1, 1], [1] * 16):
        got = bytes(spark.createDataFrame([(bits,)], "b array<int>").select(scalar.pack_bits(F.col("b")).alias("p")).first().p)
        assert got == np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()
    chosen = [0, 3, 9, 4095 * 8 + 1, 39_999]
    r = align.packed_selection(spark.createDataFrame([(i,) for i in chosen], "row_pos int"), 40_000).first()
    want = np.zeros(40_000, np.uint8)
    want[chosen] = 1
    assert bytes(r.bits) == np.packbits(want, bitorder="little").tobytes() and r.n_set == 5


def test_keyed_hashes(spark):
    r = spark.createDataFrame([("ab",), (None,)], "x string").select(scalar.hmac_sha256(F.col("x"), b"k" * 70).alias("h"), scalar.pseudonym(F.col("x"), "k", "s").alias("p")).collect()
    assert r[0].h == hmac.new(b"k" * 70, b"ab", hashlib.sha256).hexdigest() and r[1] == (None, None)
    a, b = (spark.range(1).select(scalar.pseudonym(F.lit(x), "k", s).alias("p")).first().p for x, s in (("1:b", "a"), ("b", "a1")))
    assert a != b
    assert policy.canonical_json({"b": 1, "a": [1, "é"]}) == '{"a":[1,"é"],"b":1}'
    assert policy.hmac_hex(b"k", {"a": 1}) == hmac.new(b"k", b'{"a":1}', hashlib.sha256).hexdigest()


def test_plans():
    one, two = noise.plan_laplace(5, 1.0, 2.0), noise.plan_laplace(5, 1.0, 2.0, peers=2)
    assert two.variance == 2 * one.variance and two.radius > one.radius and one.implementation_delta <= 2.0**-40
    a = math.exp(-0.5)
    pmf = {k: (1 - a) / (1 + a) * a ** abs(k) for k in range(-300, 301)}
    for r in (0, 3, 11):
        single = sum(v for k, v in pmf.items() if abs(k) > r)
        both = sum(v * w for k, v in pmf.items() for j, w in pmf.items() if abs(k + j) > r)
        assert abs(noise.convolution_tail(a, r, 1) - single) < 1e-9 and abs(noise.convolution_tail(a, r, 2) - both) < 1e-9
    g = noise.plan_gaussian(100, 1.0, 1e-6, 1.0)
    assert abs(g.rho + 2 * math.sqrt(g.rho * math.log(2e6)) - 1.0) < 1e-9 and g.support > g.radius / 2
    assert noise.frequency_backend(5, 1.0, 1e-6, "add_remove")[0] == "convolution"
    assert noise.frequency_sensitivity("replace_one") == (2.0, math.sqrt(2.0))
    assert noise.capsule_mechanism([("marginal", 1)] * 2000, 1, 1, 1.0, 1e-6)[0] == "gaussian"
    assert noise.added(2**53 - 1, 5) == 2**53 - 1 and noise.added(-(2**53), 0) == -(2**53 - 1)
    assert policy.whole_numbers([1.0, 2]) == [1, 2]
    for bad in ([0.5], [2.0**53], [math.nan], [True]):
        with pytest.raises(Refused):
            policy.whole_numbers(bad)


def test_samplers():
    draws = [noise.binomial_gaussian(noise.Stream(b"k", "b", i), 300.0) for i in range(2000)]
    assert abs(np.mean(draws)) < 25 and abs(np.std(draws) / 300 - 1) < 0.08
    draws = [noise.geometric(noise.Stream(b"k", "q", i), 0.2) for i in range(4000)]
    a = math.exp(-0.2)
    assert abs(np.mean(draws) - a / (1 - a)) < 0.35 and min(draws) == 0
    table = noise.gaussian_table(2.0)
    middle = (len(table) - 1) // 2
    weights = [math.exp(-k * k / 8) for k in range(-middle, middle + 1)]
    assert abs((table[middle] - table[middle - 1]) / 2**128 - weights[middle] / sum(weights)) < 1e-12


def test_stored_release_survives_a_failure(spark, tmp_path):
    blocks = spark.createDataFrame([("b", i, 10 * i) for i in range(5)], "block string, coord long, value long")
    ledger = release.Ledger(str(tmp_path))
    bad = blocks.select("block", "coord", F.raise_error(F.lit("stopped")).cast("long").alias("value"))
    with pytest.raises(Exception, match="stopped"):
        ledger.release("r", lambda: bad)
    kept = sorted(ledger.release("r", lambda: release.noised(blocks, "r", b"s", 1.0, 0.1)).collect())
    assert sorted(ledger.release("r", lambda: bad).collect()) == kept and len(kept) == 5


def test_snapshots_are_kept_by_version(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("v"))
    s = tables.Session(spark)
    s.assign("t2", df)
    version = policy.DatasetDescriptor("data", "1")
    right = tables.digest(df, "id").first()["sha256"]
    assert s.snapshot("t2", version, "id", right) is s.snapshot("t2", version, "id", right)
    assert tables.cache_key(version, df) != tables.cache_key(policy.DatasetDescriptor("data", "2"), df) != tables.cache_key(version, df.drop("v"))
    with pytest.raises(Refused):
        s.snapshot("t2", policy.DatasetDescriptor("data", "3"), "id", "0" * 64)
    for bad in (lambda: policy.DatasetDescriptor("", "1"), lambda: policy.SourceDescriptor("1id", "n", "1")):
        with pytest.raises(ValueError):
            bad()


def test_specifications():
    p = policy.Policy("u", 9, 9, {"x": (0, 4), "t": (0, 4), "e": (0, 4)}, {"s": ("0", "A")}, grid_bits=8)
    d = policy.DescribeSpec({"x": (1.0, 4.0)})
    plan = d.plan(p, 2.0)
    assert len(plan) == d.coordinates == 6 and abs(sum({c[1]: c[2] for c in plan[:4]}.values()) - 2.0) < 1e-12
    policy.SurvivalSpec("t", "s", "0", (2.0, 4.0), "e").check(p)
    assert policy.SurvivalSpec("t", "s", "0", (2.0, 4.0), "e").coordinates(p) == 7
    for bad in (policy.SurvivalSpec("t", "s", "?", (4.0,)), policy.SurvivalSpec("t", "s", "0", (2.0,))):
        with pytest.raises(ValueError):
            bad.check(p)
    with pytest.raises(ValueError):
        policy.DescribeSpec({"x": (1.0, 3.0)}).check(p)
    with pytest.raises(ValueError):
        policy.GlmSpec("gaussian", "y", ("x",), {"x": (0, 1), "y": (0, 1)})
