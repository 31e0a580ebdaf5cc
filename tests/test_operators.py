"""Alignment, guards, windows, models, noise and sources."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.functions import noise, scalar
from cohortlake.operators import align, exact, models, windows
from cohortlake.plans import release
from cohortlake.plans.policy import Disclosure, Policy, Refused
from cohortlake.sources import tables


def test_first_rows(spark):
    df = spark.createDataFrame([("a", 1, 1.0), (None, 2, 2.0), ("", 3, 3.0), ("a", 4, 4.0), ("b", 5, None)], "id string, pos int, x double")
    got = {(r.id, r.pos) for r in align.select_rows(df, "id", ["pos"]).collect()}
    assert got == {("a", 1), ("b", 5)}
    assert [(r.id, r.pos) for r in align.select_rows(df, "id", ["pos"], "complete_cases").collect()] == [("a", 1)]


def test_analysis_rows(spark):
    df = spark.createDataFrame([("id-1", 1.0), ("id-2", None), (None, 3.0), ("id-4", 4.0)], "id string, x double")
    assert sorted(r.id for r in align.analysis_rows(df, "id").collect()) == ["id-1", "id-4"]
    assert sorted(r.id for r in align.analysis_rows(df, "id", "none").collect()) == ["id-1", "id-2", "id-4"]
    with pytest.raises(Refused):
        align.analysis_rows(df, "id", "na.fail")
    with pytest.raises(Refused):
        align.analysis_rows(df.union(df), "id")


@pytest.mark.parametrize("k", [2, 3, 4, 5])
def test_k_way_match(spark, k):
    sets = [{i for i in range(2**k) if i >> t & 1} for t in range(k)]
    frames = [spark.createDataFrame([(str(i),) for i in s for _ in range(2)], "id string") for s in sets]
    assert {r.id for r in align.matched_ids(frames, ["id"] * k).collect()} == {str(2**k - 1)}


def test_row_positions(spark):
    values = list(range(1000))
    random.Random(1).shuffle(values)
    d = align.row_positions(spark.createDataFrame([(v,) for v in values], "v int"), ["v"], parts=7)
    assert all(r.v == r.row_pos for r in d.collect())


def test_contingency_guard(spark):
    rows = [("F", "yes")] * 12 + [("F", "no")] * 9 + [("M", "yes")] * 2 + [("M", "no")] * 7 + [(None, "no")]
    df = spark.createDataFrame(rows, "sex string, smoke string")
    got = {(r.a, r.b): (r.n, r.suppressed) for r in exact.contingency(df, "sex", "smoke", Disclosure(), suppress=True).collect()}
    assert got == {("F", "yes"): (12, False), ("F", "no"): (9, False), ("M", "yes"): (0, True), ("M", "no"): (7, False)}
    with pytest.raises(Exception, match="a cell is too small"):
        exact.contingency(df, "sex", "smoke", Disclosure()).collect()


def test_guards():
    g = Disclosure()
    for call in (lambda: g.check_cells([0, 2]), lambda: g.check_clusters(4), lambda: g.check_count(2), lambda: g.check_model(30, 10)):
        with pytest.raises(Refused):
            call()
    g.check_cells([0, 3])
    g.check_model(200, 4)


def test_histogram_is_whole(spark):
    xs = [random.Random(2).gauss(0, 1.5) for _ in range(50)] + [-1.0, 3.0, None, None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = {r.bin: r.n for r in exact.histogram(df, "x", [-3.0, -1.0, 0.0, 1.0, 3.0], Disclosure(min_cell=0)).collect()}
    assert got[-1] == 2 and sum(got.values()) == len(xs) and got[4] == sum(1 for x in xs if x is not None and 1 <= x <= 3)


def test_standardise(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (4.0,)], "x double")
    with pytest.raises(Refused):
        exact.standardise(df, ["x"])
    got = [r.x for r in exact.standardise(df, ["x"], missing="mean").collect()]
    assert got[2] == 0 and abs(sum(got)) < 1e-12
    constant = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r.x for r in exact.standardise(constant, ["x"], "scale_only").collect()] == [2.0, 2.0]


def test_neighbours_and_ties(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (1, 3, 30), (2, 1, 5)], "c int, o int, v int")
    got = [tuple(r)[2:] for r in windows.neighbours(df, "c", ["o"], "v").orderBy("c", "o").collect()]
    assert got == [(10, 0, 20, 0, 10, 0), (20, 10, 30, 20, 20, 20), (30, 20, 0, 30, 0, 0), (5, 0, 0, 0, 0, 0)]
    with pytest.raises(Refused):
        windows.check_strict_order(df.union(df), "c", ["o"])


def test_polygamma(spark):
    xs = [0.3, 1.0, 2.5, 7.0, 40.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", scalar.digamma(F.col("x")).alias("a"), scalar.trigamma(F.col("x")).alias("b")).collect()
    for r in got:
        h = 1e-5
        assert abs(r.a - (math.lgamma(r.x + h) - math.lgamma(r.x - h)) / (2 * h)) < 1e-6
        assert abs(r.b - sum(1 / (r.x + k) ** 2 for k in range(200000)) - 1 / (r.x + 200000)) < 1e-6


def test_glm_fits(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    eta = 0.3 + x @ [0.8, -0.5]
    cases = {"gaussian": eta + rng.normal(size=400) * 0.1, "binomial": (rng.random(400) < 1 / (1 + np.exp(-eta))).astype(float), "poisson": rng.poisson(np.exp(eta)).astype(float)}
    for family, y in cases.items():
        df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, y double").cache()
        beta = models.fit_glm(df, [F.col("a"), F.col("b")], F.col("y"), family)
        got = [r.value for r in models.gradient(df, [F.col("a"), F.col("b")], F.col("y"), family, beta[1:].tolist(), float(beta[0])).orderBy("j").collect()]
        assert np.max(np.abs(got)) < 1e-5, family


def test_negative_binomial_theta(spark):
    rng = np.random.default_rng(4)
    y = rng.negative_binomial(2.0, 2.0 / 7.0, 4000)
    theta = models.fit_nb_theta(spark.createDataFrame([(float(v),) for v in y], "y double"), F.col("y"))
    assert 1.7 < theta < 2.3


def test_cox_score_is_the_gradient(spark):
    rows = [(-1.0, t, s, x) for t, s, x in [(1.5, True, 0.2), (2.5, True, 1.0), (2.0, False, -0.5), (3.9, True, -1.0), (4.0, False, 0.3)]]
    df = spark.createDataFrame(rows, "entry double, stop double, event boolean, x double")

    def at(beta):
        return models.cox_parts(windows.risk_sums(df, F.col("entry"), F.col("stop"), F.col("event"), F.col("x"), beta, [1.0, 2.0, 3.0, 4.0]), beta)

    h = 1e-5
    loglik, score, information = at(0.4)
    assert abs(score - (at(0.4 + h)[0] - at(0.4 - h)[0]) / (2 * h)) < 1e-6
    assert abs(information + (at(0.4 + h)[1] - at(0.4 - h)[1]) / (2 * h)) < 1e-6
    best = models.fit_cox(df, F.col("entry"), F.col("stop"), F.col("event"), F.col("x"), [1.0, 2.0, 3.0, 4.0])
    assert abs(at(best)[1]) < 1e-8


def test_imputation(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0), (4, float("nan"))], "id int, x double")
    assert [r.f for r in models.impute_mean(df, "x", "f").orderBy("id").collect()] == [1.0, 2.0, 3.0, 2.0]
    levels = spark.createDataFrame([(v,) for v in ["a", "b", None, "b", None, "a"]], "g string")
    assert [r.f for r in models.impute_mode(levels, "g", "f").where("g is null").collect()] == ["a", "a"]
    rows = spark.createDataFrame([(i, float(i), 2.0 * i + 1 if i % 4 else None) for i in range(200)], "id int, x double, y double")
    one, two = (models.impute_ridge(rows, "y", ["x"], "id", "f", seed=5).orderBy("id").collect() for _ in range(2))
    assert one == two and all(abs(r.f - (2 * r.x + 1)) < 1 for r in one)


def test_formula():
    assert models.formula("y ~ b + a") == ("y", ["a", "b"])
    for bad in ("y ~ a * b", "y", "y ~ y", "~ a"):
        with pytest.raises(ValueError):
            models.formula(bad)


def test_noise_distributions():
    draws = [noise.discrete_laplace(noise.Stream(b"k", "r", i), 1.0, 0.5) for i in range(4000)]
    a = math.exp(-0.5)
    assert abs(statistics.mean(draws)) < 0.25 and abs(statistics.pvariance(draws) / (2 * a / (1 - a) ** 2) - 1) < 0.15
    draws = [noise.discrete_gaussian(noise.Stream(b"k", "g", i), 4.0) for i in range(3000)]
    assert abs(statistics.mean(draws)) < 0.3 and abs(statistics.pstdev(draws) / 4 - 1) < 0.08
    assert noise.laplace_radius(1.0, 1.0) == 3
    assert abs(noise.gaussian_delta(noise.gaussian_sigma(1.0, 1.0, 1e-5), 1.0, 1.0) - 1e-5) < 1e-8
    assert noise.choose(1, 1, 1, 1.0, 0.0) == ("laplace", 3)
    assert noise.choose(10_000, 10_000.0, 100.0, 1.0, 1e-6)[0] == "gaussian"


def test_releases_repeat(spark, tmp_path):
    blocks = spark.createDataFrame([("b", i, 10 * i) for i in range(20)], "block string, coord long, value long")
    for mechanism in ("laplace", "convolution", "gaussian"):
        first = release.noised(blocks, "r", b"s", 1.0, 0.3, mechanism=mechanism, sigma=3.0).orderBy("coord").collect()
        again = release.noised(blocks.repartition(5), "r", b"s", 1.0, 0.3, mechanism=mechanism, sigma=3.0).orderBy("coord").collect()
        assert first == again and all(r.value >= 0 for r in first) and any(r.value != 10 * r.coord for r in first)
    ledger, made = release.Ledger(str(tmp_path)), []

    def make():
        made.append(1)
        return release.noised(blocks, "r", b"s", 1.0, 0.3)

    assert sorted(ledger.release("x", make).collect()) == sorted(ledger.release("x", make).collect()) and len(made) == 1
    with pytest.raises(Refused):
        release.composed([(5.0, 0.0), (4.0, 0.0)])


def test_sources(spark):
    df = spark.createDataFrame([(1, "x", [1])], "b int, a string, c array<int>")
    assert tables.snapshot(df.drop("c")).columns == ["a", "b"]
    with pytest.raises(TypeError):
        tables.snapshot(df)
    rows = spark.range(1000).select(F.col("id").alias("at"), (F.col("id") * 7 % 13).alias("v"))
    one = tables.digest(rows, "at", block=64).first()
    assert one == tables.digest(rows.repartition(9), "at", block=64).first() and one.n_blocks == 16
    assert one != tables.digest(rows.withColumn("v", F.col("v") + (F.col("at") == 5).cast("int")), "at", block=64).first()
    s = tables.Session(spark)
    s.assign("t1", df)
    s.standardised["t1"] = df.drop("c")
    assert s.resolve("t1").columns == ["b", "a"]
    kept, gone = tables.drop_temporary(df.withColumn("__t_x", F.lit(1)).withColumn("__t_y", F.lit(1)), "__t_", ("__t_y",))
    assert gone == ["__t_x"] and "__t_y" in kept.columns


def test_policy_checks():
    for bad in ({"grid_bits": 4}, {"bounds": {"x": (1, 1)}}, {"bounds": {"x": (0, float("inf"))}}, {"adjacency": "other"}, {"levels": {"1x": ("a",)}}):
        with pytest.raises(ValueError):
            Policy("u", 1, 1, **bad)


def test_streaming_counts(spark, tmp_path):
    from cohortlake.streaming import releases

    spark.createDataFrame([("2024-01-01 01:00:00", "a"), ("2024-01-01 02:00:00", "a"), ("2024-01-05 00:00:00", "b")], "ts string, k string").select(F.col("ts").cast("timestamp").alias("ts"), "k").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    ledger = release.Ledger(str(tmp_path / "out"))
    q = releases.windowed_counts(stream, "ts", "k").writeStream.outputMode("append").foreachBatch(releases.release_batches(ledger, b"s", 1.0)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out" / "*")).collect()
    assert [r.block.split("|")[1] for r in got] == ["a"]
