"""Bounded statistics against worked examples, and their invariances."""

import pytest
from pyspark.sql import functions as F

from cohortlake.operators import bound, capsule, families
from cohortlake.plans.policy import Policy, Refused

INF, NAN = float("inf"), float("nan")
POLICY = Policy("patient_id", 5, 4, {"entry": (0, 10), "time": (0, 10), "x": (0, 10)}, {"cat_a": ("B", "A"), "cat_b": ("L", "R"), "status": ("event", "censor")}, grid_bits=8)
ROWS = [("u1", 0.0, 4.0, 0.0, "A", "L", "event"), ("u1", 0.0, 8.0, 10.0, "A", "L", "event"), ("u2", 2.0, 10.0, 20.0, "B", "R", "censor"), ("u3", INF, None, NAN, None, "outside", "outside")]
SCHEMA = "patient_id string, entry double, time double, x double, cat_a string, cat_b string, status string"


@pytest.fixture(params=["as is", "reversed", "repeated", "invalid"])
def frame(spark, request):
    rows = {"as is": ROWS, "reversed": ROWS[::-1], "repeated": ROWS + ROWS[:2], "invalid": [*ROWS, ("u1", INF, None, None, None, None, None)]}[request.param]
    return spark.createDataFrame(rows, SCHEMA)


def values(block):
    return [r.value for r in block.orderBy("coord").collect()]


def units(df, *columns):
    out = None
    for c in columns:
        u = bound.bounded_numeric(df, POLICY, c, name=c)
        out = u if out is None else out.join(u, "unit")
    return out


def test_capsule_example(frame):
    assert bound.admit(frame, POLICY) == 3
    assert values(families.admitted_count(frame, POLICY)) == [3]
    u = units(frame, "entry", "time", "x")
    for c, want in {"entry": [2, 51, 10], "time": [2, 410, 348], "x": [2, 384, 320]}.items():
        assert values(families.moments(u, POLICY, c, c)) == want
    assert values(families.pair_moments(u, POLICY, "entry", "time", "entry", "time")) == [2, 51, 410, 10, 348, 51]
    assert values(families.pair_moments(u, POLICY, "entry", "x", "entry", "x")) == [2, 51, 384, 10, 320, 51]
    assert values(families.pair_moments(u, POLICY, "time", "x", "time", "x")) == [2, 410, 384, 348, 320, 333]
    assert values(families.gaussian(u, POLICY, "time", ["x", "entry"])) == [2, 512, 51, 10, 384, 51, 320, 410, 51, 333, 348]
    assert values(families.histogram(u, "x", [5.0, 10.0], "x")) == [1, 1, 1]
    for c in POLICY.levels:
        assert values(families.marginals(bound.bounded_category(frame, POLICY, c), POLICY, c)) == [1, 1]
    for (a, b), want in {("cat_a", "cat_b"): [1, 0, 0, 1], ("cat_a", "status"): [0, 1, 1, 0], ("cat_b", "status"): [0, 1, 1, 0]}.items():
        assert values(families.pairs(bound.bounded_pair(frame, POLICY, a, b), POLICY, a, b)) == want
    s = bound.survival_unit(frame, POLICY, "time", "status", "censor", "entry")
    assert values(families.survival(s, POLICY, "status", "censor", [5.0, 10.0], delayed=True)) == [2, 0, 0, 1, 1, 0, 1]


def test_a_changed_level_changes_the_result(spark):
    df = spark.createDataFrame([*ROWS, ("u1", 0.0, 4.0, 0.0, "B", "L", "event")], SCHEMA)
    assert values(families.marginals(bound.bounded_category(df, POLICY, "cat_a"), POLICY, "cat_a")) == [0, 1]


DESCRIBED = Policy("patient_id", 9, 9, {"x": (0, 4), "y": (0, 8)}, grid_bits=8)
GRIDS = {"x": [1.0, 2.0, 3.0, 4.0], "y": [2.0, 4.0, 6.0, 8.0]}


def test_describe(spark):
    df = spark.createDataFrame([("p1", 0.5, 1.0), ("p2", 1.5, 3.0), ("p3", 2.5, 5.0), ("p4", 3.5, 7.0), ("p5", None, INF)], "patient_id string, x double, y double")
    for name in ("x", "y"):
        assert values(families.describe(df, DESCRIBED, GRIDS).where(F.col("block") == f"describe:{name}")) == [4, 512, 336, 1, 1, 1, 1, 1]
    df = spark.createDataFrame([("p1", -1e308), ("p1", 1e308), ("p2", NAN)], "patient_id string, x double")
    assert values(families.describe(df, DESCRIBED, {"x": GRIDS["x"]})) == [1, 128, 64, 0, 1, 0, 0, 1]
    edges = [(f"p{i}", v) for i, v in enumerate([-INF, 0.0, 1.0, 1.0 + 2**-50, 4.0, INF])]
    df = spark.createDataFrame(edges, "patient_id string, x double")
    assert values(families.describe(df, DESCRIBED, {"x": GRIDS["x"]}))[3:] == [2, 1, 0, 1, 2]


SURVIVAL = Policy("patient_id", 9, 9, {"time": (0, 4)}, {"status": ("0", "A", "B")}, grid_bits=8)


def test_survival(spark):
    rows = [("p1", 4.0, "0", 0.0), ("p1", 2.0, "A", 0.0), ("p2", 3.0, "0", 1.2), ("p3", 4.0, "B", 2.2), ("p4", None, "unknown", 0.0)]
    df = spark.createDataFrame(rows, "patient_id string, time double, status string, entry double")
    got = values(families.survival(bound.survival_unit(df, SURVIVAL, "time", "status", "0"), SURVIVAL, "status", "0", [1.0, 2.0, 3.0, 4.0]))
    assert got == [0, 0, 1, 0, 0, 1, 0, 0, 0, 0, 0, 1, 1]
    delayed = values(families.survival(bound.survival_unit(df, SURVIVAL, "time", "status", "0", "entry"), SURVIVAL, "status", "0", [1.0, 2.0, 3.0, 4.0], delayed=True))
    assert len(delayed) == 17 and delayed[:4] == [1, 1, 1, 0] and sum(delayed) == 7
    df = spark.createDataFrame([("p", 1.0, "A", 2.0), ("p", 3.0, "B", 1.0)], df.schema)
    one = values(families.survival(bound.survival_unit(df, SURVIVAL, "time", "status", "0", "entry"), SURVIVAL, "status", "0", [1.0, 2.0, 3.0, 4.0], delayed=True))
    assert one == [1, 0, 0, 0] + [0] * 8 + [0, 0, 1, 0] + [0]


def test_pairs_within_and_across(spark):
    policy = Policy("patient_id", 9, 9, levels={"row": ("a", "b"), "col": ("c", "d")})
    rows = [("p1", "a", "c"), ("p1", "a", "c"), ("p1", None, "c"), ("p2", "a", "c"), ("p2", "b", "d"), ("p2", "outside", "c"), ("p3", None, "c"), ("p3", "outside", "outside"), ("p4", "b", "d"), ("p4", None, "c")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "patient_id string, row string, col string")
        got = {r.unit: (r.r, r.c) for r in bound.bounded_pair(df, policy, "row", "col").collect()}
        assert got == {"p1": ("a", "c"), "p2": (None, None), "p3": (None, None), "p4": ("b", "d")}
        cross = values(families.pairs_cross(df, policy, "row", df, policy, "col"))
        assert cross == [policy.scale, 0, 0, 0]


@pytest.mark.parametrize("rows", [[(None, 1.0)], [(" ", 1.0)], [("a", 1.0)] * 3, [("a", 1.0), ("b", 1.0), ("c", 1.0)]])
def test_admission_refuses(spark, rows):
    with pytest.raises(Refused):
        bound.admit(spark.createDataFrame(rows, "u string, x double"), Policy("u", 2, 2, {"x": (0, 1)}))


def test_gaussian_cross_floors(spark):
    policy = Policy("unit", 9, 9, {"x": (0, 1), "y": (0, 1)}, grid_bits=8)
    df = spark.createDataFrame([("a", 0.3, 0.7), ("b", 0.9, 0.2), ("c", None, 0.5)], "unit string, x double, y double")
    s, xs, ys = 256, [77, 230], [179, 51]
    want = [2 * s, 2 * s, sum(xs), sum(a * a // s for a in xs), sum(ys), sum(a * b // s for a, b in zip(xs, ys)), sum(b * b // s for b in ys)]
    assert values(families.gaussian_cross(df, policy, "y", ["x"])) == want


def refused(df):
    with pytest.raises(Exception, match="does not meet its policy"):
        df.collect()


@pytest.mark.parametrize("rows", [[(None, 1.0, "a", "b")], [(" ", 1.0, "a", "b")], [("a", 1.0, "a", "b")] * 3, [("a", 1.0, "a", "b"), ("b", 1.0, "a", "b"), ("c", 1.0, "a", "b")]])
def test_every_family_refuses(spark, rows):
    policy = Policy("u", 2, 2, {"x": (0, 2)}, {"g": ("a", "b"), "h": ("b",)}, grid_bits=8)
    df = spark.createDataFrame([("d", 1.0, "a", "b"), *rows][1 if len(rows) > 1 else 0 :], "u string, x double, g string, h string")
    good = spark.createDataFrame([("a", 1.0, "a", "b"), ("d", 1.0, "a", "b")], df.schema)
    x, ok = bound.bounded_numeric(df, policy, "x"), bound.bounded_numeric(good, policy, "x", name="y")
    refused(families.admitted_count(df, policy))
    refused(families.moments(x, policy, "x"))
    refused(families.histogram(x, "x", [1.0, 2.0]))
    refused(families.all_moments(bound.bounded_numerics(df, policy, {"x": "x"}), policy, ["x"]))
    both = Policy("unit", 9, 9, {"v": (0, 2), "y": (0, 2)}, grid_bits=8)
    joined = x.join(ok, "unit")
    refused(families.pair_moments(joined, both, "v", "y", "v", "y"))
    refused(families.gaussian(joined, both, "y", ["v"]))
    refused(families.gaussian_cross(joined, both, "y", ["v"]))
    refused(families.marginals(bound.bounded_category(df, policy, "g"), policy, "g"))
    refused(families.pairs(bound.bounded_pair(df, policy, "g", "h"), policy, "g", "h"))
    refused(families.pairs_cross(good, policy, "g", df, policy, "h"))
    refused(families.describe(df, policy, {"x": [1.0, 2.0]}))
    refused(families.survival(bound.survival_unit(df, Policy("u", 2, 2, {"x": (0, 2)}, {"g": ("a", "b")}), "x", "g", "a"), policy, "g", "a", [1.0, 2.0]))
    owners = [capsule.Owner("l", good, policy).category("g", "g"), capsule.Owner("r", df, policy).category("h", "h")]
    refused(capsule.space(owners, [("n", families.marginals_terms(policy, "g", "g"))]))
    assert values(families.moments(ok, policy, "x", "y")) == [2, 256, 128]


def test_fixed_cohort(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "u string, x double")
    assert values(families.admitted_count(df, Policy("u", 5, 2, adjacency="replace_one", cohort=2))) == [2]
    refused(families.admitted_count(df, Policy("u", 5, 2, adjacency="replace_one", cohort=3)))


def test_all_moments_are_the_single_ones(frame):
    columns = ["entry", "time", "x"]
    got = {}
    for r in families.all_moments(bound.bounded_numerics(frame, POLICY, {c: c for c in columns}), POLICY, columns).orderBy("at", "coord").collect():
        got.setdefault(r.block, []).append(r.value)
    u = units(frame, *columns)
    want = {f"numeric:{c}": values(families.moments(u, POLICY, c, c)) for c in columns}
    want |= {f"pair:{a},{b}": values(families.pair_moments(u, POLICY, a, b, a, b)) for a, b in (("entry", "time"), ("entry", "x"), ("time", "x"))}
    assert got == want and list(got) == list(want)


def test_capsule_space_is_the_single_blocks(frame):
    owner = capsule.Owner("all", frame, POLICY).numeric("x", "x").numeric("time", "time").category("a", "cat_a").category("p", "cat_a", "cat_b")
    got = {}
    parts = [("x", families.moments_terms(POLICY, "x", "x")), ("xt", families.pair_terms(POLICY, "time", "x", "time", "x")), ("a", families.marginals_terms(POLICY, "cat_a", "a")), ("ab", families.pairs_terms(("A", "B"), ("L", "R"), "p.cat_a", "p.cat_b")), ("h", families.histogram_terms([5.0, 10.0], "x"))]
    for r in capsule.space([owner], parts).orderBy("at", "coord").collect():
        got.setdefault(r.block, []).append(r.value)
    assert got == {"x": [2, 384, 320], "xt": [2, 410, 384, 348, 320, 333], "a": [1, 1], "ab": [1, 0, 0, 1], "h": [1, 1, 1]}
