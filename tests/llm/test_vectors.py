"""Vector operators against brute force."""

import numpy as np
import pytest

from cohortlake.llm import forest, onebit

SCHEMA = "vec_id long, embedding array<float>, label int, id string, copies int, leaf string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], l, "x", 1, "y") for i, v, l in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    out = []
    for i in range(500):
        c = centres[i % 12]
        out.append((i, c + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.5]), int(i % 3)))
    out += [(500 + i, out[i][1], out[i][2]) for i in range(30)]
    out += [(600 + i, out[7][1], out[7][2]) for i in range(40)]
    out += [(700, None, 1), (701, np.zeros(16), 1), (702, [float("nan")] * 16, 1), (703, [None] * 16, 1), (704, out[0][1], None), (705, [float("inf"), *([0.0] * 15)], 0), (706, out[0][1] * 5, 0), (720, [1.0, 2.0], 0), (740, [2.0, 4.0], 0)]
    return out


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def naive_links(rows):
    good = [(i, np.float32(v).astype(float), l) for i, v, l in rows if usable(v) and l is not None and i is not None]
    near = {i: set() for i, _, _ in good}
    for a, (i, x, l) in enumerate(good):
        for j, y, m in good[a + 1 :]:
            if l == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                near[i].add(j)
                near[j].add(i)
    out = {}
    for i, _, _ in rows:
        reach, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        out[i] = (len(near.get(i, ())), min(reach))
    return out


@pytest.mark.parametrize("leaf,block", [(1024, 4096), (60, 40)])
def test_forest_links(spark, rows, leaf, block):
    got = forest.near_duplicates(table(spark, rows), leaf=leaf, block=block).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == naive_links(rows) and len(got) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_forest_null_keys_and_empty(spark, rows):
    got = forest.near_duplicates(table(spark, [*rows[:5], (None, rows[0][1], 0), (2, rows[2][1], 2)])).collect()
    assert len(got) == 7 and [(r.n_links, r.component_id) for r in got if r.vec_id is None] == [(0, None)]
    assert all(r.n_links >= 1 for r in got if r.vec_id == 2)
    assert forest.near_duplicates(table(spark, [])).count() == 0


def test_nearest_is_exact_here(spark, rows):
    df = table(spark, rows)
    got = {}
    for r in onebit.nearest(df, df.where("vec_id % 20 = 0"), block=150, query_block=9).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = {i: np.float32(v).astype(float) for i, v, _ in rows if usable(v)}
    want = {}
    for q in [i for i in good if i % 20 == 0]:
        scored = sorted((-onebit.exact(good[q], v[None])[0], i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:20]
        want[q] = [(n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    assert {q: sorted(v) for q, v in got.items()} == want
    assert onebit.nearest(table(spark, []), table(spark, [])).count() == 0


def test_error_bounds_hold():
    rng = np.random.default_rng(8)
    x, q = rng.normal(size=(4000, 64)) + 0.3, rng.normal(size=(50, 64))
    turn, centre = onebit.rotation(64), x.mean(axis=0)
    estimate, error = onebit.bounds(q, *onebit.encode(x, centre, turn), centre, turn, 3.5)
    off = np.abs(estimate - q @ x.T)
    assert np.mean(off > error) < 1e-3 and np.mean(error) < 40
