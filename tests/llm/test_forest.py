"""The forest where its trees split, and split again, against all pairs."""

import numpy as np
import pytest

from cohortlake.llm import forest


def all_pairs(x, label, cosine=0.98):
    """Links and the smallest linked row of every row."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    n_links, parent = np.zeros(len(x), np.int64), list(range(len(x)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for at in range(0, len(x), 500):
        i, j = np.nonzero((u[at : at + 500] @ u.T >= cosine) & (label[at : at + 500, None] == label[None]))
        i += at
        np.add.at(n_links, i[i != j], 1)
        for a, b in zip(i[i < j].tolist(), j[i < j].tolist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return n_links, np.array([root(i) for i in range(len(x))])


def vectors(n, dim, seed):
    """Random directions, and for a third of them one to four near ones."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in rng.choice(n, n // 3, replace=False):
        x[rng.integers(0, n, rng.integers(1, 5))] = x[i] + rng.normal(size=dim) * rng.choice([0.05, 0.1, 0.2])
    return x


@pytest.mark.parametrize("n,options", [(50_000, {}), (6_000, {"leaf": 64, "sample": 1000, "block": 128}), (4_000, {"leaf": 16, "sample": 256, "block": 32})])
def test_links_where_trees_split(spark, n, options):
    x, label = vectors(n, 32, n), np.random.default_rng(n).integers(0, 3, n)
    df = spark.createDataFrame([(i, v, int(l)) for i, (v, l) in enumerate(zip(x.tolist(), label, strict=True))], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in forest.near_duplicates(df, **options).collect()}
    n_links, first = all_pairs(x, label)
    found, whole = sum(got[i][0] for i in range(n)), int(n_links.sum())
    print("links", found, "of", whole)
    assert len(got) == n and found >= 0.999 * whole > 0
    assert all(got[i][0] <= n_links[i] for i in range(n))
    assert np.mean([got[i][1] == first[i] for i in range(n)]) >= 0.999


def test_dense_leaf_is_compared_in_blocks(spark):
    rng = np.random.default_rng(5)
    x = np.ones(8) + 0.01 * rng.normal(size=(700, 8))
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = forest.near_duplicates(df, leaf=32, block=64, sample=300).collect()
    assert len(got) == 700 and all((r.n_links, r.component_id) == (699, 0) for r in got)


def test_rare_length(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v, 1) for i, v in enumerate(rng.normal(size=(900, 8)).tolist())] + [(900, [1.0, 2.0, 3.0], 1), (901, [2.0, 4.0, 6.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), leaf=32, sample=100).collect()}
    assert got[900] == (1, 900) and got[901] == (1, 900) and len(got) == 902
