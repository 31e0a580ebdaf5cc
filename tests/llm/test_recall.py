"""The one-bit index against exact search, on as many vectors as need cells, chunks and several blocks."""

import numpy as np

from cohortlake.llm import onebit


def exact_top(x, queries, k):
    out = {}
    for q in queries:
        s = np.cumsum(x * x[q], axis=1)[:, -1]
        s[q] = -np.inf
        near = np.argpartition(-s, 2 * k)[: 2 * k]
        out[q] = [(int(i), float(s[i])) for i in near[np.lexsort((near, -s[near]))][:k]]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall_of_50000_vectors(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 32))
    x = np.where(rng.random((50_000, 1)) < 0.5, rng.normal(size=(50_000, 32)), centres[rng.integers(0, 40, 50_000)] + 0.3 * rng.normal(size=(50_000, 32)))
    x[10_000:20_000] = x[9_999]  # copies
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    queries = list(range(0, 50_000, 250))
    got = found(onebit.nearest(df, df.where("vec_id % 250 = 0"), block=8192, query_block=100).collect())
    want = exact_top(x, queries, 20)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in queries)
    print("recall", hits / 20 / len(queries))
    assert hits >= 0.99 * 20 * len(queries)
    scores = {q: dict(want[q]) for q in queries}
    assert all(s == scores[q][i] for q in queries for i, s in got[q] if i in scores[q])


def test_infinite_slack_is_exact(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(6_000, 10)) * 10.0 ** rng.integers(-3, 4, (6_000, 1))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = found(onebit.nearest(df, df.where("vec_id % 100 = 0"), block=500, slack=float("inf"), sample=300).collect())
    assert got == exact_top(x, range(0, 6_000, 100), 20)


def test_bounds_without_slack_always_hold():
    rng = np.random.default_rng(14)
    for dim in (3, 24, 100):
        turn = onebit.rotation(dim, onebit.code_bits(dim, 2))
        x, q = rng.normal(size=(2000, dim)) + 0.5, rng.normal(size=(40, dim))
        estimate, error = onebit.bounds(q, *onebit.encode(x, x.mean(axis=0), turn), x.mean(axis=0), turn, float("inf"))
        assert (np.abs(estimate - q @ x.T) <= error).all()


def test_far_cells_are_not_probed(spark):
    rng = np.random.default_rng(15)
    centres = 10 * np.eye(8)
    x = centres[np.arange(4000) % 8] + 0.1 * rng.normal(size=(4000, 8))
    cells = onebit.Cells(8, centres, np.arange(400), x[:400])
    floors = cells.floors(np.array([0]), x[:1], 5)
    probes = onebit._probes(cells, {c: 1.0 for c in range(8)}, 5)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([x[0].tolist()])], ["vec_id", "embedding"])
    assert next(probes(iter([batch]))).column(4).to_pylist() == [[0]] and floors[0] > 90


def test_huge_and_repeated_keys(spark):
    rows = [(i, [1e200 * (i + 1), -1e199]) for i in range(3)] + [(20, [1e-200, 1e-201])] + [(20, [1e-200, 1e-201])] + [(40, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = onebit.nearest(df, df.where("vec_id % 20 = 0 and vec_id > 0"), k=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(20, 1, 2), (20, 2, 2)]
