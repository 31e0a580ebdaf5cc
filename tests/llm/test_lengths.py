"""Vectors of more lengths than forests are fitted for."""

import numpy as np

from cohortlake.llm import forest


def test_many_lengths(spark):
    rng, rows = np.random.default_rng(4), []
    for n in range(1, 81):
        v = rng.normal(size=n + 1)
        rows += [(2 * n, (v * 2).tolist(), 1), (2 * n + 1, v.tolist(), 1)]
    got = forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == 160 and all((r.n_links, r.component_id) == (1, r.vec_id - r.vec_id % 2) for r in got)
