"""Every query of the catalogue against its SQL."""

import glob
import os

import duckdb
import pytest

from cohortlake.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    out = [tuple(float(r[i]) + 0.0 if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else r[i] for i in order) for r in rows]
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    got = plain(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalog.oracle_sql():
        assert got
        return
    result = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert got == plain(names, result.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert catalog.flagship(spark, FOLDER).count() > 40
