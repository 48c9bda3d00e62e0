"""Every query of this part against its SQL, on the smallest tables."""

import os

import pytest

from quire.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "documents conversations lineitem".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert rows or name == "pair_equal"  # no such turns in the smallest tables
    if name in registry.ORACLES:
        duckdb = pytest.importorskip("duckdb")
        with duckdb.connect() as c:
            for t in TABLES:
                c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
            c.execute(registry.ORACLES[name])
            names = [d[0] for d in c.description]
            want = [tuple(plain(r[names.index(k)]) for k in columns) for r in c.fetchall()]
        assert sorted(names) == columns and rows == sorted(want, key=repr)
