"""Every registered query of the library runs, and equals its SQL where it has one."""

import duckdb
import pytest

from quillstone.plans.registry import FLAGSHIP, ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda x: "NULL" if x is None or x != x else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(show, r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        want = con.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert FLAGSHIP(spark, SF).count() > 0
