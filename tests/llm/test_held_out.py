"""Held-out quality of the trained models, and the queries that have SQL, on the given tables."""

import duckdb
import numpy as np
import pytest

from quillstone.llm import queries

SF = "/root/testdata/sf0.01"


def table(name):
    return duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'").df()


def test_language(spark):
    r = queries.op5_langid(spark, SF).toPandas()
    z = r[r.held_out].merge(table("documents"), on="doc_id")
    assert (z.lang_pred == z.lang).mean() >= 0.97


def test_quality(spark):
    r = queries.op8_quality(spark, SF).toPandas()
    z = r[r.held_out].merge(table("labels"), on="doc_id")
    good, bad = z.score[z.quality == 1].to_numpy(), z.score[z.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() >= 0.9
    assert z.predicted[z.quality == 1].mean() >= 0.95


def test_language_model(spark):
    r = queries.op2_lm(spark, SF).toPandas()
    h = r[r.held_out]
    assert h.score.sum() > h.base_score.sum()
    assert np.isfinite(r.score).all()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    show = lambda f: sorted(tuple(map(str, row)) for row in f[sorted(f.columns)].itertuples(index=False, name=None))
    assert show(got) == show(want)
