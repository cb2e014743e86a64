"""Every registered query of the engine against its SQL."""

import math

import duckdb
import pytest

from quadrille.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else float(f"{v:.12g}") if isinstance(v, float) else v


def test_every_query_has_sql():
    assert set(catalogue.oracle_sql()) == set(catalogue.queries())


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, db, name):
    df = catalogue.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[n]) for n in names]) for r in df.collect())
    found = db.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    want = sorted(repr([plain(r[columns.index(n)]) for n in names]) for r in found.fetchall())
    assert got == want
