"""Every registered query of the reference operators against its SQL."""

from __future__ import annotations

import os

import duckdb
import pytest

from candela import queries as R

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows, names):
    """Rows by sorted column name, floats rounded, in a fixed order."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple("" if r[i] is None else f"{r[i]:.7g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(R.queries()))
def test_query(spark, duck, name):
    df = R.queries()[name](spark, SF)
    rows = plain(df.collect(), df.columns)
    if name not in R.oracle_sql():
        assert rows
        return
    rel = duck.sql(R.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    want = plain([tuple(float(x) if type(x).__name__ == "Decimal" else x for x in r) for r in rel.fetchall()], rel.columns)
    assert rows == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
