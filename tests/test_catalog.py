"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from plumbline import catalog

from .conftest import DATA

SF = DATA / "sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        at = SF / f"{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{at}{'/*.parquet' if at.is_dir() else ''}')")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted("|".join(f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(SF))
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    cursor = duck.execute(catalog.ORACLE[name])
    assert got == canonical(cursor.fetchall(), [c[0] for c in cursor.description])
