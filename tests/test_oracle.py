"""Queries and their SQL agree on the smallest tables, where those are at hand."""

from collections import Counter
from pathlib import Path

import pytest

from callweave.plans.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")


def _plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not DATA.is_dir(), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    cursor = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    rows = Counter(tuple(map(_plain, r)) for r in cursor.fetchall())
    assert Counter(tuple(_plain(r[c]) for c in columns) for r in got.collect()) == rows
