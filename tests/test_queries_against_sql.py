"""Every query that has SQL against DuckDB on the same tables, values and column types."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from quillon.plans import registry

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
RUNS, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    return tuple(map(_plain, value)) if isinstance(value, (list, tuple)) else repr(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf_dir, db, name):
    frame = RUNS[name](spark, sf_dir)
    kinds = {c: k for c, k, *_ in db.execute(f"DESCRIBE {SQL[name]}").fetchall()}
    assert sorted(kinds) == sorted(frame.columns)
    assert {c: TYPES[k] for c, k in frame.dtypes if k in TYPES} == {c: kinds[c] for c, k in frame.dtypes if k in TYPES}
    found = db.execute(SQL[name])
    order = [[c[0] for c in found.description].index(c) for c in sorted(frame.columns)]
    want = Counter(tuple(_plain(r[i]) for i in order) for r in found.fetchall())
    assert Counter(tuple(_plain(r[c]) for c in sorted(frame.columns)) for r in frame.collect()) == want


@pytest.mark.parametrize("name", sorted(set(RUNS) - set(SQL)))
def test_others_give_rows(spark, name):
    """Those without SQL are held against brute force in other modules; here they run on the larger tables."""
    assert RUNS[name](spark, "/root/testdata/sf0.01").count() > 0
