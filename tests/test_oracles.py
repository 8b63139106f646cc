from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from scriptorium.plans import catalog


def rows(frame) -> list:
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or v != v else round(float(v), 9) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(clean, r)) for r in frame.astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck(folder):
    connection = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, folder, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, folder).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry_runs(spark, folder):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
