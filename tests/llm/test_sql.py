from __future__ import annotations

import duckdb
import pytest

from scriptorium.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, folder, name):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW extraction_cache AS SELECT * FROM read_parquet('{folder}/extraction_cache.parquet')")
    theirs = connection.execute(catalog.ORACLES[name]).fetchall()
    ours = catalog.QUERIES[name](spark, folder)
    assert ours.columns == ["cache_id_a", "cache_id_b"]
    assert theirs and sorted(map(tuple, ours.collect())) == sorted(theirs)
