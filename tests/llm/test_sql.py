"""Corpus queries with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from showerlake.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_corpus_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        duck.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got, want = registry.queries()[name](spark, DATA), duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
