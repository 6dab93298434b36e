"""The operators' queries against their SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from tests.test_catalog import rows_of
from vellum.llm import queries, quality_rules


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for path in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    df = queries.QUERIES[name](spark, sf)
    made = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in made.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(made.fetchall(), columns)


def test_quality_rules_on_awkward_rows(spark, awkward, tmp_path):
    awkward.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    df = quality_rules.judge(awkward)
    made = con.execute(quality_rules.oracle_sql())
    columns = [d[0] for d in made.description]
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(made.fetchall(), columns)
