"""Every registered query of the library against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from vellum.plans import catalog

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in sorted(SF.glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(r[i], 9) if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(SF))
    rows = [tuple(r) for r in df.collect()]
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    made = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in made.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(rows, df.columns) == rows_of(made.fetchall(), columns)


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


def test_copies_of_one_signature_are_judged(spark, tmp_path):
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    rows = [(1, text), (2, text + " !!"), (3, text.upper()), (4, text + " " + text), (5, "other " + text[::-1])]
    twice = " ".join([text] * 3)
    rows += [(6, twice)]  # the shingles of 4, and half as many words again
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(tuple, catalog.QUERIES["better_copy_members"](spark, str(tmp_path)).collect()))
    assert found == [(1, 2, True), (1, 3, False), (4, 6, True)]
