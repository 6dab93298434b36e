"""Vector codes against plain loops."""

import math
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import annuli

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows):
    """rows: (vec_id, vector, label). The contract, one part and one entry at a time."""
    good = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    vectors = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in good]
    vectors.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not vectors:
        return []
    width = len(vectors[0][1])
    vectors = [r for r in vectors if len(r[1]) == width]
    step = -(-width // 16)
    parts = [[(v + [0] * 16)[p * step : (p + 1) * step] for p in range(16)] for _, v, _ in vectors]
    books = [[parts[k][p] for k in range(min(64, len(parts)))] for p in range(16)]

    def near(p, q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), k) for k, c in enumerate(books[p]))

    for _ in range(2):
        found = [[near(p, row[p])[1] for p in range(16)] for row in parts]
        for p in range(16):
            for k in range(len(books[p])):
                own = [row[p] for row, f in zip(parts, found, strict=True) if f[p] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [[near(p, row[p]) for p in range(16)] for row in parts]
    errors = [sum(d for d, _ in row) for row in last]
    sums = {}
    for (_, _, label), e in zip(vectors, errors, strict=True):
        sums[label] = sums.get(label, 0) + e
    sha = annuli.digest([np.array(b) for b in books])
    return [(i, "".join(f"{k:02x}" for _, k in row), e, sums[label], sha) for (i, _, label), row, e in zip(vectors, last, errors, strict=True)]


def made(df):
    return sorted(map(tuple, df.collect()), key=str)


def random_rows(n, width=64, seed=1):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 0.2) for _ in range(width)] for _ in range(9)]
    return [(i, [c + rnd.gauss(0, 0.05) for c in centres[i % 9]], i % 4 or None) for i in range(n)]


@pytest.mark.parametrize("rows", [random_rows(300), random_rows(40), random_rows(90, 16) + random_rows(90, 16), random_rows(80, 40), []])
def test_codes_are_those_of_plain_loops(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert made(annuli.summary(df)) == sorted(slow(rows), key=str)


def test_awkward_rows(spark):
    rows = random_rows(100) + [(200, None, 1), (201, [], 1), (202, [None] * 64, 1), (203, [float("nan")] * 64, 2), (204, [float("inf")] + [0.0] * 63, 2), (205, [1.0] * 32, 2)]
    rows += [(None, [0.5] * 64, None), (None, None, None), (3, [0.25] * 64, 5), (7, rows[7][1], 3), (206, [0.0] * 64, 0), (206, [0.0] * 64, 0), (207, [-1e-9] * 64, 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS id", "'x' AS vector", "'x' AS code", "'x' AS error", "'x' AS _label").repartition(3)
    assert made(annuli.summary(df)) == sorted(slow(rows), key=str)
    bad = spark.createDataFrame(rows[100:102], SCHEMA)
    assert annuli.summary(bad).collect() == []
    huge = spark.createDataFrame([(1, [3e38] * 64, 1), (2, [-3e38] * 64, 1)], SCHEMA)
    assert len(annuli.summary(huge).collect()) == 2


@given(st.lists(st.lists(st.integers(-40, 40), min_size=4, max_size=4), min_size=1, max_size=64), st.lists(st.lists(st.integers(-60, 60), min_size=4, max_size=4), min_size=1, max_size=20))
@settings(max_examples=200, deadline=None)
def test_the_annulus_loses_no_entry(entries, parts):
    entries, parts = np.array(entries), np.array(parts)
    index, least, taken = annuli.Codebook(entries).nearest(parts)
    every = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert index.tolist() == every.argmin(1).tolist() and least.tolist() == every.min(1).tolist()
    assert taken <= len(parts) * (len(entries) + 2)


def test_pruning_passes_entries_over(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows, seeds, width = annuli.kept(df)
    coded = annuli.encode(rows, annuli.codebooks(rows, seeds, width), width)
    n, taken = coded.selectExpr("count(*)", "sum(evaluated)").first()
    assert taken < 0.95 * n * annuli.PARTS * annuli.ENTRIES


def test_sql_on_rows_with_nulls_and_repeats(spark, tmp_path):
    rows = random_rows(80) + random_rows(5) + [(300, None, 1), (301, [None] * 64, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert made(annuli.summary(df)) == sorted(con.execute(annuli.oracle_sql()).fetchall(), key=str)
