"""What the third round's findings named."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import authors as A
from vellum.operators import ingest as ING
from vellum.operators import signature as S
from vellum.plans import catalog, composed


def same_as_sql(spark, name, folder, tables):
    """The rows of a query over tables in a folder, which must be those of its SQL."""
    con = duckdb.connect()
    for table in tables:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    made = catalog.QUERIES[name](spark, str(folder))
    expected = con.sql(f"SELECT {', '.join(made.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    found = [tuple(r) for r in made.collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, expected))
    return found


def records(spark, names):
    return A.keys(spark.createDataFrame([(i, str(i), 1, n) for i, n in enumerate(names)], "ord long, id string, books int, name string"))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("symmetric", [False, True])
def test_near_keys_of_every_length(spark, symmetric):
    rnd = np.random.default_rng(3)
    names = ["".join(rnd.choice(list("abc"), n)) for n in (11, 12, 13, 18, 19, 20, 21, 30, 47, 48, 49, 50, 70) for _ in range(2)]
    for n in list(names):
        for _ in range(6):
            m = n
            for _ in range(rnd.integers(1, 3)):
                i = int(rnd.integers(0, len(m)))
                m = [m[:i] + "x" + m[i:], m[:i] + m[i + 1 :], m[:i] + "y" + m[i + 1 :]][rnd.integers(0, 3)]
            names.append(m)
    names += names[::5]
    rows = records(spark, names)
    held = [(r.ord, r.canon) for r in rows.select("ord", "canon").collect()]
    near = {(a, b) for _, a in held for _, b in held if a != b and len(a) >= 12 and len(b) - len(a) in (0, 1) and edits(a, b) <= (2 if len(a) >= 20 else 1)}
    found = [tuple(r) for r in A.near_keys(rows).collect()]
    assert len(found) == len(set(found)) and set(found) == near and any(len(a) == 19 and len(b) == 20 for a, b in near) and any(len(a) == 48 and len(b) == 49 for a, b in near)
    pairs = [tuple(r) for r in A.typo_pairs(rows, symmetric=symmetric).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(min(x, y), max(x, y)) for x, a in held for y, b in held if (a, b) in near and (y > x or symmetric)}
    ends = [tuple(r) for r in A.typo_edges(rows, symmetric=symmetric).collect()]
    assert len(ends) == len(set(map(frozenset, ends))) if not symmetric else set(map(frozenset, ends)) <= set(map(frozenset, pairs))


def test_keys_that_share_pieces_make_no_more_rows(spark):
    """What a key sends does not grow with those that have the same name before a number."""
    for n in (100, 400):
        assert A._variants(A._held(records(spark, [f"maria customer {i * 7919:012d}" for i in range(n)]))).count() <= n * 27 * 28 / 2


def test_vetoes_of_large_keys(spark, tmp_path):
    rows = spark.range(15_980, 16_030).select(F.col("id").alias("c_custkey"), F.format_string("Customer#%09d", "id").alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit("X").alias("c_mktsegment"))
    rows.write.parquet(f"{tmp_path}/customer.parquet")
    found = same_as_sql(spark, "author_candidates", tmp_path, ["customer"])
    assert any(r[0] > 160_000 for r in found) and not any(r[0] % 100 == 1 for r in found)


def test_sizes_half_way_between(spark, tmp_path):
    spark.range(1, 5).select((F.col("id") * 262_144).alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    assert ("249.2 MB") in [r[1] for r in same_as_sql(spark, "human_size", tmp_path, ["orders"])]
    made = spark.createDataFrame([(262_144 * 5,), (262_144 * 7,), (1_048_577,)], "n long").select(T.human_size(F.col("n")))
    assert [r[0] for r in made.collect()] == ["1.2 MB", "1.8 MB", "1.0 MB"]


def test_what_comes_after_a_kept_one(spark):
    """Against all pairs taken in order: chains, near copies, equal signatures, and signatures that share nothing."""
    rnd = np.random.default_rng(7)
    sigs = []
    for _ in range(6):
        base = rnd.integers(-(2**62), 2**62, 120)
        sigs.append(base)
        for step in range(8):
            base = base.copy()
            base[rnd.integers(0, 120, 5)] = rnd.integers(-(2**62), 2**62, 5)
            sigs.append(base)
    sigs += sigs[::10] + [rnd.integers(-(2**62), 2**62, 60) for _ in range(5)]
    order = rnd.permutation(len(sigs))
    sets = [(int(i), {int(x) for x in s}) for i, s in zip(order, sigs, strict=True)]
    alike = lambda a, b: len(a & b) / len(a | b)
    kept, expected = [], set()
    for i, s in sorted(sets, key=lambda x: x[0]):
        before = {(i, j, round(alike(s, t), 9)) for j, t in kept if alike(s, t) >= 0.85}
        expected |= before
        if not before:
            kept.append((i, s))
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in sets], "id long, sig array<bigint>")
    assert {(r.a, r.b, round(r.similarity, 9)) for r in S.come_after(rows).collect()} == expected and expected
    assert {r.id for r in S.first_come(rows).where("kept").collect()} == {i for i, _ in kept}


def test_matches_are_found_once_for_two_plans(spark, monkeypatch):
    calls, find = [], ING.matches
    monkeypatch.setattr(ING, "matches", lambda *args, **options: calls.append(1) or find(*args, **options))
    catalog.QUERIES["ingest_formats"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_books_are_dealt_to_all_cores(spark):
    assert composed._books(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
