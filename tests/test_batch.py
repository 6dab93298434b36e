"""Inputs held against each other: first come, first kept."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import ingest as ING
from vellum.operators import signature as S


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def slow(sets, threshold):
    kept = []
    for i, s in enumerate(sets):
        if all(jaccard(s, sets[k]) < threshold for k in kept):
            kept.append(i)
    return set(kept)


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.85])
def test_first_come_is_the_sequential_choice(spark, threshold):
    rnd = np.random.default_rng(3)
    sets = []
    for b in range(6):
        base = sorted({*rnd.integers(1000 * b, 1000 * b + 900, 50).tolist(), *range(10_000, 10_008)})
        sets += [sorted({*base, *rnd.integers(10**6, 10**7, rnd.integers(0, 12)).tolist()}) for _ in range(8)]
        sets += [base[i : i + 40] + [90_000 + 100 * b + i] for i in range(0, 16, 2)]  # a chain: each is similar to the next alone
    order = rnd.permutation(len(sets))
    sets = [sets[i] for i in order]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id long, sig array<bigint>")
    assert {r.id for r in S.first_come(df, threshold).where("kept").collect()} == slow(sets, threshold)


def test_near_copies_take_one_round_and_linear_rows(spark):
    base, n = list(range(200)), 2000
    df = spark.range(0, n).select("id", F.concat(F.array(*map(F.lit, base)).cast("array<bigint>"), F.array(F.col("id") + 10_000)).alias("sig"))
    assert [r.id for r in S.first_come(df).where("kept").collect()] == [0]


def test_duplicates_of_a_batch_name_the_most_similar_that_stays(spark):
    a, b = list(range(100)), list(range(200, 300))
    sets = {"p1": a, "p2": a[:-1], "p3": b, "p4": [*b[:-1], 999], "p5": None, "p6": []}
    df = spark.createDataFrame(list(sets.items()), "path string, sig array<bigint>")
    assert sorted((r.path, r.duplicate) for r in ING.within_batch(df).collect()) == [("p2", "p1"), ("p4", "p3")]
    assert ING.within_batch(df.limit(0)).collect() == []
