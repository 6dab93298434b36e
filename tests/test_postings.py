"""The stored inverted index against brute force, and what a check reads of it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import postings as P
from vellum.operators import signature as S


def similar(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def test_a_look_up_loses_no_pair(spark, tmp_path):
    rnd = np.random.default_rng(7)
    common = list(range(1000, 1030))  # a passage that all share
    base = [sorted({*rnd.integers(0, 400, 40).tolist(), *common}) for _ in range(12)]
    sets = [s for b in base for s in (b, b[:-1], b[2:], [*b, 9999 + len(b)])] + [common, common[:-1], [5]]
    df = spark.createDataFrame([(f"p{i}", s) for i, s in enumerate(sets)] + [("none", None), ("empty", [])], "id string, sig array<bigint>")
    P.save(df, f"{tmp_path}/x", threshold=0.6, buckets=16, common=8)
    for threshold in (0.6, 0.85):
        expected = {(f"p{i}", f"p{j}") for i in range(len(sets)) for j in range(len(sets)) if similar(sets[i], sets[j]) >= threshold}
        assert {(r.a, r.b) for r in P.look_up(df, f"{tmp_path}/x", threshold).collect()} == expected
    with pytest.raises(ValueError, match="0.6"):
        P.look_up(df, f"{tmp_path}/x", 0.5)
    with pytest.raises(FileNotFoundError):
        P.look_up(df, f"{tmp_path}/y")


def test_a_check_reads_few_folders(spark, tmp_path):
    df = spark.range(0, 3000).select("id", F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.xxhash64("id", i)).alias("sig"))
    P.save(df, f"{tmp_path}/x", buckets=256)
    seen = {}
    one = df.where("id = 77")
    assert [(r.a, r.b) for r in P.look_up(one, f"{tmp_path}/x", seen=seen).collect()] == [(77, 77)]
    assert len(seen["postings"]) <= 7 and len(seen["entries"]) == 1
    assert P.share_read(spark, f"{tmp_path}/x", seen) < 0.05
    unknown = spark.createDataFrame([(1, list(range(60)))], "id long, sig array<bigint>")
    assert P.look_up(unknown, f"{tmp_path}/x", seen=seen).collect() == [] and seen["entries"] == []


def test_an_empty_index_answers(spark, tmp_path):
    nothing = spark.createDataFrame([], "id long, sig array<bigint>")
    P.save(nothing, f"{tmp_path}/x")
    assert P.look_up(nothing, f"{tmp_path}/x").collect() == []
    assert S.cross_join(nothing, nothing).collect() == []
