"""Only signatures that share one of their first hashes go on to the joins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import postings as P
from vellum.operators import signature as S


def shuffled(spark):
    """Rows that all stages so far have written to shuffles."""
    new = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, new, spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def unrelated(spark, n):
    """n signatures of 100 hashes, each by itself but the last two, which differ in one."""
    sig = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.xxhash64(F.when((F.col("id") == n - 1) & (i > 0), n - 2).otherwise(F.col("id")), i))
    return spark.range(n).select("id", sig.alias("sig"))


@pytest.mark.parametrize("join", [S.self_join, S.linked, lambda d: S.first_come(d).where("NOT kept"), lambda d: S.cross_join(d.where("id % 100 = 0"), d).where("a <> b")])
def test_unrelated_signatures_move_their_first_hashes_alone(spark, monkeypatch, join):
    monkeypatch.setattr(S, "COUNTED", 1 << 13, raising=False)
    n = 2000
    df = unrelated(spark, n)
    before = shuffled(spark)
    assert join(df).count() == (0 if "cross_join" in join.__code__.co_names else 1)
    assert shuffled(spark) - before < 100 * n / 2


def test_an_order_from_few_documents_loses_no_pair(spark, monkeypatch, tmp_path):
    rnd = np.random.default_rng(5)
    passage = list(range(10**6, 10**6 + 30))
    base = [sorted({*rnd.integers(0, 3000, 60).tolist(), *passage}) for _ in range(30)]
    sets = [s for b in base for s in (b, b[:-2], b[3:], [*b, 10**7 + b[0]])] + [passage, passage[1:], [5]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id long, sig array<bigint>")
    similar = lambda a, b: len({*a} & {*b}) / len({*a} | {*b}) >= 0.85
    expected = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if similar(a, b)}
    for counted in (1 << 23, 600):
        monkeypatch.setattr(S, "COUNTED", counted, raising=False)
        assert {(r.a, r.b) for r in S.self_join(df).collect()} == {(a, b) for a, b in expected if a < b}
        assert {(r.a, r.b) for r in S.cross_join(df, df).collect()} == expected
        monkeypatch.setattr(S, "FEW_IDS", 0 if counted == 600 else 200_000, raising=False)
        P.save(df, f"{tmp_path}/{counted}", buckets=4, common=8)
        assert {(r.a, r.b) for r in P.look_up(df, f"{tmp_path}/{counted}").collect()} == expected


def test_words_of_other_letters(spark):
    texts = {"Straße øl-x": "strae l x", "a ж b жж1": "a b 1", "É́tude ² 3³": "e tude 3", "ABC def": "abc def", "": "", "жж": ""}
    rows = spark.createDataFrame(list(texts.items()), "text string, want string").select("want", F.array_join(T.tokens(F.col("text")), " ").alias("got"))
    assert [r.got for r in rows.collect()] == [r.want for r in rows.collect()]
