"""What is left of a batch is settled in one task, with the same result as in rounds."""

import numpy as np
import pytest

from vellum.operators import signature as S


def _chain(n: int) -> list[tuple[int, list[int]]]:
    """Each similar to the next alone."""
    return [(i, list(range(10 * i, 10 * i + 100))) for i in range(n)]


def test_a_chain_does_not_cost_a_round_for_each_pair(spark, monkeypatch):
    df = spark.createDataFrame(_chain(24), "id long, sig array<bigint>")
    cuts, cut = [], S.cut
    monkeypatch.setattr(S, "cut", lambda df: cuts.append(1) or cut(df))
    kept = {r.id for r in S.first_come(df, 0.8).where("kept").collect()}
    assert kept == set(range(0, 24, 2)) and len(cuts) < 20


@pytest.mark.parametrize("together", [0, 700, 1 << 22])
def test_one_task_and_rounds_choose_alike(spark, monkeypatch, together):
    """In rounds alone, in rounds and then one task, and in one task alone; ids that are strings."""
    monkeypatch.setattr(S, "TOGETHER", together)
    rnd, sets = np.random.default_rng(5), []
    for b in range(4):
        base = rnd.integers(1000 * b, 1000 * b + 900, 40)
        sets += [sorted({*base.tolist(), *rnd.integers(-(1 << 62), 1 << 62, rnd.integers(0, 9)).tolist()}) for _ in range(6)]
        sets += [x for _, x in _chain(5)]
    kept = []
    for i, s in enumerate(sets):
        if all(len({*s} & {*sets[k]}) / len({*s} | {*sets[k]}) < 0.8 for k in kept):
            kept.append(i)
    df = spark.createDataFrame([(f"{i:04d}", s[::-1]) for i, s in enumerate(sets)], "id string, sig array<bigint>")
    assert {int(r.id) for r in S.first_come(df, 0.8).where("kept").collect()} == set(kept)
