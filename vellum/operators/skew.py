"""Joins whose hot keys are dealt out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 8


def salted_join(rows: DataFrame, single: DataFrame, keys: list[str], salt_of: list[str | Column], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """rows joined with a table that has each key once at most.

    A key's rows are dealt to `salts` tasks by a hash of `salt_of`, which tells them apart, and its one row goes to
    each of these tasks; adaptive execution splits further what is still too much for one.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*salt_of), F.lit(salts)).cast("int"))
    copied = single.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")
