"""Consecutive numbers over a whole table, without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.session import cut


def numbered(df: DataFrame, column: str, name: str = "number") -> DataFrame:
    """df with the place of each row, from 0, in the order of a column; equal values in any order.

    Rows are dealt out by ranges and sorted within them; a range starts where the counts of those before it end.
    The counts, a row for each partition, are all that comes together.
    """
    held = cut(df.repartitionByRange(column).sortWithinPartitions(column))
    held = held.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    counts = sorted((r["_part"], r["n"]) for r in held.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts, before = [], 0
    for part, n in counts:
        starts.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _before long")
    return held.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")
