"""What is cut is taken to be as large as it is, so a join sends no large table to the driver as a small one."""

from pyspark.sql import functions as F

from vellum.plans import composed
from vellum.session import cut


def _guess(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()


def test_rows_made_on_the_way_count(spark, tmp_path):
    spark.range(2000).write.parquet(f"{tmp_path}/x")
    made = spark.read.parquet(f"{tmp_path}/x").select(F.explode(F.sequence(F.col("id") * 100, F.col("id") * 100 + 99)).alias("n"))
    held = cut(made)
    assert _guess(made) < 100_000 and _guess(held) >= 200_000 * 8 and held.count() == 200_000
    assert sorted(r.n for r in held.where("n < 5").collect()) == [0, 1, 2, 3, 4]


def test_a_large_table_is_not_sent_to_the_driver(spark, tmp_path):
    """Records of authors beside each other, under a bound that their customers are below and they are not."""
    spark.range(3000).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        records = cut(composed._records(spark, str(tmp_path)).select("ord"))
        joined = records.join(records.withColumnRenamed("ord", "other"), F.col("ord") == F.col("other"))
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().sparkPlan().toString()
        few = cut(records.where("ord < 100"))
        assert "BroadcastHashJoin" in records.join(few, "ord")._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
