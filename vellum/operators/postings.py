"""A stored inverted index of signatures, from which a check reads only what its own hashes point at.

Hashes are ordered: those that more than COMMON signatures have, as counted over all of a small library and over drawn
documents of a large one, come last, the others by their value. The first few
of a signature in this order, so many that a similar one must have one of them among its own first, are its
prefix. The index holds three tables: `postings` (h, id, n), the prefixes' hashes in folders by the hash; `entries`
(id, sig) in folders by the id; and `common` (h, f), the frequent hashes with their document frequencies. A look-up
reads `common` whole, of `postings` the folders of its own prefixes, and of `entries` the folders of what it found.

A passage that a third of all signatures share is common, so it is in a prefix only where a signature has next to
nothing else.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.signature import THRESHOLD, common_hashes, first_hashes, near_sizes, verified
from vellum.session import cut, folder_bytes, read_small, write_small

COMMON = 64
BUCKETS = 1024


def _bucket(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def save(sigs: DataFrame, path: str, threshold: float = THRESHOLD, buckets: int = BUCKETS, common: int = COMMON) -> None:
    """Store the index of (id, sig), ids unique; it answers checks at `threshold` or above. The manifest comes last, so a torn save leaves no index."""
    spark = sigs.sparkSession
    sigs = cut(sigs.where(F.size("sig") > 0).select("id", "sig"))
    often = common_hashes(sigs, common)
    often.write.mode("overwrite").parquet(f"{path}/common")
    postings = first_hashes(sigs, often, threshold).withColumn("bucket", _bucket(F.col("h"), buckets))
    postings.repartition("bucket").sortWithinPartitions("bucket", "h", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    entries = sigs.withColumn("bucket", _bucket(F.col("id"), buckets))
    entries.repartition("bucket").sortWithinPartitions("bucket", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/entries")
    kind = sigs.schema["id"].dataType.simpleString()
    write_small(spark, f"{path}/manifest", json.dumps({"threshold": threshold, "buckets": buckets, "id": kind}))


def _manifest(spark: SparkSession, path: str) -> dict:
    held = read_small(spark, f"{path}/manifest")
    if held is None:
        raise FileNotFoundError(f"{path} holds no index")
    return json.loads(held)


def _read(spark: SparkSession, path: str, table: str, schema: str, buckets: list[int]) -> DataFrame:
    """A table's rows in these folders; the others are never opened."""
    return spark.read.schema(f"{schema}, bucket int").parquet(f"{path}/{table}").where(F.col("bucket").isin(buckets))


def _buckets(values: DataFrame, buckets: int) -> list[int]:
    """The folders that these values are in, `buckets` at most."""
    return sorted(r[0] for r in values.select(_bucket(F.col(values.columns[0]), buckets)).distinct().collect())


def look_up(queries: DataFrame, path: str, threshold: float = THRESHOLD, seen: dict | None = None) -> DataFrame:
    """(a, b, shared, similarity): every entry b of the stored index that is similar to query row a (id, sig). seen: gets the folders that were read, by table."""
    spark = queries.sparkSession
    held = _manifest(spark, path)
    if threshold < held["threshold"]:
        raise ValueError(f"the index answers from {held['threshold']} on")
    queries = cut(queries.where(F.size("sig") > 0).select("id", "sig"))
    common = spark.read.schema("h long, f long").parquet(f"{path}/common")
    asked = cut(first_hashes(queries, common, threshold).select("h", F.col("id").alias("a"), F.col("n").alias("na")))
    at = _buckets(asked.select("h"), held["buckets"])
    postings = _read(spark, path, "postings", f"h long, id {held['id']}, n int", at).select("h", F.col("id").alias("b"), F.col("n").alias("nb"))
    found = cut(postings.join(asked, "h").where(near_sizes(threshold)).select("a", "b").distinct())
    of = _buckets(found.select("b"), held["buckets"])
    if seen is not None:
        seen |= {"postings": at, "entries": of}
    entries = _read(spark, path, "entries", f"id {held['id']}, sig array<bigint>", of).select("id", "sig")
    return verified(found, queries, entries, threshold)


def share_read(spark: SparkSession, path: str, seen: dict) -> float:
    """What part of the index's bytes a look-up read, by the folders that it left in `seen`; `common` counts whole."""
    size = {t: folder_bytes(spark, f"{path}/{t}") for t in ("common", "postings", "entries")}
    read = size["common"] + sum(folder_bytes(spark, f"{path}/{t}/bucket={b}") for t, of in seen.items() for b in of)
    return read / max(sum(size.values()), 1)
