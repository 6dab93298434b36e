"""The library index: which entries are stale, updating, pruning, storage."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.session import drop_path, read_small, write_small

FORMAT = 2
ENTRY = "path string, size long, mod_time long, words int, sig array<bigint>, title string, author string, series string, tags array<string>"


def stale(scan: DataFrame, index: DataFrame) -> DataFrame:
    """Scanned rows that are new or whose size or time differs from the index."""
    held = index.select(F.col("path").alias("_p"), F.col("size").alias("_s"), F.col("mod_time").alias("_m"))
    joined = scan.join(held, scan["path"] == held["_p"], "left")
    return joined.where(F.col("_p").isNull() | (F.col("size") != F.col("_s")) | (F.col("mod_time") != F.col("_m"))).select(scan.columns)


def prune(index: DataFrame, scan: DataFrame) -> DataFrame:
    """Without entries whose path is gone."""
    return index.join(scan.select("path"), "path", "left_semi").select(index.columns)


def gone(index: DataFrame, scan: DataFrame) -> DataFrame:
    return index.join(scan.select("path"), "path", "left_anti").select(index.columns)


def put(index: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries replace those of their path."""
    return index.join(entries.select("path"), "path", "left_anti").select(index.columns).unionByName(entries.select(index.columns))


def build(scan: DataFrame, index: DataFrame | None, compute, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """The new index, and a row of how many entries it has, how many were computed and how many pruned.

    compute: stale scanned rows to entries; called with nothing else, so unchanged rows are not read again.
    """
    if index is None or force:
        index = scan.sparkSession.createDataFrame([], ENTRY)
    fresh = compute(stale(scan, index))
    new = put(prune(index, scan), fresh)
    counts = new.agg(F.count("*").alias("total")).crossJoin(fresh.agg(F.count("*").alias("updated"))).crossJoin(gone(index, scan).agg(F.count("*").alias("pruned")))
    return new, counts


def genre_frequencies(index: DataFrame) -> DataFrame:
    """Books by raw tag; a tag that a book repeats counts twice."""
    return index.select(F.explode("tags").alias("genre")).groupBy("genre").agg(F.count("*").alias("freq"))


def save(index: DataFrame, path: str, root: str = "") -> None:
    """Entries in a folder of their own, and a manifest that names it, moved into its place last.

    So a torn save leaves the index that was, and an index can be saved to where it was loaded from. The entries
    before the last stay for those who still read them; older ones go.
    """
    spark = index.sparkSession
    old = _manifest(spark, path)
    place = f"entries-{uuid.uuid4().hex}"
    index.write.parquet(f"{path}/{place}")
    write_small(spark, f"{path}/manifest", json.dumps({"version": FORMAT, "root": root, "updated": int(time.time()), "entries": place, "before": old.get("entries")}))
    if old.get("before"):
        drop_path(spark, f"{path}/{old['before']}")


def _manifest(spark: SparkSession, path: str) -> dict:
    """What the manifest says; nothing if there is none, or it is of another version or no manifest at all."""
    try:
        held = json.loads(read_small(spark, f"{path}/manifest") or "{}")
    except ValueError:
        return {}
    return held if isinstance(held, dict) and held.get("version") == FORMAT else {}


def load(spark: SparkSession, path: str) -> DataFrame:
    """The saved entries; an empty index if there are none, or they are of another version."""
    held = _manifest(spark, path)
    return spark.read.schema(ENTRY).parquet(f"{path}/{held['entries']}") if held else spark.createDataFrame([], ENTRY)
