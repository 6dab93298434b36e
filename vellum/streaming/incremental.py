"""The index kept up to date by a stream of scanned files: a log of runs by bucket, and genre counts kept by differences.

A path's hash names its bucket. An epoch writes a run of entries into the folders of the buckets that it touches, a
deletion as an entry that says so, and reads those buckets alone to find what is stale. A bucket of more than
MERGE_AFTER runs is merged into one, without the others. A small file names the runs that count, by bucket, and is
moved into its place last, so a failure leaves the index that was, and repeating an epoch changes nothing.

Beside the entries each epoch writes by how much it changes the number of books of each genre: what it put counts up,
what it replaced or deleted counts down. The sums of these differences are the counts of the whole index.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.operators import index as I
from vellum.session import cut, drop_path, read_small, write_small

#: Runs of a bucket, and epochs of differences, that are read together before they are merged into one.
MERGE_AFTER = 16
BUCKETS = 64
TYPES = dict(c.split(" ") for c in I.ENTRY.split(", "))
COLUMNS = list(TYPES)
RUN = f"{I.ENTRY}, epoch long, deleted boolean"
DELTA = "genre string, delta long"


def _state(spark: SparkSession, path: str) -> dict:
    """epoch: the last; buckets: how many there are; runs: the parts of each bucket; counts: the parts of differences; gone: what nobody needs any more."""
    return json.loads(read_small(spark, f"{path}/current") or json.dumps({"epoch": -1, "buckets": BUCKETS, "runs": {}, "counts": [], "gone": []}))


def _rows(spark: SparkSession, path: str, state: dict, buckets: list[str]) -> DataFrame:
    """The entries of these buckets that count: the latest of each path, if it is no deletion. No other bucket's folder is opened."""
    folders = [f"{path}/{part}/bucket={b}" for b in buckets for part in state["runs"].get(b, [])]
    if not folders:
        return spark.createDataFrame([], RUN)
    rows = spark.read.schema(RUN).parquet(*folders)
    latest = rows.groupBy("path").agg(F.max_by(F.struct(*rows.columns), "epoch").alias("r")).select("r.*")
    return latest.where("NOT deleted")


def _write(rows: DataFrame, path: str, part: str, buckets: int) -> list[str]:
    """Write a run sorted by path within each bucket; the buckets that it has."""
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int"))
    placed.repartition("bucket").sortWithinPartitions("bucket", "path").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{part}")
    spark = rows.sparkSession
    held = spark.read.schema(f"{RUN}, bucket int").parquet(f"{path}/{part}")
    return sorted(str(r[0]) for r in held.select("bucket").distinct().collect())


def _tags(rows: DataFrame, sign: int) -> DataFrame:
    return rows.select(F.explode("tags").alias("genre"), F.lit(sign).cast("long").alias("delta"))


def upsert(batch: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], epoch: int, merge_after: int | None = None) -> None:
    """Appends the entries of a batch's stale rows, and deletions; repeating a batch changes nothing.

    batch: (path, size, mod_time, ...), and where paths can vanish a boolean `deleted`. A path may come twice in a
    batch: its latest scan counts, a deletion before a scan of the same time. compute: stale rows to entries.
    """
    spark, merge_after = batch.sparkSession, MERGE_AFTER if merge_after is None else merge_after
    state = _state(spark, path)
    if epoch <= state["epoch"]:
        return
    if "deleted" not in batch.columns:
        batch = batch.withColumn("deleted", F.lit(False))
    latest = batch.groupBy("path").agg(F.max_by(F.struct(*batch.columns), F.struct("mod_time", ~F.coalesce("deleted", F.lit(False)))).alias("r")).select("r.*")
    latest = cut(latest.withColumn("deleted", F.coalesce("deleted", F.lit(False))))
    touched = sorted(str(r[0]) for r in latest.select(F.pmod(F.xxhash64("path"), F.lit(state["buckets"])).cast("int")).distinct().collect())
    held = cut(_rows(spark, path, state, touched).select("path", "size", "mod_time", "tags"))
    fresh = compute(I.stale(latest.where("NOT deleted").drop("deleted"), held.select("path", "size", "mod_time"))).select(COLUMNS)
    dead = held.join(latest.where("deleted").select("path"), "path", "left_semi").select("path")
    dead = dead.select(*(F.col("path") if c == "path" else F.lit(None).cast(TYPES[c]).alias(c) for c in COLUMNS))
    run = fresh.withColumn("deleted", F.lit(False)).unionByName(dead.withColumn("deleted", F.lit(True))).withColumn("epoch", F.lit(epoch).cast("long"))
    part = f"epoch-{epoch}"
    for bucket in _write(run, path, part, state["buckets"]):
        state["runs"].setdefault(bucket, []).append(part)
    written = spark.read.schema(RUN).parquet(f"{path}/{part}")
    replaced = held.join(written.select("path"), "path", "left_semi")
    delta = _tags(written.where("NOT deleted"), 1).unionByName(_tags(replaced, -1)).groupBy("genre").agg(F.sum("delta").alias("delta")).where("delta <> 0")
    delta.write.mode("overwrite").parquet(f"{path}/counts-{epoch}")
    state["counts"].append(f"counts-{epoch}")
    drop, before = set(state["gone"]), _folders(state)
    _merge(spark, path, state, epoch, merge_after)
    state |= {"epoch": epoch, "gone": sorted(before - _folders(state))}
    write_small(spark, f"{path}/current", json.dumps(state))
    for old in drop:  # nobody has read them since the state before this one
        drop_path(spark, f"{path}/{old}")
    for part in {f.split("/")[0] for f in drop} - {f.split("/")[0] for f in [*_folders(state), *state["gone"]]}:
        drop_path(spark, f"{path}/{part}")


def _folders(state: dict) -> set[str]:
    """The folders that count."""
    return {f"{part}/bucket={b}" for b, parts in state["runs"].items() for part in parts} | set(state["counts"])


def _merge(spark: SparkSession, path: str, state: dict, epoch: int, merge_after: int) -> None:
    """Buckets with too many runs get one; deletions end there. So do the differences."""
    full = sorted(b for b, parts in state["runs"].items() if len(parts) > merge_after)
    if full:
        merged = f"merged-{epoch}"
        having = set(_write(_rows(spark, path, state, full), path, merged, state["buckets"]))
        for b in full:
            state["runs"][b] = [merged] if b in having else []
    if len(state["counts"]) > merge_after:
        _counts(spark, path, state).write.mode("overwrite").parquet(f"{path}/counts-merged-{epoch}")
        state["counts"] = [f"counts-merged-{epoch}"]


def _counts(spark: SparkSession, path: str, state: dict) -> DataFrame:
    if not state["counts"]:
        return spark.createDataFrame([], DELTA)
    rows = spark.read.schema(DELTA).parquet(*(f"{path}/{p}" for p in state["counts"]))
    return rows.groupBy("genre").agg(F.sum("delta").alias("delta")).where("delta <> 0")


def vanish(spark: SparkSession, path: str, scan: DataFrame) -> DataFrame:
    """A batch of deletions: the index's paths that a whole scan (path) no longer has."""
    gone = current(spark, path).join(scan.select("path"), "path", "left_anti")
    return gone.select("path", "size", "mod_time", F.lit(True).alias("deleted"))


def start(scans: DataFrame, path: str, checkpoint: str, compute: Callable[[DataFrame], DataFrame], once: bool = True) -> StreamingQuery:
    """scans: a stream of (path, size, mod_time, ...) rows."""
    writer = scans.writeStream.foreachBatch(lambda batch, epoch: upsert(batch, path, compute, epoch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The entries of the whole index."""
    state = _state(spark, path)
    return _rows(spark, path, state, sorted(state["runs"])).select(COLUMNS)


def genre_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(genre, freq) of the whole index, from the differences alone."""
    return _counts(spark, path, _state(spark, path)).select("genre", F.col("delta").alias("freq"))
