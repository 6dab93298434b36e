"""Session helpers shared by every operator: shared storage, lineage cuts, shipping of the package."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
#: What one Arrow batch on its way to a Python worker may hold, beside its last row.
ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: To how many partitions `deal` deals rows.
SCAN_PARTITIONS = "spark.vellum.scan.partitions"
#: So many times as large as its compressed checkpoint is a table taken to be: of ids three, of hashes one.
COMPRESSED = 4


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    repo = str(PACKAGE.parent)
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([repo, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config(SCAN_PARTITIONS, str(partitions))
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def deal(df: DataFrame) -> DataFrame:
    """The rows dealt out to as many partitions as the session's setting says, whatever their size; where it is unset a scan's own partitions stay.

    For files of one row group, which one task would read whole, before work that is long for each row. `local_session` sets it.
    """
    n = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(n)) if n else df


def spread(df: DataFrame) -> DataFrame:
    """Short rows dealt out to all cores before work that is long for each row: a table of millions of them may be a file of few row groups."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster: spark.checkpoint.dir. Where that is unset: a temporary folder on one machine, an error on a cluster."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="vellum-checkpoint-"))
        current = context._jsc.sc().getCheckpointDir()
    return folder or current.get()


def cut(df: DataFrame) -> DataFrame:
    """Write a plan's rows to the shared folder and go on from there; a lost executor loses none of them.

    A checkpoint keeps the size that was guessed for its plan from the files that it read, which knows nothing of rows that were
    made on the way; a join would send such a table whole to the driver as a small one. So the plan gets the size of what was written, times COMPRESSED.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    held = df.checkpoint(eager=True)
    plan, jvm = held._jdf.queryExecution().analyzed(), spark._jvm
    size = COMPRESSED * folder_bytes(spark, plan.rdd().getCheckpointFile().get())
    # a range of longs says eight bytes a number
    known, nothing = jvm.scala.Some(spark.range(size // 8 + 1)._jdf.queryExecution().analyzed().stats()), getattr(getattr(jvm.scala, "None$"), "MODULE$")
    sized = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, nothing, spark._jsparkSession, known, nothing)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, sized), spark)


def shared_path(spark: SparkSession, stem: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    """A path of any store that Spark knows, and the store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete what a step left in the shared folder, once nothing reads it any more."""
    place, store = _place(spark, path)
    store.delete(place, True)


def folder_bytes(spark: SparkSession, path: str) -> int:
    """The size of all files below a folder; 0 where there is none."""
    place, store = _place(spark, path)
    return store.getContentSummary(place).getLength() if store.exists(place) else 0


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and renamed onto it, so that readers see the old one or the new one."""
    place, store = _place(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = store.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, place, options)


def read_small(spark: SparkSession, path: str) -> str | None:
    """What a small file holds; None where there is no such file."""
    place, store = _place(spark, path)
    if not store.exists(place) or store.getFileStatus(place).isDirectory():
        return None
    opened = store.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(opened)).decode()
    finally:
        opened.close()


def publish(spark: SparkSession, data: bytes, suffix: str) -> tuple[str, str]:
    """Serve bytes to every executor, present and future; the file's name, made from them, and where the driver has it."""
    context = spark.sparkContext
    name = f"vellum-{hashlib.sha256(data).hexdigest()[:24]}{suffix}"
    if name not in (known := context.__dict__.setdefault("_vellum_files", set())):
        place, store = _place(spark, f"{checkpoint_dir(spark).rstrip('/')}/vellum-files/{name}")
        out = store.create(place, True)
        out.write(bytearray(data))
        out.close()
        context.addFile(place.toString())
        known.add(name)
    return name, SparkFiles.get(name)


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, wherever they run, once for each application; and bound what one Arrow batch holds.

    Texts differ in length by orders of magnitude, so batches are bounded by bytes: a smaller bound of the session stays.
    """
    bound = spark.conf.get(ARROW_BYTES)
    if not bound.rstrip("b").isdigit() or int(bound.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_vellum_shipped", False):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, str(path.relative_to(PACKAGE.parent)))
    target = f"{shared_path(spark, 'vellum-ship')}/vellum_package.zip"
    place, store = _place(spark, target)
    out = store.create(place, True)
    out.write(bytearray(buffer.getvalue()))
    out.close()
    context.addPyFile(target)
    context._vellum_shipped = True
