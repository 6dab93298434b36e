"""Sinks: statements, logs and action plans as files."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.number import numbered
from vellum.operators.skew import salted_join
from vellum.session import cut, drop_path, read_small, ship, write_small
from vellum.sources.readers import open_store, qualified


def write_sql(statements: DataFrame, path: str) -> None:
    """(step, ord, sql) as a script in ordered parts, inside a transaction.

    Statements are dealt out by ranges and each range writes its part, so none gathers them all. The parts' folder is
    named by a manifest, which is moved into its place last: a torn write leaves the script that was, and the one before
    the last stays for those who still read it.
    """
    spark = statements.sparkSession
    frame = spark.createDataFrame([(-1, "", "START TRANSACTION;"), (9, "", "COMMIT;")], "step int, ord string, sql string")
    old, place = script(spark, path), f"script-{uuid.uuid4().hex}"
    statements.select("step", "ord", "sql").unionByName(frame).orderBy("step", "ord").select("sql").write.text(f"{path}/{place}")
    write_small(spark, f"{path}/manifest", json.dumps({"script": place, "before": old.get("script")}))
    if old.get("before"):
        drop_path(spark, f"{path}/{old['before']}")


def script(spark: SparkSession, path: str) -> dict:
    """What a script's manifest says; nothing where there is none."""
    return json.loads(read_small(spark, f"{path}/manifest") or "{}")


def read_sql(spark: SparkSession, path: str) -> DataFrame:
    """(part, line, sql): the script's statements; in the order of part and line they are the script."""
    rows = spark.read.option("wholetext", True).text(f"{path}/{script(spark, path)['script']}").select(F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias("part"), "value")
    lines = rows.select("part", F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("line", "sql"))
    return lines.where("sql <> ''")


def write_books(books: DataFrame, path: str) -> DataFrame:
    """books (name, opf, pages) as archives below a folder, written by the executors; (name, size) of each.

    A book is written beside its place and moved there, so readers see it whole and a repeated task changes nothing.
    """
    spark = books.sparkSession
    ship(spark)
    root = qualified(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inside, _ = open_store(root)
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for name, opf, pages in zip(names, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    if opf is not None:
                        z.writestr("content.opf", opf)
                    for i, page in enumerate(pages or ()):
                        z.writestr(f"page{i:06}.xhtml", page or "")
                place = f"{inside}/{name}"
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                beside = f"{place.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
                with store.open_output_stream(beside) as out:
                    out.write(buffer.getvalue())
                store.move(beside, place)
                sizes.append(len(buffer.getvalue()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "size"])

    return cut(books.select("name", "opf", "pages").mapInArrow(run, "name string, size long"))


def write_log(rows: DataFrame, path: str) -> None:
    """Tab-separated text; tabs and line breaks inside values become spaces."""
    columns = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]+", " ") for c in rows.columns]
    rows.select(F.concat_ws("\t", *columns).alias("value")).write.mode("overwrite").text(path)


def series_log(members: DataFrame) -> DataFrame:
    return members.select(F.col("name").alias("serie"), F.col("path").alias("arquivo"))


def failures(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("status = 'ERRO'").select(F.col("path").alias("arquivo"), T.last_line(F.coalesce("why", F.lit(""))).alias("motivo"))


def actions(outcomes: DataFrame) -> DataFrame:
    """(action, src, dst, args, reason): what applying an ingest plan would do."""
    args = F.array_join(F.concat("meta_args", "enrich_args"), " ")
    return outcomes.where("action <> 'none'").select("action", F.col("path").alias("src"), F.col("dest").alias("dst"), args.alias("args"), F.coalesce("why", F.lit("")).alias("reason"))


def unique_paths(planned: DataFrame, path: str = "dst") -> DataFrame:
    """Destinations that repeat get ` (n)` before the extension, in order of source.

    All rows are numbered by ranges of destination and source, so one that a third of all go to is in no single task.
    """
    placed = numbered(planned.withColumn("_order", F.struct(path, "src")), "_order", "_number")
    first = placed.where(F.col(path).isNotNull()).groupBy(path).agg(F.min("_number").alias("_first"))
    n = F.col("_number") - F.col("_first")
    renamed = F.concat(F.regexp_replace(F.col(path), r"\.[^./]*\z", ""), F.format_string(" (%d)", n), F.regexp_extract(F.col(path), r"(\.[^./]*)\z", 1))
    found = salted_join(placed, first, [path], ["src"], "left")
    return found.select(*[c for c in planned.columns if c != path], F.when(n > 0, renamed).otherwise(F.col(path)).alias(path))
