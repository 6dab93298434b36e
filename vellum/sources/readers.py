"""Sources: library folders, books, catalogues and lists."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.session import cut, ship

OPF_BYTES = 96 * 1024
PAGE_BYTES = 8 << 20
BOOK_FORMATS = (".epub", ".mobi", ".azw3", ".azw")
#: Files that a batch of a listing holds, and books that a task reads.
LISTED, READ = 8192, 64
TORN = (zipfile.BadZipFile, zlib.error, struct.error, OSError, ValueError, NotImplementedError, RuntimeError, EOFError)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its store, as `file:///books`."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return re.sub(r"^file:/+", "file:///", full)


def open_store(uri: str):
    """The store of a path, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:///"):
        return fs.LocalFileSystem(), uri.removeprefix("file://"), "file://"
    store, inside = fs.FileSystem.from_uri(uri)
    return store, inside, uri[: len(uri) - len(inside)]


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is in folders: (path, folder, size, mod_time), hidden names left out. A folder that has gone meanwhile is empty."""
    from pyarrow import fs

    for batch in batches:
        for uri in batch.column(0).to_pylist():
            store, inside, prefix = open_store(uri)
            found = [x for x in store.get_file_info(fs.FileSelector(inside, allow_not_found=True)) if not x.base_name.startswith(".") and x.type in (fs.FileType.File, fs.FileType.Directory)]
            for at in range(0, len(found), LISTED):
                part = found[at : at + LISTED]
                columns = [[prefix + x.path for x in part], [x.type == fs.FileType.Directory for x in part], [x.size or 0 for x in part], [int((x.mtime_ns or 0) // 10**9) for x in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], ["path", "folder", "size", "mod_time"])


def walk(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, mod_time) of every file below a folder, hidden ones and hidden folders left out.

    Executors list the folders, a level at a time, and what they find stays with them: the driver asks whether there is a
    next level, no more. Stores are those that pyarrow opens; names keep their characters.
    """
    ship(spark)
    level = spark.createDataFrame([(qualified(spark, path),)], "path string")
    files = None
    while True:
        listed = cut(level.mapInArrow(_list_folders, "path string, folder boolean, size long, mod_time long"))
        now = listed.where("NOT folder").drop("folder")
        files = now if files is None else files.unionByName(now)
        level = listed.where("folder").select("path").repartition(spark.sparkContext.defaultParallelism)
        if listed.where("folder").isEmpty():
            return files


def library(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, mod_time) of every EPUB below a folder, hidden ones left out; contents are not read."""
    return walk(spark, path).where(F.endswith(F.lower("path"), F.lit(".epub")))


def inputs(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, mod_time, stem, ext) of books in any known format, outside quarantine folders, in order."""
    rows = walk(spark, path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = rows.withColumn("ext", F.lower(F.regexp_extract(name, r"(\.[^.]*)\z", 1))).withColumn("stem", F.regexp_replace(name, r"\.[^.]*\z", ""))
    return rows.where(F.col("ext").isin(*BOOK_FORMATS) & ~F.contains("path", F.lit("/_duplicatas/"))).orderBy("path")


class _Counted(io.RawIOBase):
    """A file of a store, read where it is asked for; `taken` counts the bytes."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.taken = file, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        return self.file.seek(offset, whence)

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        self.taken += len(data)
        return len(data)


def read_book(file: pa.NativeFile, opf: bool = True, text: bool = True) -> tuple[str | None, str | None, int]:
    """The package document and the pages' words of an archive, and the bytes read: its directory, and of the entries those asked for."""
    held, package, words = _Counted(file), None, None
    try:
        with zipfile.ZipFile(held) as z:
            entries = z.namelist()
            if opf and (name := next((n for n in entries if re.search(r"(?i)\.opf$", n)), None)):
                with z.open(name) as f:
                    package = f.read(OPF_BYTES).decode("utf-8", "replace")
            if text:
                pages = []
                for n in sorted(n for n in entries if re.search(r"(?i)\.(?:x?html?|xhtm)$", n)):
                    with z.open(n) as f:
                        pages.append(re.sub(r"<[^>]*>", " ", f.read(PAGE_BYTES).decode("utf-8", "replace")))
                words = " ".join(pages)
    except TORN:
        package = words = None  # torn, locked or no archive at all
    return package, words, held.taken


def read_books(files: DataFrame, opf: bool = True, text: bool = True) -> DataFrame:
    """files (path) -> (path, opf, text, bytes_read): what is not asked for is null, and its entries are not read."""
    spark = files.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, inside, _ = open_store(uri)
                try:
                    with store.open_input_file(inside) as file:
                        made = read_book(file, opf, text)
                except OSError:  # gone meanwhile
                    made = (None, None, 0)
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([made[0]], pa.string()), pa.array([made[1]], pa.string()), pa.array([made[2]], pa.int64())], ["path", "opf", "text", "bytes_read"])

    tasks = max(spark.sparkContext.defaultParallelism, -(-files.count() // READ))
    return files.select("path").repartition(tasks, "path").mapInArrow(run, "path string, opf string, text string, bytes_read long")


def epub_contents(spark: SparkSession, path: str, opf: bool = True, text: bool = True) -> DataFrame:
    """(path, opf, text, bytes_read): each EPUB's package document, and its pages' words without tags; nulls for files that are no EPUB."""
    return read_books(library(spark, path), opf, text)


def parse_catalog(lines: DataFrame, column: str = "value") -> DataFrame:
    """(id, books, name) from `id<TAB>books<TAB>name` lines; headers, short lines and nameless entries dropped."""
    f = F.split(F.regexp_replace(column, r"\r\z", ""), "\t", -1)
    rows = lines.where(T.strip(F.col(column)) != "").select(f.alias("f")).where("size(f) >= 3")
    books = T.strip(F.get("f", F.lit(1)))
    rows = rows.select(
        T.strip(F.get("f", F.lit(0))).alias("id"), F.when(F.rlike(books, F.lit(r"\A[+-]?[0-9]+\z")), books.try_cast("int")).alias("books"),
        T.strip(F.array_join(F.slice("f", F.lit(3), F.size("f")), "\t")).alias("name"),
    )
    return rows.where(F.col("books").isNotNull() & ~F.col("name").isin("", "NULL"))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    return parse_catalog(spark.read.text(path))


def parse_tags(lines: DataFrame, column: str = "value") -> DataFrame:
    """(path, tags) from `path<TAB>tag, tag` lines; the first spelling of each tag, sorted; lines without tags dropped."""
    parts = F.split(column, "\t", 2)
    tags = F.filter(F.transform(F.split(F.get(parts, F.lit(1)), ","), T.strip), lambda t: t != "")
    rows = lines.where(F.contains(column, F.lit("\t"))).select(T.strip(F.get(parts, F.lit(0))).alias("path"), F.array_sort(T.first_by_lower(tags)).alias("tags"))
    return rows.where((F.size("tags") > 0) & (F.col("path") != ""))


def tags(spark: SparkSession, path: str) -> DataFrame:
    return parse_tags(spark.read.text(path))


def names(spark: SparkSession, path: str) -> DataFrame:
    """(name) of a list, trimmed, in lower case, each once."""
    return spark.read.text(path).select(F.lower(T.strip(F.col("value"))).alias("name")).where("name <> ''").distinct()
