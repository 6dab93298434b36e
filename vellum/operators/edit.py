"""The edit of a library as one plan: imported tags first, then series, then genres, then each book's own fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import genres as GO
from vellum.operators import ingest as ING
from vellum.operators import series as SE

MODES = ("import", "series", "genres", "fields")


def edit(
    books: DataFrame, target: str = "grimmory", requested: DataFrame | None = None, merge: bool = False, detect_series: bool = False, clean_genres: bool = False, enrich: bool = False,
    relayout: bool = False, limit: int = 0, min_genre_freq: int = 3, min_members: int = 3, exclude: list[str] | None = None,
) -> DataFrame:
    """books (path, stem, meta) -> (path, mode, missing, args, dst): what one run of the command would write, look up and move.

    A run does one thing, the first that it is asked for: `requested` tags (path, tags) are written to the books
    that exist and differ; else series are detected and named on their volumes, without a number; else genres are
    cleaned over the whole library, and an emptied list is written as one; else books get the fields that
    `needs_work` finds. Series and genres are over all books, whether or not any lacks a field.
    """
    none = F.array().cast("array<string>")
    made = lambda rows, mode, args: rows.select("path", F.lit(mode).alias("mode"), none.alias("missing"), F.array(*args).alias("args"), F.lit(None).cast("string").alias("dst"))
    if requested is not None:
        held = books.dropDuplicates(["path"]).select("path", F.col("meta.tags").alias("tags"))
        return made(ING.import_tags(requested, held, merge).where("state = 'pending'"), "import", [F.lit("--tags"), F.array_join("tags", ",")])
    if detect_series:
        found = SE.detect(ING.series_inputs(books.dropDuplicates(["path"])), min_members, exclude)
        return made(found, "series", [F.lit("--series"), F.col("name")])
    if clean_genres:
        cleaned = GO.clean_books(books.dropDuplicates(["path"]).select("path", F.col("meta.tags").alias("tags")), min_genre_freq)
        return made(cleaned.where("changed"), "genres", [F.lit("--tags"), F.array_join("after", ",")])
    planned = ING.edit_plan(ING.needs_work(books, target, enrich, relayout, limit), enrich, relayout)
    return planned.select("path", F.lit("fields").alias("mode"), "missing", "args", "dst")


def summary(planned: DataFrame) -> DataFrame:
    """(mode, books, written, moved): how many books a run touches, writes to and moves."""
    return planned.groupBy("mode").agg(F.count("*").alias("books"), F.count_if(F.size("args") > 0).alias("written"), F.count_if(F.col("dst").isNotNull()).alias("moved"))
