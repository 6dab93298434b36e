"""Book file names: parsing, composing and placing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T

# The patterns of file names, from the most specific on.
JUNK = r"(?iu)\s*\((?:oficial|dig|digital|rev|revisado)\)\s*"
SITE = rf"(?iu)\s*[\(\[][^)\]]*{T.START}[a-z0-9-]+\.(?:com|net|org|sk|to|se|ru|io|me|info|xyz|cc|is|st){T.END}[^)\]]*[\)\]]"
KNOWN_SITE = r"(?iu)\s*[\(\[]\s*(?:z-?library|zlib|libgen|library genesis|anna'?s archive|epub ?reader|le livros|lelivros|book ?zz|b-ok)\s*[\)\]]"
COPY = r"\s*\((\d+)\)\s*\z"
BRACKET = r"\A\[\s*(.+?)\s*(\d{1,3})\s*\]\s*(.*)\z"
BRACKET_ALONE = r"\A\[\s*([^\]]+?)\s*\]\s*(.*)\z"
PAREN = r"\A\(\s*(.+?)\s*#?\s*(\d{1,3})\s*\)\s*(.*)\z"
NUMBERED = r"\A(\d{1,2}(?:\.\d)?)\.\s+(.*)\z"
VOLUME_TAIL = r"(?iu)\s*[-–]?\s*vol(?:ume)?\.?\s*\z"
SERIES_VOLUME = r"(?iu)\A(.*?)\s*[-–]\s*(.+?)\s*[-–]?\s*Vol\.?\s*(\d{1,3})\s*\z"
VOLUME = r"(?iu)\A(.*?)\s*[-–]\s*Vol\.?\s*(\d{1,3})\s*\z"
SERIES_NUMBER = r"\A(.*?[^\d\s])\s+(\d{1,3})\s*[-–]\s*(.+)\z"


def parse_filename(stem: Column, with_author: bool = True) -> Column:
    """struct of title, author, series, index, duplicate mark and numeric prefix, from a file name without its extension."""

    def tidy(s: Column) -> Column:
        s = F.regexp_replace(F.regexp_replace(s, COPY, ""), SITE, " ")
        return T.collapse(F.regexp_replace(F.regexp_replace(s, KNOWN_SITE, " "), JUNK, " "))

    def part(s: Column, pattern: str, group: int) -> Column:
        return F.regexp_extract(s, pattern, group)

    def split_author(s: Column) -> Column:
        tail = F.substring_index(s, " - ", -1)
        head = F.substring(s, F.lit(1), F.length(s) - F.length(tail) - 3)
        found = F.lit(with_author) & F.contains(s, F.lit(" - ")) & (head != "") & T.looks_like_author(T.strip(tail))
        return F.struct(F.when(found, T.strip(head)).otherwise(s).alias("rest"), F.when(found, T.strip(tail)).otherwise("").alias("author"))

    def shaped(rest: Column) -> Column:
        def form(series: Column | str, number: Column | None, title: Column, prefix: Column | str = "") -> Column:
            series = F.lit(series) if isinstance(series, str) else T.clean(series)
            index = F.coalesce(number.cast("double"), F.lit(0.0)) if number is not None else F.lit(0.0)
            prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
            return F.struct(series.alias("series"), index.alias("idx"), F.lit(number is not None).alias("has_idx"), prefix.alias("prefix"), title.alias("title"))

        is_ = lambda pattern: F.rlike(rest, F.lit(pattern))
        alone = F.when(part(rest, BRACKET_ALONE, 2) != "", form(part(rest, BRACKET_ALONE, 1), None, part(rest, BRACKET_ALONE, 2))).otherwise(form("", None, rest))
        return (
            F.when(is_(BRACKET), form(part(rest, BRACKET, 1), part(rest, BRACKET, 2), part(rest, BRACKET, 3)))
            .when(is_(PAREN), form(part(rest, PAREN, 1), part(rest, PAREN, 2), part(rest, PAREN, 3)))
            .when(is_(BRACKET_ALONE), alone)
            .when(is_(SERIES_VOLUME), form(part(rest, SERIES_VOLUME, 2), part(rest, SERIES_VOLUME, 3), part(rest, SERIES_VOLUME, 1)))
            .when(is_(VOLUME), form("", part(rest, VOLUME, 2), part(rest, VOLUME, 1)))
            .when(is_(SERIES_NUMBER), form(part(rest, SERIES_NUMBER, 1), part(rest, SERIES_NUMBER, 2), part(rest, SERIES_NUMBER, 3)))
            .when(is_(NUMBERED), form("", part(rest, NUMBERED, 1), part(rest, NUMBERED, 2), part(rest, NUMBERED, 1)))
            .otherwise(form("", None, rest))
        )

    def whole(a: Column) -> Column:
        return T.bind(
            shaped(a["rest"]),
            lambda p: F.struct(
                T.clean(p["title"]).alias("title"), a["author"].alias("author"), F.regexp_replace(p["series"], VOLUME_TAIL, "").alias("series"),
                p["idx"].alias("idx"), p["has_idx"].alias("has_idx"), F.rlike(stem, F.lit(COPY)).alias("dup"), p["prefix"].alias("prefix"),
            ),
        )

    return T.bind(tidy(stem), lambda s: T.bind(split_author(s), whole))


def parse_title(s: Column) -> Column:
    """The same for an inner title, which has no author."""
    return parse_filename(s, with_author=False)


def unshout(title: Column) -> Column:
    return T.bind(title, lambda t: F.when(T.is_shouty(t), T.title_case_pt(t)).otherwise(t))


def new_filename(book: Column) -> Column:
    """`Series NN - Title - Author.epub`, as far as the parsed parts go."""
    title = unshout(book["title"])
    series = F.when((book["series"] != "") & book["has_idx"], F.concat(book["series"], F.lit(" "), T.format_index(book["idx"]))).when(book["series"] != "", book["series"])
    title = F.when((book["series"] == "") & (book["prefix"] != ""), F.concat(book["prefix"], F.lit(". "), title)).otherwise(title)
    author = F.when(book["author"] != "", book["author"])
    return F.concat(T.sanitize(F.concat(F.concat_ws(" - ", series, title, author), F.when(book["dup"], F.lit(" (1)")).otherwise(""))), F.lit(".epub"))


# ---- metadata and placement ----
# meta: struct<title, author, author_sort, series, series_index double, tags, isbn, publisher, has_desc>.


def desired_meta(book: Column, meta: Column) -> Column:
    """struct<title, author, author_sort, series, series_index>: what a book's metadata should say."""
    inner = T.bind(parse_title(_first_set(meta["title"], book["title"])), lambda p: p["title"])
    title = T.restore_colon(_first_set(inner, book["title"]))
    fresh = (meta["series"] == "") & (book["series"] != "")
    author = F.when(meta["author"] != "", meta["author"]).otherwise(book["author"])
    absent = (meta["author_sort"] == "") | (F.lower(meta["author_sort"]) == "unknown")
    return T.bind(
        title,
        lambda t: F.struct(
            T.collapse(unshout(t)).alias("title"), meta["author"].alias("author"),
            F.when(absent & (author != ""), T.author_file_as(author)).otherwise(meta["author_sort"]).alias("author_sort"),
            F.when(fresh, book["series"]).otherwise(meta["series"]).alias("series"),
            F.when(fresh & book["has_idx"], book["idx"]).otherwise(meta["series_index"]).alias("series_index"),
        ),
    )


def short_number(x: Column) -> Column:
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def meta_args(want: Column, meta: Column) -> Column:
    """The changes as a flat list of flags and values, only for fields that are set and differ."""
    pairs = F.array(
        F.when((want["title"] != "") & (want["title"] != meta["title"]), F.array(F.lit("--title"), want["title"])),
        F.when((want["series"] != "") & (want["series"] != meta["series"]), F.array(F.lit("--series"), want["series"])),
        F.when((want["series_index"] > 0) & (want["series_index"] != meta["series_index"]), F.array(F.lit("--index"), short_number(want["series_index"]))),
        F.when((want["author_sort"] != "") & (want["author_sort"] != meta["author_sort"]), F.array(F.lit("--author-sort"), want["author_sort"])),
    )
    return F.flatten(F.filter(pairs, lambda p: p.isNotNull()))


def _first_set(*columns: Column) -> Column:
    return F.coalesce(*(F.when(c != "", c) for c in columns), F.lit(""))


def _named(folder: Column) -> Column:
    return F.coalesce(F.nullif(folder, F.lit("")), F.lit("_sem-titulo"))


def _by_series(book: Column, want: Column) -> Column:
    return _named(T.safe_dir(_first_set(want["series"], book["series"], want["title"], book["title"])))


def _by_author(book: Column, want: Column) -> Column:
    author = T.author_file_as(_first_set(want["author"], book["author"], F.lit("Autor Desconhecido")))
    title = _first_set(want["title"], book["title"])
    numbered = (want["series"] != "") & (want["series_index"] > 0)
    title = F.when(numbered, T.collapse(F.concat(want["series"], F.lit(" "), T.format_index(want["series_index"]), F.lit(" - "), title))).otherwise(title)
    return _named(T.bind(F.array(T.safe_dir(author), T.safe_dir(title)), lambda parts: F.array_join(F.filter(parts, lambda c: c != ""), "/")))


#: Layouts by name: a function of the parsed name and the desired metadata to a folder, and a description.
TARGETS: dict[str, tuple[Callable[[Column, Column], Column], str]] = {
    "calibre": (_by_author, "Autor/Título, one folder for each book"),
    "grimmory": (_by_series, "a folder for each series, or title; one book per file"),
    "kavita": (_by_series, "a folder for each series, or title; series come from the metadata"),
}


def target(name: str) -> Callable[[Column, Column], Column]:
    try:
        return TARGETS[name.lower()][0]
    except KeyError:
        raise ValueError(f"unknown target {name!r}; there are {', '.join(sorted(TARGETS))}") from None


def place(df: DataFrame, name: str, book: str = "book", meta: str = "meta") -> DataFrame:
    """Adds placement: struct<dir, filename, meta_args>."""
    return place_all(df, [name], book, meta).withColumn("placement", F.get("placements", F.lit(0)).dropFields("target")).drop("placements")


def place_all(df: DataFrame, names: list[str], book: str = "book", meta: str = "meta") -> DataFrame:
    """Adds placements: an array of struct<target, dir, filename, meta_args>. What a book should be is found once, and then a folder for each target."""
    want = T.bind(F.struct(desired_meta(F.col(book), F.col(meta)).alias("want"), new_filename(F.col(book)).alias("filename")), lambda x: x)
    held = df.select("*", F.explode(F.array(want)).alias("_made"))  # a generator, into which nothing that follows is folded
    want = F.col("_made.want")
    args = meta_args(want, F.col(meta))
    dirs = {}  # targets of one layout share its folder
    for n in names:
        dirs.setdefault(target(n), target(n)(F.col(book), want))
    made = [F.struct(F.lit(n).alias("target"), dirs[target(n)].alias("dir"), F.col("_made.filename").alias("filename"), args.alias("meta_args")) for n in names]
    return held.withColumn("placements", F.array(*made)).drop("_made")
