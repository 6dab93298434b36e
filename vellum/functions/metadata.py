"""Metadata fields out of package documents and out of an outside tool's answers, as Column expressions."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import genres
from vellum.functions import text as T

# The patterns of package documents and of answers.
TITLE = r"(?s)<dc:title[^>]*>(.*?)</dc:title>"
CREATOR = r"(?s)<dc:creator([^>]*)>(.*?)</dc:creator>"
ROLE = r'(?:opf:)?role\s*=\s*"([^"]*)"'
FILE_AS = r'(?:opf:)?file-as\s*=\s*"([^"]*)"'
SUBJECT = r"<dc:subject[^>]*>([^<]+)</dc:subject>"
SERIES = r'<meta\s+name\s*=\s*"calibre:series"\s+content\s*=\s*"([^"]*)"'
SERIES_INDEX = r'<meta\s+name\s*=\s*"calibre:series_index"\s+content\s*=\s*"([^"]*)"'
ISBN = r"(?iu)<dc:identifier[^>]*isbn[^>]*>\s*(?:urn:isbn:)?([0-9Xx]{10,17})"
PUBLISHER = r"<dc:publisher[^>]*>([^<]+)</dc:publisher>"
DESCRIPTION = r"<dc:description[^>]*>\s*[^<\s]"
ANSWER = r"(?m)^([A-Za-z()\s]+?)\s*:\s*(.*)$"
ANSWER_ISBN = r"isbn:([0-9Xx]{10,17})"

ENTITY = r"&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][0-9A-Za-z]*;?)"
#: Names that stand for a character without a semicolon have at most so many letters.
LONGEST_OPEN = 6
#: Names are looked up among those that begin with the same letters: so many.
INITIALS = 1


def _character(code: Column) -> Column:
    """The character of a number; the C1 controls are those of Windows-1252, and what is no character is U+FFFD."""
    c1 = {f"{i:X}": bytes([i]).decode("cp1252", "replace") for i in range(0x80, 0xA0) if bytes([i]).decode("cp1252", "replace") != "\ufffd"}
    sound = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.coalesce(F.try_element_at(T.table(c1), F.hex(code)), F.when(sound, wide), F.lit("\ufffd"))


def unescape(s: Column) -> Column:
    """HTML character references resolved: numbers, and all names that HTML defines, some of which need no semicolon."""
    # a map is searched from its start, so names lie in one by their first letters
    names, unclosed = T.tables(html5, INITIALS), T.table({k: v for k, v in html5.items() if not k.endswith(";")})

    def one(entity: Column) -> Column:
        digits = F.regexp_extract(entity, r"&#[xX]?([0-9a-fA-F]+)", 1)
        number = F.when(F.length(digits) > 8, F.lit(0)).when(F.rlike(entity, F.lit("^&#[xX]")), F.conv(digits, 16, 10).cast("long")).otherwise(F.conv(digits, 10, 10).cast("long"))
        name = F.substring(entity, F.lit(2), F.length(entity))
        # of a name that is not defined whole, the longest beginning that is
        begins = F.transform(F.sequence(F.lit(LONGEST_OPEN), F.lit(2), F.lit(-1)), lambda n: F.struct(F.try_element_at(unclosed, F.substring(name, F.lit(1), n)).alias("c"), n.alias("n")))
        best = F.get(F.filter(begins, lambda x: x["c"].isNotNull() & (x["n"] <= F.length(name))), F.lit(0))
        begun = F.concat(best["c"], F.substring(name, best["n"] + 1, F.length(name)))
        return F.when(digits != "", _character(number)).otherwise(F.coalesce(F.try_element_at(F.try_element_at(names, F.substring(name, 1, INITIALS)), name), begun, entity))

    def whole(s: Column) -> Column:
        found = F.transform(F.regexp_extract_all(s, F.lit(f"({ENTITY})"), F.lit(1)), one)
        joined = F.array_join(F.zip_with(F.split(s, ENTITY, -1), found, lambda text, c: F.concat(text, F.coalesce(c, F.lit("")))), "")
        return F.when(F.contains(s, F.lit("&")), joined).otherwise(s)

    return T.bind(s, whole)


def _field(s: Column, pattern: str, group: int = 1) -> Column:
    return T.collapse(unescape(T.strip(F.regexp_extract(s, pattern, group))))


def opf(xml: Column) -> Column:
    """struct of title, author, author_sort, series, series_index, tags, isbn, publisher, has_desc from a package document."""
    return T.bind(xml, _opf)  # a document may be put together by its query: once, not for each field


def _opf(xml: Column) -> Column:
    found = F.zip_with(
        F.regexp_extract_all(xml, F.lit(CREATOR), F.lit(1)),
        F.regexp_extract_all(xml, F.lit(CREATOR), F.lit(2)),
        lambda attrs, name: F.struct(
            T.collapse(unescape(T.strip(name))).alias("name"),
            F.lower(F.regexp_extract(attrs, ROLE, 1)).alias("role"),
            F.rlike(attrs, F.lit(FILE_AS)).alias("has_sort"),
            T.collapse(unescape(F.regexp_extract(attrs, FILE_AS, 1))).alias("sort"),
        ),
    )

    def author(people: Column) -> Column:
        named = F.filter(people, lambda p: p["name"] != "")
        first, writer = F.get(named, F.lit(0)), F.get(F.filter(named, lambda p: p["role"] == "aut"), F.lit(0))
        chosen = F.coalesce(writer, first)
        # a sort form survives from the first creator where the writer has none
        sort = F.when(chosen["has_sort"], chosen["sort"]).when(first["has_sort"], first["sort"])
        return F.struct(F.coalesce(chosen["name"], F.lit("")).alias("name"), F.coalesce(sort, F.lit("")).alias("sort"))

    tags = F.filter(F.transform(F.regexp_extract_all(xml, F.lit(SUBJECT), F.lit(1)), lambda t: T.collapse(unescape(t))), lambda t: t != "")
    index = F.regexp_extract(xml, SERIES_INDEX, 1)
    return T.bind(
        author(found),
        lambda who: F.struct(
            _field(xml, TITLE).alias("title"), who["name"].alias("author"), who["sort"].alias("author_sort"),
            _field(xml, SERIES).alias("series"),
            F.coalesce(index.try_cast("double"), F.lit(0.0)).alias("series_index"), tags.alias("tags"),
            F.regexp_extract(xml, ISBN, 1).alias("isbn"),
            _field(xml, PUBLISHER).alias("publisher"),
            F.rlike(xml, F.lit(DESCRIPTION)).alias("has_desc"),
        ),
    )


def parse_answer(raw: Column, translate: bool = False) -> Column:
    """struct of what a metadata tool printed as `Field : value` lines; an empty field takes the next line, as its pattern says."""
    pairs = F.zip_with(
        F.regexp_extract_all(raw, F.lit(ANSWER), F.lit(1)),
        F.regexp_extract_all(raw, F.lit(ANSWER), F.lit(2)),
        lambda k, v: F.struct(F.lower(T.strip(k)).alias("k"), T.strip(v).alias("v")),
    )

    def made(p: Column) -> Column:
        def last(prefix: str) -> Column:
            return F.coalesce(F.try_element_at(F.transform(F.filter(p, lambda x: F.startswith(x["k"], F.lit(prefix)) & (x["v"] != "")), lambda x: x["v"]), F.lit(-1)), F.lit(""))

        def listed(value: Column, separator: str) -> Column:
            return F.filter(F.transform(F.split(value, separator), T.strip), lambda x: x != "")

        tags = listed(last("tags"), ",")
        return F.struct(
            last("title").alias("title"), listed(last("author"), "&").alias("authors"), last("publisher").alias("publisher"), last("published").alias("published"),
            F.regexp_extract(last("identifiers"), ANSWER_ISBN, 1).alias("isbn"), (genres.translate_tags(tags) if translate else tags).alias("tags"),
            last("comments").alias("comments"), (last("title") != "").alias("found"),
        )

    return T.bind(pairs, made)


def simplify_title(title: Column) -> Column:
    """The title before its subtitle; empty if no separator stands past the fourth byte."""
    found = F.lit("")
    for separator in ("_ ", " – ", ": ", " - "):
        before = F.substring_index(title, separator, 1)
        found = F.when(F.contains(title, F.lit(separator)) & (F.octet_length(before) > 4), T.strip(before)).otherwise(found)
    return found


def gap_args(answer: Column, meta: Column) -> Column:
    """Flags and values for what the metadata lacks and the answer has."""
    pairs = F.array(
        F.when((F.size(meta["tags"]) == 0) & (F.size(answer["tags"]) > 0), F.array(F.lit("--tags"), F.array_join(answer["tags"], ","))),
        F.when((meta["isbn"] == "") & (answer["isbn"] != ""), F.array(F.lit("--isbn"), answer["isbn"])),
        F.when((meta["publisher"] == "") & (answer["publisher"] != ""), F.array(F.lit("--publisher"), answer["publisher"])),
        F.when(~meta["has_desc"] & (answer["comments"] != ""), F.array(F.lit("--comments"), answer["comments"])),
    )
    return F.flatten(F.filter(pairs, lambda p: p.isNotNull()))


def lacks_metadata(meta: Column) -> Column:
    return (F.size(meta["tags"]) == 0) | (meta["isbn"] == "") | (meta["publisher"] == "") | ~meta["has_desc"]
