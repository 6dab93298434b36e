"""Queries on names, metadata, labels and authors that are composed from the tables.

The tables hold no book names or catalogues, so inputs are put together from columns of `part` and `customer`, a
form for each remainder of the key; the SQL never takes them apart again, but says what should come out, from the
same columns and the rule that each form is there for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import genres as G
from vellum.functions import metadata as M
from vellum.functions import names as N
from vellum.functions import text as T
from vellum.operators import authors as A
from vellum.operators import edit as ED
from vellum.operators import enrich as E
from vellum.operators import genres as GO
from vellum.operators import index as I
from vellum.operators import ingest as ING
from vellum.operators import series as SE
from vellum.plans import sql as Q
from vellum.plans.registry import query
from vellum.session import read_table, shared_path, spread
from vellum.sources import readers, sinks

AUTHORS = ("Ana Lima", "Rui Matos Neto", "J. R. Rowe", "Machado de Barros", "Lia Sá")
FILE_AS = ("Lima, Ana", "Neto, Rui Matos", "Rowe, J. R.", "de Barros, Machado", "Sá, Lia")
FOLDERS = ("Lima, Ana", "Neto, Rui Matos", "Rowe, J. R", "de Barros, Machado", "Sa, Lia")


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _cap(x: str) -> str:
    return f"upper({x}[1]) || lower({x}[2:])"


#: A book for each part: a title of two words, a series, an author, a volume number.
BOOKS = (
    f"b AS (SELECT p_partkey AS id, array_to_string(list_transform(string_split(p_name, ' '), lambda w: {_cap('w')}), ' ') AS title, {_cap('p_type')} AS series, p_brand AS brand, "
    f"{_list(AUTHORS)}[p_partkey % 5 + 1] AS author, {_list(FILE_AS)}[p_partkey % 5 + 1] AS file_as, {_list(FOLDERS)}[p_partkey % 5 + 1] AS folder, CAST(p_size AS INTEGER) AS n FROM part)"
)


def _books(spark: SparkSession, sf: str, *more: Column) -> DataFrame:
    author = F.get(F.array(*map(F.lit, AUTHORS)), (F.col("p_partkey") % 5).cast("int"))
    rows = spread(read_table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size"))
    return rows.select(
        F.col("p_partkey").alias("id"), F.initcap("p_name").alias("title"), F.initcap(F.lower("p_type")).alias("series"), F.col("p_brand").alias("brand"), author.alias("author"), F.col("p_size").cast("int").alias("n"), *more
    )


def _form(key: str, *forms: str) -> Column:
    """Of the patterns, that of the key's remainder; {x} stands for a column."""

    def filled(pattern: str) -> Column:
        parts = []
        for i, piece in enumerate(pattern.replace("}", "{").split("{")):
            parts.append(F.lit(piece) if i % 2 == 0 else F.upper(piece[1:]) if piece[0] == "^" else F.col(piece).cast("string"))
        return F.concat(*parts)

    out = None
    for i, pattern in enumerate(forms):
        test = F.col(key) % len(forms) == i
        out = F.when(test, filled(pattern)) if out is None else out.when(test, filled(pattern))
    return out


def _joined(values: Column) -> Column:
    return F.coalesce(F.array_join(values, "|"), F.lit(""))


# ---- titles and names ----


@query(
    f"WITH {BOOKS} SELECT id, CASE id % 3 WHEN 0 THEN 'O ' || title || ' de ' || series || ' II: A Arte da ' || series || ' - EUA' WHEN 1 THEN 'A Luta pela ' || title || ' - Da ' || series || ' até o Fim (No ' || title || ')' ELSE 'BRASIL: URSS e EUA; O MIX de ' || title END AS result FROM b"
)
def title_case_pt(spark: SparkSession, sf: str) -> DataFrame:
    """Numerals and acronyms, small words within and at the start of a segment, and a word that looks like a numeral."""
    shouted = _form("id", "O {^title} DE {^series} II: A ARTE DA {^series} - EUA", "A LUTA PELA {^title} - DA {^series} ATÉ O FIM (NO {^title})", "BRASIL: URSS E EUA; O MIX DE {^title}")
    return _books(spark, sf).select("id", N.unshout(shouted).alias("result"))


@query(f"""WITH {BOOKS} SELECT id, CASE id % 3 WHEN 0 THEN title || ': ' || series || '_x' WHEN 1 THEN title || '2:' || chr(9) || series || ' _ x' ELSE '"' || title || '": ' || series || '_' END AS result FROM b""")
def restore_colon(spark: SparkSession, sf: str) -> DataFrame:
    """After letters, numbers and closing marks, before any white space; not after white space, nor at the end."""
    return _books(spark, sf).select("id", T.restore_colon(_form("id", "{title}_ {series}_x", "{title}2_\t{series} _ x", '"{title}"_ {series}_')).alias("result"))


@query(f"WITH {BOOKS} SELECT id, repeat('x', id % 5) || repeat('ção', (200 - id % 5) // 5) || CASE (200 - id % 5) % 5 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 4 THEN 'çã' ELSE 'ç' END AS name FROM (SELECT CAST(id AS INTEGER) AS id FROM b)")
def cut_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of characters of one and two bytes, cut to 200 bytes at a character."""
    return _books(spark, sf).select("id", T.sanitize(F.concat(F.expr("repeat('x', CAST(id % 5 AS INT))"), F.expr("repeat('ção', 90)"))).alias("name"))


@query(
    f"WITH c AS (SELECT c_custkey, c_custkey % 6 AS k, c_name AS last, {_cap('c_mktsegment')} AS first FROM customer) SELECT c_custkey, CASE k WHEN 0 THEN last || ', ' || first WHEN 1 THEN 'de ' || last || ', ' || first "
    "WHEN 2 THEN last || ', ' || first WHEN 3 THEN first WHEN 4 THEN first || ' e ' || last ELSE 'da ' || last || ', ' || first || ' M.' END AS result FROM c"
)
def author_file_as(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("last"), F.initcap(F.lower("c_mktsegment")).alias("first"))
    return rows.select("c_custkey", T.author_file_as(_form("c_custkey", "{first} {last}", "{first} de {last}", "{last}, {first}", "{first}", "{first} e {last}", "{first}  M. da  {last} ")).alias("result"))


_NAMED = f"""WITH {BOOKS}, f AS (SELECT *, id % 11 AS k, lpad(CAST(n AS VARCHAR), 2, '0') AS nn FROM b)
SELECT id, CASE WHEN k = 6 THEN upper(title || ' of the ' || series) ELSE title END AS title, CASE WHEN k = 9 THEN '' ELSE author END AS author,
       CASE WHEN k IN (0, 1, 2, 3, 10) THEN series ELSE '' END AS series, CASE WHEN k IN (0, 1, 2, 3, 4, 8) THEN CAST(n AS DOUBLE) ELSE 0.0 END AS idx, k IN (0, 1, 2, 3, 4, 8) AS has_idx,
       CASE WHEN k IN (0, 1, 2, 3) THEN series || ' ' || nn || ' - ' || title || ' - ' || author WHEN k = 4 THEN CAST(n AS VARCHAR) || '. ' || title || ' - ' || author
            WHEN k = 5 THEN title || ' - ' || author || ' (1)' WHEN k = 6 THEN title || ' of the ' || series || ' - ' || author WHEN k = 9 THEN title
            WHEN k = 10 THEN series || ' - ' || title || ' - ' || author ELSE title || ' - ' || author END || '.epub' AS new_name FROM f"""


@query(_NAMED)
def parse_filename(spark: SparkSession, sf: str) -> DataFrame:
    stem = _form(
        "id", "[{series} {n}]{title} - {author}", "({series} #{n}) {title}(Oficial) - {author}", "{title} - {series} - Vol. {n} - {author}", "{series} {n} - {title} - {author}", "{n}. {title} - {author}",
        "{title} - {author} (1)", "{^title} OF THE {^series} - {author}", "{title} (z-lib.org) - {author}", "{title} - Vol {n} - {author}", "{title}", "[{series}] {title} - {author}",
    )
    rows = _books(spark, sf).select("id", N.parse_filename(stem).alias("b"))
    return rows.select("id", "b.title", "b.author", "b.series", "b.idx", "b.has_idx", N.new_filename(F.col("b")).alias("new_name"))


@query(f"WITH {BOOKS} SELECT id, CASE WHEN id % 4 = 3 THEN title || ' - Edicao ' || CAST(n AS VARCHAR) ELSE title END AS title FROM b")
def parse_title_only(spark: SparkSession, sf: str) -> DataFrame:
    given = _form("id", "{title} - {series} - Vol {n}", "[{series} {n}]{title}", "{title}(Oficial)", "{title} - Edicao {n}")
    return _books(spark, sf).select("id", N.parse_title(given)["title"].alias("title"))


def book_meta(title: Column, author: Column, series: Column, index: Column) -> Column:
    none = F.lit("")
    return F.struct(
        title.alias("title"), author.alias("author"), none.alias("author_sort"), series.alias("series"), index.cast("double").alias("series_index"), F.array().cast("array<string>").alias("tags"),
        none.alias("isbn"), none.alias("publisher"), F.lit(False).alias("has_desc"),
    )


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    """Books of which the even ones have a series, with parsed names and metadata."""
    even = F.col("id") % 2 == 0
    meta = book_meta(F.col("title"), F.col("author"), F.when(even, F.col("series")).otherwise(""), F.when(even, F.col("n")).otherwise(0))
    return _books(spark, sf).select("id", _form("id", "{series} {n} - {title} - {author}", "{title} - {author}").alias("stem"), meta.alias("meta"))


@query(
    f"WITH {BOOKS}, t AS (SELECT *, CASE WHEN id % 2 = 0 THEN series || ' ' || lpad(CAST(n AS VARCHAR), 2, '0') || ' - ' || title ELSE title END AS leaf FROM b) "
    "SELECT id, target, CASE WHEN target = 'calibre' THEN folder || '/' || leaf WHEN id % 2 = 0 THEN series ELSE title END AS dir, leaf || ' - ' || author || '.epub' AS filename FROM t, (VALUES ('calibre'), ('grimmory'), ('kavita')) AS v(target)"
)
def placements(spark: SparkSession, sf: str) -> DataFrame:
    rows = _placed(spark, sf).select("*", F.explode(F.array(N.parse_filename(F.col("stem")))).alias("book"))
    return N.place_all(rows, sorted(N.TARGETS)).select("id", F.explode("placements").alias("p")).select("id", "p.target", "p.dir", "p.filename")


@query(
    f"WITH {BOOKS}, t AS (SELECT *, CASE WHEN id % 2 = 0 THEN series || ' ' || lpad(CAST(n AS VARCHAR), 2, '0') || ' - ' || title ELSE title END AS leaf FROM b) "
    "SELECT name, count(*) AS books, count(DISTINCT CASE WHEN name = 'calibre' THEN folder || '/' || leaf WHEN id % 2 = 0 THEN series ELSE title END) AS folders FROM t, (VALUES ('calibre'), ('grimmory'), ('kavita')) AS v(name) GROUP BY name"
)
def targets(spark: SparkSession, sf: str) -> DataFrame:
    """Every registered target, with the folders that it would make of the books."""
    return placements(spark, sf).groupBy(F.col("target").alias("name")).agg(F.count("*").alias("books"), F.countDistinct("dir").alias("folders"))


@query(f"WITH {BOOKS} SELECT id, '--title|' || title || ' of the ' || series || '|--series|' || series || '|--index|' || CAST(n AS VARCHAR) || '|--author-sort|' || file_as AS args FROM b")
def meta_args(spark: SparkSession, sf: str) -> DataFrame:
    """Shouted titles, and series and sort names that only the file name knows."""
    meta = book_meta(_form("id", "{^title} OF THE {^series}"), F.col("author"), F.lit(""), F.lit(0))
    rows = _books(spark, sf).select("id", N.parse_filename(_form("id", "{series} {n} - {title} - {author}")).alias("book"), meta.alias("meta"))
    return N.place(rows, "kavita").select("id", _joined(F.col("placement.meta_args")).alias("args"))


# ---- package documents and answers ----


@query(
    f"WITH {BOOKS} SELECT id, title || ' & ' || series || ' éé' AS title, author, file_as AS author_sort, CASE WHEN id % 3 > 0 THEN series ELSE '' END AS series, CAST(CASE WHEN id % 3 > 0 THEN n + 0.5 ELSE 0.0 END AS DOUBLE) AS series_index, "
    "series || '|R&B' AS tags, CASE WHEN id % 3 > 0 THEN '978' || lpad(CAST(id AS VARCHAR), 10, '0') ELSE '' END AS isbn, brand AS publisher, id % 3 = 1 AS has_desc FROM b"
)
def opf_fields(spark: SparkSession, sf: str) -> DataFrame:
    file_as = F.get(F.array(*map(F.lit, FILE_AS)), (F.col("id") % 5).cast("int"))
    books = _books(spark, sf).withColumn("file_as", file_as).withColumn("isbn", F.concat(F.lit("978"), F.lpad(F.col("id").cast("string"), 10, "0")))
    who = '<dc:title>{title} &amp; {series} &eacute;&#233;</dc:title><dc:creator opf:role="ill">Pintor</dc:creator><dc:creator opf:role="aut" opf:file-as="{file_as}"> {author}\n</dc:creator>'
    what = "<dc:subject>{series}</dc:subject><dc:subject> </dc:subject><dc:subject>R&amp;B</dc:subject><dc:publisher>{brand}</dc:publisher>"
    more = '<meta name="calibre:series" content="{series}"/><meta name="calibre:series_index" content="{n}.5"/><dc:identifier opf:scheme="ISBN">urn:isbn:{isbn}</dc:identifier>'
    xml = _form("id", who + what + "<dc:description></dc:description>", who + what + more + "<dc:description>x</dc:description>", who + what + more)
    rows = books.select("id", M.opf(xml).alias("m"))
    return rows.select("id", "m.title", "m.author", "m.author_sort", "m.series", "m.series_index", _joined(F.col("m.tags")).alias("tags"), "m.isbn", "m.publisher", "m.has_desc")


@query(
    f"WITH {BOOKS} SELECT id, CASE WHEN id % 3 < 2 THEN title ELSE '' END AS title, CASE WHEN id % 3 < 2 THEN author || '|Rui' ELSE '' END AS authors, CASE WHEN id % 3 = 0 THEN '978' || lpad(CAST(id AS VARCHAR), 10, '0') ELSE '' END AS isbn, "
    "CASE WHEN id % 3 = 0 THEN 'Ficção|Guerra|' || series ELSE '' END AS tags, CASE id % 3 WHEN 0 THEN 'about ' || title WHEN 1 THEN 'Publisher : ' || brand ELSE '' END AS comments FROM b"
)
def enrich_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Whole answers, answers whose empty last field takes the next line, and none."""
    books = _books(spark, sf).withColumn("isbn", F.concat(F.lit("978"), F.lpad(F.col("id").cast("string"), 10, "0")))
    raw = _form(
        "id", "Title : {title}\nAuthor(s) : {author} & Rui\nTags : Fiction, War / Epic, fiction, {series}\nIdentifiers : isbn:{isbn}\nComments : about {title}",
        "Title : {title}\nAuthor(s) : {author} & Rui\nComments :\nPublisher : {brand}", "No results found",
    )
    rows = books.select("id", M.parse_answer(raw, translate=True).alias("a"))
    return rows.select("id", "a.title", _joined(F.col("a.authors")).alias("authors"), "a.isbn", _joined(F.col("a.tags")).alias("tags"), "a.comments")


@query(f"WITH {BOOKS} SELECT id, CASE WHEN id % 6 < 4 THEN title ELSE '' END AS title FROM b")
def simplify_title(spark: SparkSession, sf: str) -> DataFrame:
    return _books(spark, sf).select("id", M.simplify_title(_form("id", "{title} - {series}: x", "{title}: {series}", "{title} – {series}", "{title}_ {series}", "{title}", "abc: {title}")).alias("title"))


def _asked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Books, the answers to a first look-up, and those to a second."""
    books = _books(spark, sf)
    title = _form("id", "{title}", "{title} - {series}", "{title}: {series}", "", "{title}", "{title}")
    full = F.struct(
        title.alias("title"), F.col("author").alias("author"), F.lit("").alias("author_sort"), F.lit("").alias("series"), F.lit(0.0).alias("series_index"), F.array("series").alias("tags"),
        F.when(F.col("id") % 6 == 4, "1").otherwise("").alias("isbn"), F.when(F.col("id") % 6 == 4, "P").otherwise("").alias("publisher"), (F.col("id") % 6 == 4).alias("has_desc"),
    )
    held = books.select(F.col("id").cast("string").alias("path"), N.parse_filename(F.when(F.col("id") % 12 == 3, "").otherwise(F.col("title"))).alias("book"), full.alias("meta"), "id", "brand")
    said = F.when(F.col("id") % 6 == 0, F.concat(F.lit("Title : x\nPublisher : "), "brand")).when(F.col("id") % 12 == 11, "Title : x\nTags : War").otherwise("No results found")
    answers = held.select("path", said.alias("raw"), F.when(F.col("id") % 12 == 5, "a\nno route").alias("error"))
    again = held.where("id % 6 = 1").select("path", F.concat(F.lit("Title : y\nComments : "), "brand").alias("raw"))
    return held, answers, again


@query(f"WITH {BOOKS} SELECT CAST(id AS VARCHAR) AS path, title, author FROM b WHERE id % 6 IN (1, 2)")
def second_questions(spark: SparkSession, sf: str) -> DataFrame:
    """What to look up again, under a simpler title, once the first look-up found nothing."""
    books, answers, _ = _asked(spark, sf)
    return E.second_questions(E.questions(books), answers)


@query(
    f"WITH {BOOKS} SELECT CAST(id AS VARCHAR) AS path, CASE id % 6 WHEN 0 THEN '--publisher|' || brand WHEN 1 THEN '--comments|' || brand ELSE '' END AS args, "
    "CASE WHEN id % 6 = 0 THEN 'completa: publisher' WHEN id % 6 = 1 THEN 'completa: comments' WHEN id % 12 = 3 THEN 'sem título para consultar' WHEN id % 6 = 4 THEN 'nada a completar' "
    "WHEN id % 12 = 5 THEN 'consulta externa: no route' WHEN id % 12 = 11 THEN 'fontes não trouxeram nada novo' ELSE 'não encontrado nas fontes externas' END AS note FROM b"
)
def enrich_notes(spark: SparkSession, sf: str) -> DataFrame:
    return E.enriched(*_asked(spark, sf)).select("path", _joined(F.col("enrich_args")).alias("args"), F.col("enrich_note").alias("note"))


# ---- edits ----


def _distinct_books(spark: SparkSession, sf: str) -> DataFrame:
    """Shelved books by a volume that is theirs alone, so that paths do not meet."""
    meta = book_meta(F.col("title"), F.col("author"), F.col("series"), F.col("n"))
    sort = F.when(F.col("id") % 3 == 1, "").otherwise(F.get(F.array(*map(F.lit, FILE_AS)), (F.col("id") % 5).cast("int")))
    books = _books(spark, sf).withColumn("title", F.concat("title", F.lit(" "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")))
    name = F.concat_ws(" - ", F.format_string("%s %02d", "series", "n"), "title", "author")
    where = F.when(F.col("id") % 3 == 2, F.lit("in")).otherwise(F.col("series"))
    rows = books.select(F.concat(where, F.lit("/"), name, F.lit(".epub")).alias("path"), name.alias("stem"), meta.withField("author_sort", sort).alias("meta"))
    return rows.unionByName(rows)  # each path twice


_DISTINCT = f"{BOOKS}, s AS (SELECT *, series || ' ' || lpad(CAST(n AS VARCHAR), 2, '0') || ' - ' || title || ' ' || translate(CAST(id AS VARCHAR), '0123456789', 'abcdefghij') || ' - ' || author || '.epub' AS name FROM b)"


@query(f"WITH {_DISTINCT} SELECT series || '/' || name AS path FROM s WHERE id % 3 = 1 UNION ALL SELECT 'in/' || name FROM s WHERE id % 3 = 2")
def needs_work(spark: SparkSession, sf: str) -> DataFrame:
    """Books that are misplaced or whose metadata should change, each path once."""
    return ING.needs_work(_distinct_books(spark, sf), relayout=True).select("path")


@query(
    f"WITH {_DISTINCT} SELECT CASE WHEN id % 3 = 2 THEN 'in' ELSE series END || '/' || name AS path, 'gêneros|ISBN|editora|sinopse' AS missing, CASE WHEN id % 3 = 1 THEN '--author-sort|' || file_as ELSE '' END AS args, CASE WHEN id % 3 = 2 THEN series || '/' || name END AS dst FROM s"
)
def edit_plan(spark: SparkSession, sf: str) -> DataFrame:
    found = ING.needs_work(_distinct_books(spark, sf), enrich=True, relayout=True)
    return ING.edit_plan(found, enrich=True, relayout=True).select("path", _joined(F.col("missing")).alias("missing"), _joined(F.col("args")).alias("args"), "dst")


@query(
    f"WITH {_DISTINCT}, r AS (SELECT CASE WHEN id % 3 = 2 THEN 'in' ELSE series END || '/' || name AS path, CASE WHEN id % 3 = 1 THEN '--author-sort|' || file_as ELSE '' END AS args, CASE WHEN id % 3 = 2 THEN series || '/' || name END AS dst FROM s) SELECT * FROM r ORDER BY path LIMIT 12"
)
def edit_preview(spark: SparkSession, sf: str) -> DataFrame:
    """What the report of an edit shows: its first twelve books."""
    planned = ING.edit_plan(ING.needs_work(_distinct_books(spark, sf), enrich=True, relayout=True), enrich=True, relayout=True)
    return ING.preview(planned).select("path", _joined(F.col("args")).alias("args"), "dst")


@query(f"WITH {BOOKS} SELECT CAST(id AS VARCHAR) AS path, title, author FROM b WHERE id % 2 = 1")
def series_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Books that declare no series."""
    return ING.series_inputs(_placed(spark, sf).withColumn("path", F.col("id").cast("string")))


_COPIES = """c AS (SELECT p_partkey AS i, p_partkey * 37 % 1000 AS nw, p_partkey * 91 % 5000 AS nz, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE '' END AS ns, CASE WHEN p_partkey % 8 = 0 THEN p_size ELSE 0 END AS ni,
  p_partkey * 53 % 1000 AS ow, p_partkey * 67 % 5000 AS oz, CASE WHEN p_partkey % 6 = 0 THEN p_type ELSE '' END AS os, CASE WHEN p_partkey % 12 = 0 THEN p_size ELSE 0 END AS oi FROM part),
d AS (SELECT *, nw > 0 AND ow > 0 AND abs(nw - ow) * 100 // greatest(nw, ow, 1) >= 2 AS words, CASE WHEN nz > 1024 THEN printf('%d KB', CAST(round_even(nz / 1024.0, 0) AS BIGINT)) ELSE printf('%d B', nz) END AS nt,
  CASE WHEN oz > 1024 THEN printf('%d KB', CAST(round_even(oz / 1024.0, 0) AS BIGINT)) ELSE printf('%d B', oz) END AS ot FROM c)"""


@query(
    f"WITH {_COPIES} SELECT i, CASE WHEN (ns = '') <> (os = '') THEN ns <> '' WHEN ns <> '' AND (ni > 0) <> (oi > 0) THEN ni > 0 WHEN words THEN nw > ow ELSE nz > oz END AS new_wins, "
    "CASE WHEN ns <> '' AND os = '' THEN 'o novo tem série no metadado' WHEN os <> '' AND ns = '' THEN 'o da biblioteca tem série no metadado' WHEN words AND nw > ow THEN printf('o novo tem mais texto (%d vs %d palavras)', nw, ow) "
    "WHEN words THEN printf('o da biblioteca tem mais texto (%d vs %d palavras)', ow, nw) WHEN nz > oz THEN 'mesmo texto, novo é maior (' || nt || ' vs ' || ot || ')' WHEN nz < oz THEN 'mesmo texto, o da biblioteca é maior (' || ot || ' vs ' || nt || ')' "
    "ELSE 'empate; mantém o da biblioteca' END AS why FROM d"
)
def better_copy_cases(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")

    def copy(words: int, size: int, series: int) -> Column:
        return F.struct(
            (key * words % 1000).cast("int").alias("words"), (key * size % 5000).cast("long").alias("size"), F.when(key % series == 0, F.col("p_type")).otherwise("").alias("series"),
            F.when(key % (2 * series) == 0, F.col("p_size")).otherwise(0).cast("double").alias("idx"),
        )

    rows = read_table(spark, sf, "part").select(key.alias("i"), copy(37, 91, 4).alias("new"), copy(53, 67, 6).alias("old"))
    return rows.select("i", ING.better_copy(F.col("new"), F.col("old")).alias("new_wins"), ING.describe_choice(F.col("new"), F.col("old")).alias("why"))


# ---- labels ----


@query(f"WITH {BOOKS} SELECT id, array_to_string(list_sort(list_distinct(['Ficção', series, title, CASE id % 3 WHEN 0 THEN 'Romance' WHEN 1 THEN 'Ficção Científica' ELSE title || ' ' || upper('iv') END])), '|') AS cleaned FROM b")
def genre_clean_pt(spark: SparkSession, sf: str) -> DataFrame:
    """Hierarchies, synonyms, codes, phrases, spellings and numerals."""
    tags = F.array(_form("id", "fiction / {series}"), F.lower("title"), F.lit("TRV009050"), F.lit("um livro que fala de tudo ao mesmo tempo"), _form("id", "romance", "sci-fi", "{title} iv"), F.lit("Oficial"), F.col("title"))
    return _books(spark, sf).select("id", _joined(G.clean_pt(tags)).alias("cleaned"))


@query(f"WITH {BOOKS} SELECT id, CASE id % 6 WHEN 0 THEN array_to_string(list_sort(['Fantasy', title]), '|') WHEN 2 THEN 'Science Fiction' WHEN 5 THEN title ELSE '' END AS cleaned FROM b")
def genre_clean_en(spark: SparkSession, sf: str) -> DataFrame:
    return _books(spark, sf).select("id", _joined(G.clean_en(F.array(_form("id", "Fantasy; {title}", "{title} (calif.)", "sci-fi", "20th Century", "{title} (imaginary Place)", "{^title}")))).alias("cleaned"))


@query(f"WITH {BOOKS} SELECT id, id % 4 <> 1 AS known FROM b")
def genre_known(spark: SparkSession, sf: str) -> DataFrame:
    return _books(spark, sf).select("id", G.canonical_en(_form("id", "Fiction", "{title}", "Audiobook", "19th century"))["known"].alias("known"))


@query(f"WITH {BOOKS}, f AS (SELECT title, count(*) AS freq FROM b GROUP BY title) SELECT CAST(id AS VARCHAR) AS path, array_to_string(list_sort(CASE WHEN freq >= 30 THEN ['Romance', title] ELSE ['Romance'] END), '|') AS accepted, array_to_string(list_sort(CASE WHEN freq >= 30 THEN [series] ELSE [series, title] END), '|') AS refused FROM b JOIN f USING (title)")
def genre_admit(spark: SparkSession, sf: str) -> DataFrame:
    """Labels that thirty books have as they are written, or that are canonical; the rest is refused."""
    books = _books(spark, sf).select(F.col("id").cast("string").alias("path"), F.array("title", F.lit("romance"), F.upper("series")).alias("tags"))
    return GO.admit(books, I.genre_frequencies(books), 30).select("path", _joined(F.col("accepted")).alias("accepted"), _joined(F.col("refused")).alias("refused"))


def _catalogue(spark: SparkSession, sf: str) -> DataFrame:
    name = _form("id", "{title}", "sci-fi", "{title} {brand}", "Audiobook", "Fantasy; {title}", "{series}", "{^series}")
    return _books(spark, sf).select("id", name.alias("name")).groupBy("name").agg(F.min("id").alias("id"), F.count("*").cast("int").alias("books"))


_PLAN = f"""{BOOKS}, l AS (SELECT id, title, series, id % 7 AS k, CASE id % 7 WHEN 0 THEN title WHEN 1 THEN 'sci-fi' WHEN 2 THEN title || ' ' || brand WHEN 3 THEN 'Audiobook' WHEN 4 THEN 'Fantasy; ' || title WHEN 5 THEN series ELSE upper(series) END AS name FROM b),
c AS (SELECT name, min(id) AS id, CAST(count(*) AS INTEGER) AS books, any_value(k) AS k, any_value(title) AS title, any_value(series) AS series, lower(name) AS low FROM l GROUP BY name),
p AS (SELECT *, k = 0 AND title LIKE 'Cold %' AS person, k IN (0, 2, 4, 5, 6) AND books < 3 AND low <> 'hot rod' AS rare FROM c),
plan AS (SELECT id, books, name, CASE WHEN person OR rare OR k = 3 THEN '' WHEN k = 1 THEN 'Science Fiction' WHEN k = 4 THEN least('Fantasy', title) WHEN k = 6 THEN series
                WHEN k = 2 THEN array_to_string(list_transform(string_split(low, ' '), lambda w: {_cap('w')}), ' ') ELSE name END AS target,
         CASE WHEN person THEN 'nome de autor' WHEN k = 3 THEN 'ruído' WHEN rare THEN 'raro (<3)' WHEN k = 4 THEN 'lista' WHEN k = 1 THEN 'canoniza' ELSE '' END AS reason FROM p)"""


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    people = _books(spark, sf).where(F.startswith("title", F.lit("Cold "))).select(F.upper("title").alias("name")).distinct()
    return GO.plan(_catalogue(spark, sf), people, 3, ["HOT ROD"])


@query(f"WITH {_PLAN} SELECT id, books, name, target, reason FROM plan")
def genre_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf).select("id", "books", "name", "target", "reason")


@query(f"WITH {_PLAN} SELECT target AS genre, CAST(sum(books) AS BIGINT) AS books FROM plan WHERE target <> '' GROUP BY target")
def genre_plan_after(spark: SparkSession, sf: str) -> DataFrame:
    return GO.plan_after(_plan(spark, sf))


@query(f"WITH {_PLAN} SELECT target AS genre, CAST(sum(books) AS BIGINT) AS books FROM plan WHERE target <> '' GROUP BY target ORDER BY books DESC, genre LIMIT 30")
def genre_plan_top(spark: SparkSession, sf: str) -> DataFrame:
    return GO.plan_top(_plan(spark, sf))


@query(f"WITH {_PLAN} SELECT reason, count(*) AS n FROM plan WHERE target = '' GROUP BY reason")
def genre_plan_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return GO.plan_reasons(_plan(spark, sf))


@query(f"WITH {_PLAN} SELECT books, name, target, reason FROM plan WHERE reason <> ''")
def genre_plan_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Every label that changes, as the plan's listing has it."""
    return GO.plan_detail(_plan(spark, sf))


@query(
    f"WITH {_PLAN} SELECT count(*) AS labels, count(DISTINCT CASE WHEN target <> '' THEN target END) AS labels_after, count(*) FILTER (WHERE target = '') AS removed, CAST(coalesce(sum(books) FILTER (WHERE target = ''), 0) AS BIGINT) AS associations_lost, "
    "count(*) FILTER (WHERE target <> '' AND reason <> '') AS canonised, count(*) FILTER (WHERE target <> '' AND reason = '') AS unchanged FROM plan"
)
def genre_plan_summary(spark: SparkSession, sf: str) -> DataFrame:
    return GO.plan_summary(_plan(spark, sf))


@query(f"""WITH {_PLAN}, moved AS (SELECT * FROM plan WHERE target <> '' AND lower(target) <> lower(name)),
gone AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 500 AS batch FROM plan WHERE target = '' OR lower(target) <> lower(name)),
ids AS (SELECT batch, string_agg(CAST(id AS VARCHAR), ', ' ORDER BY id) AS ids FROM gone GROUP BY batch)
SELECT 1 AS step, target AS ord, 'INSERT IGNORE INTO category (name) VALUES (''' || target || ''');' AS sql FROM (SELECT DISTINCT target FROM plan WHERE target <> '')
UNION ALL SELECT 2, CAST(id AS VARCHAR), 'INSERT IGNORE INTO book_metadata_category_mapping (book_id, category_id) SELECT m.book_id, (SELECT id FROM category WHERE name = ''' || target || ''') FROM book_metadata_category_mapping m WHERE m.category_id = ' || CAST(id AS VARCHAR) || ';' FROM moved
UNION ALL SELECT 3, printf('%012d', CAST(batch AS BIGINT)), 'DELETE FROM book_metadata_category_mapping WHERE category_id IN (' || ids || '); DELETE FROM category WHERE id IN (' || ids || ');' FROM ids""")
def genre_plan_sql(spark: SparkSession, sf: str) -> DataFrame:
    return GO.plan_sql(_plan(spark, sf))


# ---- authors ----


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 2 THEN replace(lower(c_name), '#', '') || ' angela' ELSE 'j r r ' || replace(lower(c_name), '#', '') END AS tokens FROM customer")
def author_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "customer")
    return rows.select("c_custkey", F.array_join(A.tokens(_form("c_custkey", "J.R.R. {^c_name}", "JRR   {c_name}", "{c_name}, Ângela")), " ").alias("tokens"))


#: Digits as syllables that differ in every letter, so that different keys are more than a slip apart.
SYLLABLES = ("bap", "ced", "dif", "gog", "huh", "jyj", "krk", "lll", "mhm", "nwn")
_SPELLED = "lpad(CAST(c_custkey AS VARCHAR), 6, '0')"
for _digit, _syllable in enumerate(SYLLABLES):
    _SPELLED = f"replace({_SPELLED}, '{_digit}', '{_syllable}')"


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Authors under one to five spellings: as it should be, shouted, turned round, with a slip, with an initial; and one that is missing."""
    word = F.lpad(F.col("c_custkey").cast("string"), 6, "0")
    for digit, syllable in enumerate(SYLLABLES):
        word = F.replace(word, F.lit(str(digit)), F.lit(syllable))
    key, name = F.col("c_custkey"), F.initcap(word)
    record = lambda n, name, books: F.struct((key * 10 + n).alias("ord"), name.alias("name"), books.cast("int").alias("books"))
    forms = F.array(
        record(1, F.concat(F.lit("Maria "), name), key % 7 + 1),
        F.when(key % 4 > 0, record(2, F.concat(F.lit("MARIA "), F.upper(name)), F.lit(1))),
        F.when(key % 4 > 0, record(3, F.concat(name, F.lit(", Maria")), F.lit(1))),
        F.when(key % 5 == 0, record(4, F.concat(F.lit("Maria "), name, F.lit("x")), F.lit(2))),
        F.when(key % 6 == 0, record(5, F.concat(F.lit("Maria J. "), name), F.lit(1))),
        F.when(key % 9 == 0, record(6, F.lit("Autor Desconhecido"), F.lit(9))),
    )
    rows = spread(read_table(spark, sf, "customer").select("c_custkey")).select(F.explode(F.filter(forms, lambda r: r.isNotNull())).alias("r")).select("r.*")
    return rows.select("ord", F.col("ord").cast("string").alias("id"), "books", "name")


def _author_sql(keep: tuple[str, ...] = ()) -> str:
    first = f"CASE WHEN CAST(ord AS VARCHAR) IN ({', '.join(map(repr, keep)) or 'NULL'}) THEN 0 ELSE 1 END"
    return f"""c AS (SELECT c_custkey AS g, {_cap(f'({_SPELLED})')} AS w FROM customer),
m AS (SELECT g, g * 10 + 1 AS ord, 'Maria ' || w AS name, g % 7 + 1 AS books, 0 AS pen, 2 AS toks, 0 AS rule FROM c
  UNION ALL SELECT g, g * 10 + 2, 'MARIA ' || upper(w), 1, 3, 2, 1 FROM c WHERE g % 4 > 0 UNION ALL SELECT g, g * 10 + 3, w || ', Maria', 1, 4, 2, 2 FROM c WHERE g % 4 > 0
  UNION ALL SELECT g, g * 10 + 4, 'Maria ' || w || 'x', 2, 0, 2, 4 FROM c WHERE g % 5 = 0 UNION ALL SELECT g, g * 10 + 5, 'Maria J. ' || w, 1, 0, 3, 3 FROM c WHERE g % 6 = 0),
o AS (SELECT *, CAST(ord AS VARCHAR) AS id, row_number() OVER (PARTITION BY g ORDER BY {first}, pen, books DESC, toks DESC, name, CAST(ord AS VARCHAR)) AS place FROM m),
r AS (SELECT g, max(CASE WHEN place = 1 THEN id END) AS canonical_id, max(CASE WHEN place = 1 THEN name END) AS canonical_name, string_agg(id, ',' ORDER BY books DESC, name, id) FILTER (WHERE place > 1) AS other_ids,
  string_agg(CASE rule WHEN 1 THEN 'grafia' WHEN 2 THEN 'invertido' WHEN 3 THEN 'iniciais' ELSE 'typo' END, '+' ORDER BY rule) FILTER (WHERE rule > 0) AS rules, CAST(sum(books) AS BIGINT) AS books, count(*) FILTER (WHERE rule = 4) = 0 AS safe, count(*) AS size
  FROM o GROUP BY g HAVING count(*) > 1)"""


_KEEP = ("12", "53", "104")


@query(f"WITH {_author_sql()} SELECT canonical_id, canonical_name, other_ids, rules, books, safe FROM r")
def author_groups(spark: SparkSession, sf: str) -> DataFrame:
    return A.groups(A.resolve(_records(spark, sf))).drop("other_names")


@query(f"WITH {_author_sql()} SELECT CAST(CASE WHEN place = 1 THEN 1 ELSE row_number() OVER (PARTITION BY g ORDER BY place > 1, books DESC, name, id) END AS INTEGER) AS line, CASE WHEN safe THEN ' ' ELSE '?' END AS mark, CASE WHEN place = 1 THEN 'manter' ELSE 'juntar' END AS what, id, CAST(o.books AS INTEGER) AS books, name, rules, r.books AS group_books FROM o JOIN r USING (g)".replace("books DESC, name, id) END", "o.books DESC, name, id) END"))
def author_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report of duplicate authors, line by line."""
    return A.report(A.resolve(_records(spark, sf))).drop("root")


@query(f"WITH {_author_sql(_KEEP)} SELECT canonical_id, canonical_name, other_ids, rules, books, safe FROM r")
def author_groups_keep(spark: SparkSession, sf: str) -> DataFrame:
    """Some records are wanted as canonical whatever their spelling."""
    return A.groups(A.resolve(_records(spark, sf), keep=list(_KEEP))).drop("other_names")


@query(f"WITH {_author_sql()} SELECT count(*) AS groups, CAST(sum(size - 1) AS BIGINT) AS absorbed, count(*) FILTER (WHERE safe) AS safe, count(*) FILTER (WHERE NOT safe) AS review FROM r")
def author_summary(spark: SparkSession, sf: str) -> DataFrame:
    return A.summary(A.groups(A.resolve(_records(spark, sf))))


@query(f"""WITH {_author_sql()}, gone AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 500 AS batch FROM (SELECT unnest(string_split(other_ids, ',')) AS id FROM r)),
lists AS (SELECT batch, string_agg(id, ', ' ORDER BY id) AS list FROM gone GROUP BY batch)
SELECT 1 AS step, canonical_name AS ord, 'UPDATE book_metadata_author_mapping SET author_id = ' || canonical_id || ' WHERE author_id IN (' || replace(other_ids, ',', ', ') || ');' AS sql FROM r
UNION ALL SELECT 2, '', 'DELETE m1 FROM book_metadata_author_mapping m1 JOIN book_metadata_author_mapping m2 ON m1.book_id = m2.book_id AND m1.author_id = m2.author_id AND m1.sort_order > m2.sort_order;' FROM (SELECT 1 FROM r LIMIT 1)
UNION ALL SELECT 3, printf('%012d', CAST(batch AS BIGINT)), 'DELETE FROM author WHERE id IN (' || list || ');' FROM lists""")
def author_merge_sql(spark: SparkSession, sf: str) -> DataFrame:
    return A.merge_sql(A.groups(A.resolve(_records(spark, sf))))


@query(f"WITH {_author_sql()} SELECT ord, 'maria' AS part FROM m WHERE ord % 100 <> 1")
def author_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Records that take part: vetoed and generic ones are left out."""
    records = _records(spark, sf)
    kept = A.keys(records, records.where("ord % 100 = 1"))
    return kept.select("ord", F.lit("maria").alias("part"))


# ---- series ----


def _titled(spark: SparkSession, sf: str, **more: Column) -> DataFrame:
    """Titles with a word of their own and the name of a series, under the brand as author."""
    word = F.lpad(F.col("id").cast("string"), 6, "0")
    for digit, syllable in enumerate(SYLLABLES):
        word = F.replace(word, F.lit(str(digit)), F.lit(syllable))
    title = F.concat(F.lit("The "), F.initcap(word), F.lit(" of "), F.when(F.col("id") % 5 == 0, F.upper("series")).otherwise(F.col("series")))
    books = _books(spark, sf, *(c.alias(name) for name, c in more.items()))
    return books.select(F.col("id").cast("string").alias("path"), title.alias("title"), F.col("brand").alias("author"), *more)


_WORDS = _SPELLED
_PARTS_CLEANED = f"t2 AS (SELECT CAST(p_partkey AS VARCHAR) AS path, {Q.TAGS} AS tags FROM part), c AS (SELECT path, tags, {Q.clean_pt('tags')} AS clean FROM t2), v AS (SELECT genre, count(*) AS freq FROM (SELECT unnest(clean) AS genre FROM c) GROUP BY genre)"
_MEMBERS = f"{BOOKS}, t AS (SELECT *, lower(replace(brand, '#', '')) AS author_key, count(*) OVER (PARTITION BY brand, series) AS score, bool_and(id % 5 = 0) OVER (PARTITION BY brand, series) AS loud FROM b), s AS (SELECT author_key, CASE WHEN loud THEN upper(series) ELSE series END AS name, score, CAST(id AS VARCHAR) AS path, series FROM t WHERE score >= 3)"


@query(f"WITH {_MEMBERS} SELECT author_key, name, score, path FROM s")
def series_detect(spark: SparkSession, sf: str) -> DataFrame:
    return SE.detect(_titled(spark, sf)).select("author_key", "name", "score", "path")


@query(f"WITH {_MEMBERS} SELECT author_key, name, score, count(*) AS members FROM s GROUP BY ALL")
def series_parts(spark: SparkSession, sf: str) -> DataFrame:
    return SE.candidates(SE.detect(_titled(spark, sf)))


@query(f"WITH {_MEMBERS} SELECT author_key, name, score, path FROM s WHERE series NOT IN ('Economy', 'Promo')")
def series_excluded(spark: SparkSession, sf: str) -> DataFrame:
    return SE.detect(_titled(spark, sf), exclude=["ECONOMY", "promo"]).select("author_key", "name", "score", "path")


@query(
    f"WITH {_MEMBERS}, w AS (SELECT s.*, {_cap(f'({_WORDS})')} AS word FROM s, LATERAL (SELECT CAST(path AS BIGINT) AS c_custkey)), n AS (SELECT *, row_number() OVER (PARTITION BY author_key, name ORDER BY path) AS place, count(*) OVER (PARTITION BY author_key, name) AS members FROM w), "
    "u AS (SELECT author_key, name, members, array_to_string(list('The ' || word || ' of ' || CASE WHEN CAST(path AS BIGINT) % 5 = 0 THEN upper(series) ELSE series END ORDER BY place), '|') AS titles FROM n WHERE place <= 4 GROUP BY ALL) "
    "SELECT author_key, name, members, titles, greatest(members - 4, 0) AS more FROM u ORDER BY members DESC, name, author_key LIMIT 25"
)
def series_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report of detected series: the largest with their first titles."""
    return SE.report(SE.detect(_titled(spark, sf))).withColumn("titles", _joined(F.col("titles")))


def _shelved(spark: SparkSession, sf: str) -> DataFrame:
    """The titles of `_titled` as books without a series, under the labels of their parts."""
    # of one read: a join of the table with itself sends a side of it to the driver as long as its file seems small
    rows = _titled(spark, sf, tags=F.concat(F.array("p_type", "p_brand"), F.split("p_name", " ")))
    meta = book_meta(F.col("title"), F.col("author"), F.lit(""), F.lit(0.0)).withField("tags", F.col("tags"))
    return rows.select("path", F.concat_ws(" - ", "title", "author").alias("stem"), meta.alias("meta"))


@query(
    f"WITH {_MEMBERS}, {_PARTS_CLEANED}, k AS (SELECT list(genre) AS names FROM v WHERE freq >= 3), a AS (SELECT path, tags, list_filter(clean, lambda g: list_contains(names, g)) AS after FROM c, k) "
    "SELECT CAST(id AS VARCHAR) AS path, 'import' AS mode, '--tags|' || series AS args FROM t WHERE id % 3 = 2 "
    "UNION ALL SELECT path, 'series', '--series|' || name FROM s UNION ALL SELECT path, 'genres', '--tags|' || array_to_string(after, ',') FROM a WHERE list_sort(tags) <> list_sort(after) UNION ALL SELECT CAST(id AS VARCHAR), 'fields', '--author-sort|' || brand FROM t"
)
def edit_commands(spark: SparkSession, sf: str) -> DataFrame:
    """Four runs of the command over the same books: each does the first thing that it is asked for, however much more it is."""
    books = _shelved(spark, sf)
    number = F.col("path").cast("long") % 3
    same, new = books.where(number == 1).select("path", F.col("meta.tags").alias("tags")), _books(spark, sf).where("id % 3 = 2").select(F.col("id").cast("string").alias("path"), F.array("series").alias("tags"))
    absent = spark.createDataFrame([("nowhere", ["X"])], "path string, tags array<string>")
    requested = same.unionByName(new).unionByName(absent)
    runs = [ED.edit(books, requested=requested, detect_series=True, clean_genres=True, enrich=True), ED.edit(books, detect_series=True, clean_genres=True), ED.edit(books, clean_genres=True, enrich=True), ED.edit(books, enrich=True)]
    every = runs[0]
    for run in runs[1:]:
        every = every.unionByName(run)
    return every.select("path", "mode", _joined(F.col("args")).alias("args"))


# ---- books as files ----

#: A book for each page, below folders that start with an underscore, a dot, or neither; some in another format, some put aside.
_FILED = (
    "b AS (SELECT page_id AS id, page_id % 5 AS k, html, CASE page_id % 5 WHEN 0 THEN 'a/b c' WHEN 1 THEN '_em dia' WHEN 2 THEN 'x/_duplicatas' WHEN 3 THEN '.oculta' ELSE 'é+/%20' END AS folder, "
    "CASE WHEN page_id % 7 = 3 THEN '.mobi' WHEN page_id % 7 = 4 THEN '.EPUB' WHEN page_id % 7 = 5 THEN '.txt' ELSE '.epub' END AS ext, 'p' || page_id AS stem FROM pages)"
)


def _filed(spark: SparkSession, sf: str) -> str:
    """The folder that these books were written to."""
    path = shared_path(spark, "library")
    choice = lambda key, *values: F.get(F.array(*map(F.lit, values)), key.cast("int"))
    folder = choice(F.col("page_id") % 5, "a/b c", "_em dia", "x/_duplicatas", ".oculta", "é+/%20")
    ext = choice(F.col("page_id") % 7, ".epub", ".epub", ".epub", ".mobi", ".EPUB", ".txt", ".epub")
    opf = F.concat(F.lit("<package><dc:title>Livro "), F.col("page_id").cast("string"), F.lit(' &amp; c</dc:title><dc:creator opf:role="aut" opf:file-as="Lima, Ana">Ana Lima</dc:creator></package>'))
    name = F.concat(folder, F.lit("/p"), F.col("page_id").cast("string"), ext)
    sinks.write_books(read_table(spark, sf, "pages").select(name.alias("name"), opf.alias("opf"), F.array("html").alias("pages")), path)
    return path


def _below(path: str) -> Column:
    """A file's path without the folder that it was written to."""
    return F.element_at(F.split("path", path.rstrip("/").rsplit("/", 1)[1] + "/"), -1)


@query(f"WITH {_FILED} SELECT folder || '/' || stem || ext AS path FROM b WHERE k <> 3 AND ext IN ('.epub', '.EPUB')")
def library_walk(spark: SparkSession, sf: str) -> DataFrame:
    """The EPUBs of a library, found by the executors level by level."""
    path = _filed(spark, sf)
    return readers.library(spark, path).select(_below(path).alias("path"))


@query(f"WITH {_FILED} SELECT folder || '/' || stem || ext AS path, stem, lower(ext) AS ext FROM b WHERE k NOT IN (2, 3) AND ext <> '.txt'")
def library_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Books in any known format outside quarantine folders."""
    path = _filed(spark, sf)
    return readers.inputs(spark, path).select(_below(path).alias("path"), "stem", "ext")


@query(f"WITH {_FILED} SELECT id, 'Livro ' || id || ' & c' AS title, 'Ana Lima' AS author, 'Lima, Ana' AS author_sort FROM b WHERE k <> 3 AND ext IN ('.epub', '.EPUB')")
def epub_opf(spark: SparkSession, sf: str) -> DataFrame:
    """Package documents, read without the pages."""
    held = readers.epub_contents(spark, _filed(spark, sf), text=False)
    made = held.select(F.regexp_extract("path", r"p(\d+)\.[^.]*\z", 1).cast("long").alias("id"), M.opf(F.col("opf")).alias("m"))
    return made.select("id", "m.title", "m.author", "m.author_sort")


@query(f"WITH {_FILED} SELECT id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS t FROM b WHERE k <> 3 AND ext IN ('.epub', '.EPUB'))")
def epub_text(spark: SparkSession, sf: str) -> DataFrame:
    """Pages without tags, read without the package documents."""
    held = readers.epub_contents(spark, _filed(spark, sf), opf=False)
    return held.select(F.regexp_extract("path", r"p(\d+)\.[^.]*\z", 1).cast("long").alias("id"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


# ---- lists ----


@query(
    "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE c_custkey % 7 WHEN 0 THEN CAST(c_nationkey AS INTEGER) WHEN 2 THEN 2 ELSE -1 END AS books, CASE c_custkey % 7 WHEN 2 THEN 'A' || chr(9) || c_name WHEN 5 THEN '\"' || c_name || '\" x' ELSE c_name END AS name FROM customer WHERE c_custkey % 7 IN (0, 2, 5)"
)
def catalog_tsv(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with spaces, too few fields, tabs in names, no name, no number, quotes, and headers."""
    line = _form("c_custkey", "{c_custkey}\t {c_nationkey} \t{c_name}\r", "{c_custkey}\t3", "{c_custkey}\t+2\tA\t{c_name} ", "{c_custkey}\t5\tNULL", "{c_custkey}\tx\t{c_name}", '{c_custkey}\t-1\t"{c_name}" x', "id\tbooks\tname")
    return readers.parse_catalog(read_table(spark, sf, "customer").select(line.alias("value")))


def _tags(spark: SparkSession, sf: str) -> DataFrame:
    line = _form("id", "{id}.epub\tTerror, terror , {title}", "{id}.epub\t , ", "{id}.epub", " {id}.epub \t{title}")
    return readers.parse_tags(_books(spark, sf).select(line.alias("value")))


@query(f"WITH {BOOKS} SELECT CAST(id AS VARCHAR) || '.epub' AS path, CASE WHEN id % 4 = 0 THEN array_to_string(list_sort(['Terror', title]), '|') ELSE title END AS tags FROM b WHERE id % 4 IN (0, 3)")
def tags_tsv(spark: SparkSession, sf: str) -> DataFrame:
    return _tags(spark, sf).select("path", _joined(F.col("tags")).alias("tags"))


def _imported(spark: SparkSession, sf: str) -> DataFrame:
    books = _books(spark, sf).withColumn("path", F.col("id").cast("string"))
    now = F.when(F.col("id") % 3 == 1, F.array("series", "title")).otherwise(F.array(F.concat(F.upper("title"), F.lit(" ")), F.lit("Zzz")))
    return ING.import_tags(books.select("path", F.array("title", "series").alias("tags")), books.where("id % 3 > 0").select("path", now.alias("tags")), merge=True)


_STATES = "['absent', 'correct', 'pending']"


@query(f"WITH {BOOKS} SELECT CAST(id AS VARCHAR) AS path, array_to_string(list_sort(CASE WHEN id % 3 = 2 THEN [title, series, 'Zzz'] ELSE [title, series] END), '|') AS tags, {_STATES}[id % 3 + 1] AS state FROM b")
def import_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _imported(spark, sf).select("path", _joined(F.array_sort("tags")).alias("tags"), "state")


@query(f"WITH {BOOKS} SELECT count(*) FILTER (WHERE id % 3 = 1) AS correct, count(*) FILTER (WHERE id % 3 = 0) AS absent, count(*) FILTER (WHERE id % 3 = 2) AS pending FROM b")
def import_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ING.import_summary(_imported(spark, sf))


# ---- pieces of names and texts ----


@query(f"WITH {BOOKS} SELECT id, 'ACAO Sao ' || title AS folded, title || ' x y' || CAST(n AS VARCHAR) AS safe, 'Acoes ' || title || ' ' || CAST(n AS VARCHAR) AS dir FROM b")
def file_names(spark: SparkSession, sf: str) -> DataFrame:
    """Accents of either case, reserved characters and the ends of folder names."""
    books = _books(spark, sf)
    return books.select(
        "id", T.deaccent_any_case(_form("id", "AÇÃO São {title}")).alias("folded"), T.sanitize(_form("id", '{title}:  x* y"{n}?\t')).alias("safe"),
        T.safe_dir(_form("id", "_Ações {title}/ {n}.-_")).alias("dir"),
    )


@query(f"WITH {BOOKS} SELECT id, rtrim(repeat(title || ' ', 30)[1:200]) AS name FROM b")
def long_names(spark: SparkSession, sf: str) -> DataFrame:
    """File names end after 200 bytes, without the space that stands there."""
    return _books(spark, sf).select("id", T.sanitize(F.repeat(F.concat("title", F.lit(" ")), 30)).alias("name"))


@query(
    f"WITH {BOOKS} SELECT id, CASE WHEN id % 4 = 3 THEN 'erro desconhecido' ELSE title END AS last, CAST(id AS VARCHAR) || '|' || CAST(id + 1 AS VARCHAR) || '|x' AS ids, ['viii', 'ci', 'xlvii', 'mix', 'livro'][id % 5 + 1] AS word, id % 5 IN (0, 2, 3) AS roman FROM b"
)
def small_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Last lines of messages, lists of ids, and numerals against words."""
    words = F.get(F.array(*map(F.lit, ("viii", "ci", "xlvii", "mix", "livro"))), (F.col("id") % 5).cast("int"))
    books = _books(spark, sf).withColumn("next", F.col("id") + 1).withColumn("word", words)
    last = T.last_line(_form("id", "{series}\n {title} \n\n", "{title}", "a\n\n{title}\n", " \n\n"))
    return books.select("id", last.alias("last"), _joined(T.id_list(_form("id", " {id}, {next},,{id} ,x"))).alias("ids"), "word", T.is_roman(F.col("word")).alias("roman"))


@query(
    f"WITH {BOOKS} SELECT id, CASE id % 4 WHEN 0 THEN 'gêneros: Romance (descartados: ' || title || ')' WHEN 1 THEN 'gêneros descartados por serem raros/ruído: ' || title WHEN 2 THEN 'gêneros normalizados: Romance, ' || series END AS note FROM b"
)
def genre_notes(spark: SparkSession, sf: str) -> DataFrame:
    """What the genre policy says about accepted and refused labels, beside a book's own."""
    none, some = F.array().cast("array<string>"), F.array(F.lit("Romance"))
    form = F.col("id") % 4
    accepted = F.when(form == 0, some).when(form == 2, F.array(F.lit("Romance"), F.col("series"))).when(form == 3, F.array("title")).otherwise(none)
    refused = F.when(form <= 1, F.array("title")).otherwise(none)
    return _books(spark, sf).select("id", GO.note(accepted, refused, F.array("title")).alias("note"))


# ---- files ----


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(c_nationkey AS INTEGER) AS books, c_name AS name FROM customer")
def catalog_file(spark: SparkSession, sf: str) -> DataFrame:
    """A catalogue written as a list and read again."""
    path = shared_path(spark, "catalogue")
    sinks.write_log(read_table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_name"), path)
    return readers.catalog(spark, path)


@query("SELECT DISTINCT lower(c_mktsegment) AS name FROM customer")
def names_file(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "names")
    sinks.write_log(read_table(spark, sf, "customer").select(F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")).alias("name")), path)
    return readers.names(spark, path)


@query(f"WITH {BOOKS} SELECT CAST(id AS VARCHAR) || '.epub' AS path, array_to_string(list_sort([series, title]), '|') AS tags FROM b")
def tags_file(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "tags")
    sinks.write_log(_books(spark, sf).select(F.concat(F.col("id").cast("string"), F.lit(".epub")).alias("path"), F.concat_ws(", ", "title", F.upper("title"), "series").alias("tags")), path)
    return readers.tags(spark, path).select("path", _joined(F.col("tags")).alias("tags"))


@query(f"WITH {_MEMBERS} SELECT name || chr(9) || path AS line FROM s")
def series_log(spark: SparkSession, sf: str) -> DataFrame:
    """The log of detected series, written and read again."""
    path = shared_path(spark, "series")
    sinks.write_log(sinks.series_log(SE.detect(_titled(spark, sf))), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(f"WITH {_author_sql()}, l AS (SELECT 'UPDATE book_metadata_author_mapping SET author_id = ' || canonical_id || ' WHERE author_id IN (' || replace(other_ids, ',', ', ') || ');' AS line FROM r) SELECT line FROM l UNION ALL SELECT 'START TRANSACTION;' UNION ALL SELECT 'COMMIT;'")
def author_script(spark: SparkSession, sf: str) -> DataFrame:
    """The merge script as a file: its frame and its updates."""
    path = shared_path(spark, "script")
    sinks.write_sql(A.merge_sql(A.groups(A.resolve(_records(spark, sf)))), path)
    return sinks.read_sql(spark, path).select(F.col("sql").alias("line")).where("line NOT LIKE 'DELETE %'")


@query(f"WITH {BOOKS}, p AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY CAST(id AS VARCHAR)) AS turn FROM b) SELECT CAST(id AS VARCHAR) AS src, series || CASE WHEN turn > 1 THEN ' (' || CAST(turn - 1 AS VARCHAR) || ')' ELSE '' END || '.epub' AS dst FROM p")
def unique_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Books that would all go to one path a series."""
    return sinks.unique_paths(_books(spark, sf).select(F.col("id").cast("string").alias("src"), F.concat("series", F.lit(".epub")).alias("dst"))).select("src", "dst")


@query(f"WITH {BOOKS} SELECT CAST(id AS VARCHAR) AS arquivo, CASE WHEN id % 2 = 0 THEN title ELSE 'erro desconhecido' END AS motivo FROM b WHERE id % 3 = 0")
def failures(spark: SparkSession, sf: str) -> DataFrame:
    """The log of failures: the last line of what went wrong."""
    why = F.when(F.col("id") % 2 == 0, F.concat(F.lit("trace\n"), "title", F.lit("\n")))
    return sinks.failures(_books(spark, sf).select(F.col("id").cast("string").alias("path"), F.when(F.col("id") % 3 == 0, "ERRO").otherwise("NOVO").alias("status"), why.alias("why")))
