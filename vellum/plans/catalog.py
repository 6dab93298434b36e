"""Every registered query of the library, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import authors as A
from vellum.operators import genres as GO
from vellum.operators import index as I
from vellum.operators import ingest as ING
from vellum.operators import postings as P
from vellum.operators import series as SE
from vellum.operators import signature as S
from vellum.operators.graph import components
from vellum.operators.skew import salted_join
from vellum.plans import composed  # noqa: F401  (registers its queries)
from vellum.plans import sql as Q
from vellum.plans.registry import ORACLE_SQL, QUERIES, query
from vellum.session import cut, deal, drop_path, read_table, shared_path
from vellum.sources import readers, sinks
from vellum.streaming import incremental

def joined(values: Column, separator: str = "|") -> Column:
    return F.coalesce(F.array_join(values, separator), F.lit(""))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return deal(read_table(spark, sf, "documents"))


# ---- text ----


@query(f"WITH {Q.WORDS} SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words FROM w")
def tok_word_count(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_words"))


@query(f"WITH {Q.WORDS} SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM w) GROUP BY word ORDER BY n DESC, word LIMIT 50")
def tok_top_words(spark: SparkSession, sf: str) -> DataFrame:
    words = _documents(spark, sf).select(F.explode(T.tokens(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(50)


@query("SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS t FROM pages)")
def html_tag_strip(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "pages").select("page_id", T.strip_tags(F.col("html")).alias("t"))
    return rows.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


@query(f"SELECT page_id, {Q.collapse('''regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)''')} AS title FROM pages")
def html_title(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages").select("page_id", T.collapse(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))


@query(f"SELECT doc_id, md5({Q.norm_key('text')}) AS norm_key, md5({Q.collapse('text')}) AS collapsed, md5({Q.deaccent('text')}) AS deaccented FROM documents")
def norm_key_documents(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return _documents(spark, sf).select("doc_id", F.md5(T.norm_key(text)).alias("norm_key"), F.md5(T.collapse(text)).alias("collapsed"), F.md5(T.deaccent(text)).alias("deaccented"))


@query(f"SELECT p_partkey, {Q.norm_key('p_name')} AS norm_key FROM part")
def norm_key_parts(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "part").select("p_partkey", T.norm_key(F.col("p_name")).alias("norm_key"))


@query(
    r"SELECT doc_id, n >= 8 AND u / greatest(n, 1) >= 0.95 AS shouty FROM (SELECT doc_id, len(regexp_extract_all(text, '\p{L}')) AS n, len(regexp_extract_all(text, '\p{Lu}')) AS u FROM documents)"
)
def is_shouty(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", T.is_shouty(F.col("text")).alias("shouty"))


@query(
    "SELECT o_orderkey, CASE WHEN n > 1048576 THEN printf('%.1f MB', n / 1048576.0) WHEN n > 1024 THEN printf('%.0f KB', n / 1024.0) ELSE printf('%d B', n) END AS size FROM (SELECT o_orderkey, o_orderkey * 997 AS n FROM orders)"
)
def human_size(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "orders").select("o_orderkey", T.human_size(F.col("o_orderkey") * 997).alias("size"))


@query("SELECT p_partkey, CASE WHEN x = floor(x) THEN printf('%02d', CAST(x AS BIGINT)) ELSE CAST(x AS VARCHAR) END AS idx, CASE WHEN length(p_name) > 12 THEN p_name[1:12] || '…' ELSE p_name END AS short FROM (SELECT p_partkey, p_name, p_size / CAST(2 AS DOUBLE) AS x FROM part)")
def fmt_index(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "part").select("p_partkey", T.format_index(F.col("p_size") / 2.0).alias("idx"), T.truncate(F.col("p_name"), 12).alias("short"))


# ---- signatures and similarity ----


def _signatures(spark: SparkSession, sf: str) -> DataFrame:
    return S.signatures(_documents(spark, sf))


@query(f"WITH {Q.SHINGLES} SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(coalesce(len(s), -1) AS BIGINT) AS n_shingles FROM x")
def shingle_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _signatures(spark, sf).select(F.col("id").alias("doc_id"), F.col("n_words").cast("long"), F.coalesce(F.size("sig"), F.lit(-1)).cast("long").alias("n_shingles"))


@query(
    f"WITH {Q.SHINGLES}, h AS (SELECT doc_id, n, list_sort(list_filter(list_transform(s, lambda v: md5(v)), lambda v: v[1:2] IN ('00', '80'))) AS h FROM x) SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(coalesce(len(h), -1) AS BIGINT) AS n_sig, md5(coalesce(array_to_string(h, ','), '')) AS digest FROM h"
)
def signature_md5_128(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.sampled_md5(_documents(spark, sf))
    return rows.select(F.col("id").alias("doc_id"), F.col("n_words").cast("long"), F.coalesce(F.size("sig"), F.lit(-1)).cast("long").alias("n_sig"), F.md5(joined(F.col("sig"), ",")).alias("digest"))


#: FNV-1a with 64 bits, byte by byte in whole numbers of 128, of each distinct shingle; those divisible by 128 as signed longs.
_FNV = (
    f"WITH {Q.SHINGLES}, e AS (SELECT doc_id, unnest(s) AS g FROM x WHERE s IS NOT NULL), "
    "h AS (SELECT g, list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(string_split(g, ''), lambda c: CAST(ord(c) AS HUGEINT))), lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616) AS v FROM (SELECT DISTINCT g FROM e)), "
    "k AS (SELECT doc_id, list_sort(list_distinct(list(v))) AS v FROM e JOIN h USING (g) WHERE v % 128 = 0 GROUP BY doc_id) "
    "SELECT x.doc_id, CAST(n AS BIGINT) AS n_words, CAST(CASE WHEN s IS NULL THEN -1 ELSE coalesce(len(v), 0) END AS BIGINT) AS n_sig, "
    "md5(coalesce(array_to_string(list_transform(v, lambda y: CASE WHEN y >= 9223372036854775808 THEN y - 18446744073709551616 ELSE y END), ','), '')) AS digest FROM x LEFT JOIN k USING (doc_id)"
)


@query(_FNV)
def signature_fnv_128(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.sampled_fnv(_documents(spark, sf))
    return rows.select(F.col("id").alias("doc_id"), F.col("n_words").cast("long"), F.coalesce(F.size("sig"), F.lit(-1)).cast("long").alias("n_sig"), F.md5(joined(F.col("sig").cast("array<string>"), ",")).alias("digest"))


@query(f"WITH {Q.PAIRS} SELECT a, b, shared, round(similarity, 6) AS similarity FROM j")
def doc_near_dups(spark: SparkSession, sf: str) -> DataFrame:
    """Similar pairs of distinct signatures, each by its smallest document; `doc_signature_classes` has the members."""
    return S.self_join(S.representatives(_signatures(spark, sf))).select("a", "b", "shared", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {Q.CLASSES} SELECT doc_id, rep FROM c")
def doc_signature_classes(spark: SparkSession, sf: str) -> DataFrame:
    return S.classes(_signatures(spark, sf)).withColumnRenamed("id", "doc_id")


@query(
    f"WITH RECURSIVE {Q.PAIRS}, g AS (SELECT a, b FROM j UNION SELECT b, a FROM j), m(n, root) AS (SELECT id, id FROM r UNION SELECT g.b, m.root FROM m JOIN g ON m.n = g.a), z AS (SELECT n, min(root) AS root FROM m GROUP BY n) SELECT c.doc_id, z.root AS component FROM c JOIN z ON c.rep = z.n"
)
def dup_components(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's class under similarity and its transitive closure, by its smallest document."""
    sigs = cut(_signatures(spark, sf))
    rooted = components(S.linked(S.representatives(sigs)))
    held = S.classes(sigs).join(rooted, F.col("rep") == F.col("node"), "left")
    return held.select(F.col("id").alias("doc_id"), F.coalesce("root", "rep").alias("component"))


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    sigs = cut(_signatures(spark, sf).select("id", "sig"))
    return S.cross_join(sigs.where(F.col("id") % 100 == 0), sigs).where("a <> b")


@query(f"WITH {Q.MATCHES} SELECT a AS doc_id, b AS match, round(similarity, 6) AS similarity FROM t WHERE rank = 1")
def doc_best_match(spark: SparkSession, sf: str) -> DataFrame:
    return S.top_matches(_matches(spark, sf)).select(F.col("a").alias("doc_id"), F.col("b").alias("match"), F.round("similarity", 6).alias("similarity"))


@query(f"WITH {Q.MATCHES} SELECT d.doc_id, t.b IS NOT NULL AS exists, CAST(t.rank AS INTEGER) AS rank, t.b AS match, round(t.similarity, 6) AS similarity FROM documents d LEFT JOIN t ON t.a = d.doc_id AND rank <= 3 WHERE d.doc_id % 100 = 0")
def doc_check_top3(spark: SparkSession, sf: str) -> DataFrame:
    asked = _documents(spark, sf).where(F.col("doc_id") % 100 == 0).select("doc_id")
    found = S.top_matches(_matches(spark, sf), 3).select(F.col("a").alias("doc_id"), "rank", F.col("b").alias("match"), F.round("similarity", 6).alias("similarity"))
    return asked.join(found, "doc_id", "left").withColumn("exists", F.col("match").isNotNull())


_CHECKED = f"WITH {Q.MATCHES.replace('AND q.id <> e.id ', '')} SELECT d.doc_id, t.b IS NOT NULL AS exists, CAST(t.rank AS INTEGER) AS rank, t.b AS match, round(t.similarity, 6) AS similarity FROM documents d LEFT JOIN t ON t.a = d.doc_id AND rank <= 3 WHERE d.doc_id % 100 = 0"


@query(_CHECKED)
def check_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose id is divisible by 100 checked against all by a stored inverted index, of which they read only their own folders."""
    path = shared_path(spark, "postings")
    sigs = cut(_signatures(spark, sf).select("id", "sig"))
    P.save(sigs, path, buckets=32)
    asked = sigs.where(F.col("id") % 100 == 0)
    found = cut(ING.checked(asked.select(F.col("id").alias("path")), P.look_up(asked, path), 3))
    drop_path(spark, path)
    return found.select(F.col("path").alias("doc_id"), "exists", "rank", "match", F.round("similarity", 6).alias("similarity"))


@query(_CHECKED)
def check_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The same check without a stored index: all signatures are held against those asked for."""
    library = cut(_signatures(spark, sf).select(F.col("id").alias("path"), "sig"))
    return ING.check(library.where(F.col("path") % 100 == 0), library).select(F.col("path").alias("doc_id"), "exists", "rank", "match", F.round("similarity", 6).alias("similarity"))


@query(
    f"WITH {Q.SHINGLES}, y AS (SELECT item_id, {Q.tokens('text')} AS w FROM benchmark), i AS (SELECT item_id, CASE WHEN len(w) >= 58 THEN list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ') || ' ')) END AS s FROM y), "
    "q AS (SELECT item_id, len(s) AS n, unnest(s) AS h FROM i WHERE len(s) > 0), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM x WHERE len(s) > 0), "
    "p AS (SELECT item_id, doc_id, count(*) AS shared, any_value(q.n) AS na, any_value(e.n) AS nb FROM q JOIN e USING (h) GROUP BY ALL), m AS (SELECT item_id, count(*) AS n FROM p WHERE CAST(shared AS DOUBLE) / (na + nb - shared) >= 0.5 GROUP BY item_id) "
    "SELECT benchmark.item_id, coalesce(m.n, 0) AS n_matches FROM benchmark LEFT JOIN m USING (item_id)"
)
def benchmark_check(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items held against all documents: how many are similar at 0.5 or above, as whole texts.

    An item of under 58 words has no signature and so 0 matches, which says nothing about it; a passage
    contained in a much longer document is not found.
    """
    items = S.signatures(read_table(spark, sf, "benchmark"), "item_id").select("id", "sig")
    found = S.cross_join(items, _signatures(spark, sf).select("id", "sig"), 0.5).groupBy(F.col("a").alias("item_id")).agg(F.count("*").alias("n"))
    return read_table(spark, sf, "benchmark").select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_matches"))


@query(
    f"WITH {Q.PAIRS}, v AS (SELECT j.a, j.b, len(wa.w) AS na, len(wb.w) AS nb, octet_length(encode(da.text)) AS za, octet_length(encode(db.text)) AS zb FROM j JOIN w wa ON wa.doc_id = a JOIN w wb ON wb.doc_id = b JOIN documents da ON da.doc_id = a JOIN documents db ON db.doc_id = b) "
    "SELECT a, b, CASE WHEN na > 0 AND nb > 0 AND abs(na - nb) * 100 // greatest(na, nb) >= 2 THEN nb > na ELSE zb > za END AS new_wins FROM v"
)
def better_copy(spark: SparkSession, sf: str) -> DataFrame:
    """Of each similar pair of distinct signatures, whether the later document would replace the earlier.

    Only the smallest document of each signature is judged here; `better_copy_members` judges the others.
    """
    documents = _documents(spark, sf)
    sigs = cut(S.signatures(documents))
    return _judged(documents, sigs, S.self_join(S.representatives(sigs)).select("a", "b"))


@query(
    f"WITH {Q.CLASSES} SELECT c.rep AS a, c.doc_id AS b, CASE WHEN abs(len(wa.w) - len(wb.w)) * 100 // greatest(len(wa.w), len(wb.w)) >= 2 THEN len(wb.w) > len(wa.w) ELSE octet_length(encode(db.text)) > octet_length(encode(da.text)) END AS new_wins "
    "FROM c JOIN w wa ON wa.doc_id = c.rep JOIN w wb ON wb.doc_id = c.doc_id JOIN documents da ON da.doc_id = c.rep JOIN documents db ON db.doc_id = c.doc_id WHERE c.rep <> c.doc_id"
)
def better_copy_members(spark: SparkSession, sf: str) -> DataFrame:
    """Of each document whose signature an earlier one has, whether it would replace the first of these."""
    held = cut(S.keyed(S.signatures(_documents(spark, sf))))
    least = held.groupBy("key").agg(F.min("id").alias("rep"))
    pairs = salted_join(held, least, ["key"], ["id"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    return _judged(read_table(spark, sf, "documents"), held, pairs)


def _judged(documents: DataFrame, sigs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, new_wins) of pairs of documents, b the new one."""
    copies = documents.select(F.col("doc_id").alias("id"), F.octet_length("text").cast("long").alias("size")).join(sigs.select("id", "n_words"), "id")
    side = lambda name, key: copies.select(F.col("id").alias(key), F.struct(F.col("n_words").alias("words"), "size", F.lit("").alias("series"), F.lit(0.0).alias("idx")).alias(name))
    rows = pairs.join(side("old", "a"), "a").join(side("new", "b"), "b")
    return rows.select("a", "b", ING.better_copy(F.col("new"), F.col("old")).alias("new_wins"))


# ---- the index ----

_SNAPSHOTS = """s AS (SELECT CAST(doc_id AS VARCHAR) AS path, n_chars + CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS size, CASE WHEN source = 'src3' THEN 2 ELSE 1 END AS mod_time FROM documents WHERE lang <> 'es'),
o AS (SELECT CAST(doc_id AS VARCHAR) AS path, n_chars AS size, 1 AS mod_time FROM documents WHERE lang <> 'fr')"""


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A scan of the documents and an older index: Spanish ones are gone, French ones new, German and src3 ones changed."""
    documents = _documents(spark, sf).select(F.col("doc_id").cast("string").alias("path"), "n_chars", "lang", "source")
    changed = F.when(F.col("lang") == "de", 1).otherwise(0)
    scan = documents.where("lang <> 'es'").select("path", (F.col("n_chars") + changed).cast("long").alias("size"), F.when(F.col("source") == "src3", 2).otherwise(1).cast("long").alias("mod_time"))
    old = documents.where("lang <> 'fr'").select("path", F.col("n_chars").cast("long").alias("size"), F.lit(1).cast("long").alias("mod_time"))
    return scan, old


@query(f"WITH {_SNAPSHOTS} SELECT s.path FROM s LEFT JOIN o USING (path) WHERE o.path IS NULL OR s.size <> o.size OR s.mod_time <> o.mod_time")
def index_stale(spark: SparkSession, sf: str) -> DataFrame:
    return I.stale(*_snapshots(spark, sf)).select("path")


@query(f"WITH {_SNAPSHOTS} SELECT count(*) AS n_pruned FROM o WHERE path NOT IN (SELECT path FROM s)")
def index_pruned(spark: SparkSession, sf: str) -> DataFrame:
    scan, old = _snapshots(spark, sf)
    return I.gone(old, scan).agg(F.count("*").alias("n_pruned"))


@query(f"WITH {_SNAPSHOTS} SELECT path, CAST(size AS BIGINT) AS size, CAST(mod_time AS BIGINT) AS mod_time FROM s")
def index_update(spark: SparkSession, sf: str) -> DataFrame:
    """After pruning and putting the stale rows, the index equals the scan."""
    scan, old = _snapshots(spark, sf)
    return I.put(I.prune(old, scan), I.stale(scan, old))


@query(f"WITH {_SNAPSHOTS}, n AS (SELECT s.path FROM s LEFT JOIN o USING (path) WHERE o.path IS NULL OR s.size <> o.size OR s.mod_time <> o.mod_time) SELECT (SELECT count(*) FROM s) AS total, (SELECT count(*) FROM n) AS updated, (SELECT count(*) FROM o WHERE path NOT IN (SELECT path FROM s)) AS pruned")
def index_build(spark: SparkSession, sf: str) -> DataFrame:
    """How many entries an incremental build has, computes and prunes."""
    return I.build(*_snapshots(spark, sf), lambda rows: rows)[1]


@query(f"WITH {Q.SHINGLES} SELECT CAST(doc_id AS VARCHAR) AS path, CAST(n AS INTEGER) AS words, CAST(coalesce(len(s), -1) AS INTEGER) AS n_sig, lang AS tag FROM x JOIN documents USING (doc_id)")
def index_saved(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as an index, saved, saved over, and loaded again."""
    path = shared_path(spark, "index")
    documents = _documents(spark, sf)
    rows = S.signatures(documents).join(documents.select(F.col("doc_id").alias("id"), "lang", "n_chars"), "id")
    index = rows.select(
        F.col("id").cast("string").alias("path"), F.col("n_chars").cast("long").alias("size"), F.lit(1).cast("long").alias("mod_time"), F.col("n_words").cast("int").alias("words"), "sig",
        F.lit("").alias("title"), F.lit("").alias("author"), F.lit("").alias("series"), F.array("lang").alias("tags"),
    )
    I.save(index, path)
    I.save(I.load(spark, path), path)
    return I.load(spark, path).select("path", "words", F.coalesce(F.size("sig"), F.lit(-1)).alias("n_sig"), F.get("tags", F.lit(0)).alias("tag"))


#: Four epochs of the documents as books: all but French ones; German ones changed and French ones new; Spanish ones deleted;
#: and a scan of the German ones again, which changes nothing.
_EPOCHS = """e AS (SELECT CAST(doc_id AS VARCHAR) AS path, n_chars + CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS size, CASE WHEN lang IN ('de', 'fr') THEN 2 ELSE 1 END AS mod_time,
CASE WHEN lang = 'de' THEN ['alemão', source] WHEN lang = 'fr' THEN ['fr', source, source] ELSE [lang, source] END AS tags FROM documents WHERE lang <> 'es')"""


def _epochs(spark: SparkSession, sf: str) -> str:
    """The index after these epochs, with merges from two runs on; its path."""
    path = shared_path(spark, "epochs")
    books = _documents(spark, sf).select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").cast("long").alias("size"), "lang", "source")
    none = F.lit("")

    def entries(rows: DataFrame) -> DataFrame:
        return rows.select("path", "size", "mod_time", F.lit(0).alias("words"), F.array().cast("array<bigint>").alias("sig"), none.alias("title"), none.alias("author"), none.alias("series"), "tags")

    scan = lambda rows, more, at, *tags: rows.select("path", (F.col("size") + more).alias("size"), F.lit(at).cast("long").alias("mod_time"), F.array(*tags).alias("tags"))
    german, french = scan(books.where("lang = 'de'"), 1, 2, F.lit("alemão"), "source"), scan(books.where("lang = 'fr'"), 0, 2, "lang", "source", "source")
    gone = scan(books.where("lang = 'es'"), 0, 3, "lang").withColumn("deleted", F.lit(True))
    for epoch, batch in enumerate([scan(books.where("lang <> 'fr'"), 0, 1, "lang", "source"), german.unionByName(french), gone, german]):
        incremental.upsert(batch, path, entries, epoch, merge_after=2)
    return path


@query(f"WITH {_EPOCHS} SELECT path, CAST(size AS BIGINT) AS size, CAST(mod_time AS BIGINT) AS mod_time, array_to_string(tags, '|') AS tags FROM e")
def index_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """The index after epochs of new, changed and deleted books, of which each read only the buckets that it touched."""
    return incremental.current(spark, _epochs(spark, sf)).select("path", "size", "mod_time", joined(F.col("tags")).alias("tags"))


@query(f"WITH {_EPOCHS} SELECT genre, count(*) AS freq FROM (SELECT unnest(tags) AS genre FROM e) GROUP BY genre")
def genre_freq_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Books by genre after the same epochs, kept by signed differences and never recounted."""
    return incremental.genre_frequencies(spark, _epochs(spark, sf))


# ---- genres ----


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), F.concat(F.array("p_type", "p_brand"), F.split("p_name", " ")).alias("tags"))


_TAGGED = f"t AS (SELECT CAST(p_partkey AS VARCHAR) AS path, {Q.TAGS} AS tags FROM part)"
_CLEANED = f"t AS (SELECT CAST(p_partkey AS VARCHAR) AS path, {Q.TAGS} AS tags FROM part), c AS (SELECT path, tags, {Q.clean_pt('tags')} AS clean FROM t), v AS (SELECT genre, count(*) AS freq FROM (SELECT unnest(clean) AS genre FROM c) GROUP BY genre)"


@query(f"WITH {_TAGGED} SELECT genre, count(*) AS freq FROM (SELECT unnest(tags) AS genre FROM t) GROUP BY genre")
def genre_freq(spark: SparkSession, sf: str) -> DataFrame:
    return I.genre_frequencies(_parts(spark, sf))


@query(f"WITH {_CLEANED} SELECT * FROM v")
def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return GO.vocabulary(_parts(spark, sf))


@query(f"WITH {_CLEANED} SELECT count(*) AS n FROM v WHERE freq >= 3")
def vocabulary_size(spark: SparkSession, sf: str) -> DataFrame:
    return GO.vocabulary_size(GO.vocabulary(_parts(spark, sf)))


@query(f"WITH {_CLEANED} SELECT * FROM v WHERE freq >= 3 ORDER BY freq DESC, genre LIMIT 40")
def vocabulary_top(spark: SparkSession, sf: str) -> DataFrame:
    return GO.top(GO.vocabulary(_parts(spark, sf)), 40, 3)


@query(f"WITH {_CLEANED} SELECT count(*) FILTER (WHERE freq = 1) AS singles, count(*) AS genres, round(100.0 * count(*) FILTER (WHERE freq = 1) / greatest(count(*), 1), 4) AS percent FROM v")
def long_tail(spark: SparkSession, sf: str) -> DataFrame:
    return GO.long_tail(GO.vocabulary(_parts(spark, sf)))


@query(
    f"WITH {_TAGGED}, r AS (SELECT DISTINCT path, genre FROM (SELECT path, unnest(tags) AS genre FROM t)), f AS (SELECT genre, count(*) AS freq FROM r GROUP BY genre), b AS (SELECT path, max(freq) AS most FROM r JOIN f USING (genre) GROUP BY path) "
    "SELECT CAST(threshold AS INTEGER) AS threshold, (SELECT count(*) FROM f WHERE freq >= threshold) AS genres, (SELECT count(*) FROM b WHERE most >= threshold) AS books_kept, (SELECT count(*) FROM b WHERE most < threshold) AS books_lost FROM (SELECT unnest([1, 2, 3, 5, 10, 20]) AS threshold)"
)
def threshold_curve(spark: SparkSession, sf: str) -> DataFrame:
    return GO.threshold_curve(_parts(spark, sf))


@query(
    f"WITH {_TAGGED}, g AS (SELECT genre, count(*) AS freq FROM (SELECT unnest(tags) AS genre FROM t) GROUP BY genre), c AS (SELECT genre, freq, unnest({Q.clean_pt('[genre]')}) AS after FROM g) "
    "SELECT (SELECT CAST(sum(freq) AS BIGINT) FROM g) AS before, (SELECT count(*) FROM g) AS distinct_before, CAST(sum(freq) AS BIGINT) AS after, count(DISTINCT after) AS distinct_after FROM c"
)
def genre_analyze(spark: SparkSession, sf: str) -> DataFrame:
    return GO.analyze(I.genre_frequencies(_parts(spark, sf)))


@query(
    f"WITH {_CLEANED}, k AS (SELECT list(genre) AS names FROM v WHERE freq >= 3), a AS (SELECT path, tags, list_filter(clean, lambda g: list_contains(names, g)) AS after FROM c, k) "
    "SELECT path, array_to_string(after, '|') AS after, list_sort(tags) <> list_sort(after) AS changed, len(after) = 0 AS emptied FROM a"
)
def clean_genres(spark: SparkSession, sf: str) -> DataFrame:
    return GO.clean_books(_parts(spark, sf)).select("path", joined(F.col("after")).alias("after"), "changed", "emptied")


@query(
    f"WITH {_CLEANED}, k AS (SELECT list(genre) AS names FROM v WHERE freq >= 3), a AS (SELECT path, tags, list_filter(clean, lambda g: list_contains(names, g)) AS after FROM c, k) "
    "SELECT count(*) AS books, count(*) FILTER (WHERE list_sort(tags) <> list_sort(after)) AS changed, count(*) FILTER (WHERE len(after) = 0) AS emptied, (SELECT count(DISTINCT g) FROM (SELECT unnest(tags) AS g FROM t)) AS labels_before, (SELECT count(DISTINCT g) FROM (SELECT unnest(after) AS g FROM a)) AS labels_after FROM a"
)
def clean_genres_summary(spark: SparkSession, sf: str) -> DataFrame:
    return GO.clean_summary(GO.clean_books(_parts(spark, sf)))


@query("SELECT CAST(floor((rn - 1) / 500) AS BIGINT) AS batch, string_agg(CAST(c_custkey AS VARCHAR), ', ' ORDER BY c_custkey) AS ids FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer) GROUP BY batch")
def sql_batches_500(spark: SparkSession, sf: str) -> DataFrame:
    return GO.id_batches(read_table(spark, sf, "customer"), 500, "c_custkey")


@query("SELECT c_custkey, '''' || replace(replace(c_name || '\\' || c_mktsegment || '''', '\\', '\\\\'), '''', '''''') || '''' AS quoted FROM customer")
def quote_sql(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "customer").select("c_custkey", T.quote_sql(F.concat("c_name", F.lit("\\"), "c_mktsegment", F.lit("'"))).alias("quoted"))


# ---- authors ----


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_custkey").cast("string").alias("id"), F.lit(1).alias("books"), F.col("c_name").alias("name"))


_KEYED = f"k AS (SELECT c_custkey AS ord, c_name, {Q.norm_key('c_name')} AS canon FROM customer)"


@query(f"WITH {_KEYED} SELECT ord, canon, CAST((CASE WHEN c_name LIKE '%,%' OR c_name LIKE '%;%' THEN 4 ELSE 0 END) + (CASE WHEN c_name LIKE '%  %' THEN 1 ELSE 0 END) AS INTEGER) AS penalty FROM k")
def author_keys(spark: SparkSession, sf: str) -> DataFrame:
    return A.keys(_customers(spark, sf)).select("ord", "canon", A.penalty(F.col("name")).alias("penalty"))


@query(f"WITH {_KEYED} SELECT a.ord AS a, b.ord AS b FROM k a JOIN k b ON a.ord < b.ord AND length(a.canon) >= 12 AND length(b.canon) - length(a.canon) IN (0, 1) AND a.canon <> b.canon AND levenshtein(a.canon, b.canon) <= CASE WHEN length(a.canon) >= 20 THEN 2 ELSE 1 END")
def typo_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return A.typo_pairs(A.keys(_customers(spark, sf)))


# ---- series ----


def _titled_parts(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), F.initcap("p_name").alias("title"), F.col("p_brand").alias("author"))


@query(
    f"WITH w AS (SELECT DISTINCT p_partkey, {Q.norm_key('p_brand')} AS author_key, word FROM (SELECT p_partkey, p_brand, unnest(string_split(lower(p_name), ' ')[2:]) AS word FROM part)) "
    f"SELECT author_key, word AS term, count(*) AS n FROM w WHERE length(word) >= 4 AND word NOT IN ({', '.join(Q.quote(x) for x in [*SE.STOPWORDS, *SE.GENERIC, *SE.PUBLISHERS])}) GROUP BY ALL HAVING count(*) >= 3"
)
def series_terms(spark: SparkSession, sf: str) -> DataFrame:
    return SE.term_counts(SE.terms(_titled_parts(spark, sf))).select("author_key", "term", "n")


# ---- sources and ingest ----


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(c_nationkey AS INTEGER) AS books, c_name || chr(9) || c_mktsegment AS name FROM customer")
def catalog_customers(spark: SparkSession, sf: str) -> DataFrame:
    lines = read_table(spark, sf, "customer").select(F.concat_ws("\t", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), "c_name", "c_mktsegment").alias("value"))
    return readers.parse_catalog(lines)


def _library(spark: SparkSession, sf: str) -> DataFrame:
    documents = _documents(spark, sf).withColumn("size", F.octet_length("text").cast("long"))
    sigs = S.signatures(documents, keep=("source", "lang", "size"))
    return cut(sigs.select(F.format_string("d%012d.epub", "id").alias("path"), "id", F.col("n_words").alias("words"), "size", "sig", F.col("source").alias("series"), F.array("lang").alias("tags")))


@query(
    f"WITH {Q.SHINGLES}, y AS (SELECT doc_id AS id, s, len(s) AS n FROM x WHERE len(s) > 0), e AS (SELECT id, n, unnest(s) AS h FROM y), q AS (SELECT * FROM e WHERE id % 100 = 0), "
    "p AS (SELECT q.id AS a, e.id AS b, count(*) AS shared, any_value(q.n) AS na, any_value(e.n) AS nb FROM q JOIN e ON q.h = e.h GROUP BY ALL), "
    "t AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY CAST(shared AS DOUBLE) / (na + nb - shared) DESC, b) AS rank FROM p WHERE CAST(shared AS DOUBLE) / (na + nb - shared) >= 0.85) "
    "SELECT printf('in/d%012d.epub', d.doc_id) AS path, CASE WHEN x.s IS NULL OR len(x.s) = 0 THEN 'ERRO' ELSE 'DUPLICATA' END AS status, CASE WHEN t.b IS NOT NULL THEN printf('d%012d.epub', t.b) END AS duplicate FROM documents d JOIN x USING (doc_id) LEFT JOIN t ON t.a = d.doc_id AND rank = 1 WHERE d.doc_id % 100 = 0"
)
def ingest_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose id is divisible by 100 as incoming books against all as the library: each finds a copy of equal worth, which stays."""
    library = _library(spark, sf)
    meta = composed.book_meta(F.lit(""), F.lit(""), F.col("series"), F.lit(0.0))
    incoming = library.where(F.col("id") % 100 == 0).select(F.concat(F.lit("in/"), "path").alias("path"), F.regexp_replace("path", r"\.epub$", "").alias("stem"), F.lit(".epub").alias("ext"), "words", "size", "sig", meta.alias("meta"))
    return ING.plan(incoming, library.drop("id")).select("path", "status", "duplicate")


@query(
    f"WITH {Q.SHINGLES}, y AS (SELECT doc_id AS id, s, len(s) AS n FROM x WHERE len(s) > 0), e AS (SELECT id, n, unnest(s) AS h FROM y), q AS (SELECT * FROM e WHERE id % 100 = 0), "
    "p AS (SELECT q.id AS a, e.id AS b, count(*) AS shared, any_value(q.n) AS na, any_value(e.n) AS nb FROM q JOIN e ON q.h = e.h GROUP BY ALL), "
    "t AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY CAST(shared AS DOUBLE) / (na + nb - shared) DESC, b) AS rank FROM p WHERE CAST(shared AS DOUBLE) / (na + nb - shared) >= 0.85), "
    "m AS (SELECT a, b, wa.n AS nw, wb.n AS ow, octet_length(encode(da.text)) AS nz, octet_length(encode(db.text)) AS oz, row_number() OVER (PARTITION BY b ORDER BY a) AS turn FROM t JOIN x wa ON wa.doc_id = a JOIN x wb ON wb.doc_id = b JOIN documents da ON da.doc_id = a JOIN documents db ON db.doc_id = b WHERE rank = 1), "
    "v AS (SELECT *, nw > 0 AND ow > 0 AND abs(nw - ow) * 100 // greatest(nw, ow, 1) >= 2 AS words, list_transform([nz, oz], lambda z: CASE WHEN z > 1048576 THEN printf('%.1f MB', z / 1048576.0) WHEN z > 1024 THEN printf('%d KB', CAST(round_even(z / 1024.0, 0) AS BIGINT)) ELSE printf('%d B', z) END) AS z FROM m) "
    "SELECT 'replace' AS action, printf('in/d%012d.epub', a) AS src, printf('d%012d', b) || CASE WHEN turn > 1 THEN printf(' (%d)', turn - 1) ELSE '' END || '.epub' AS dst, printf('--title d%012d', a) AS args, "
    "CASE WHEN words AND nw > ow THEN printf('o novo tem mais texto (%d vs %d palavras)', nw, ow) WHEN words THEN printf('o da biblioteca tem mais texto (%d vs %d palavras)', ow, nw) WHEN nz > oz THEN 'mesmo texto, novo é maior (' || z[1] || ' vs ' || z[2] || ')' "
    "WHEN nz < oz THEN 'mesmo texto, o da biblioteca é maior (' || z[2] || ' vs ' || z[1] || ')' ELSE 'empate; mantém o da biblioteca' END AS reason FROM v"
)
def ingest_actions(spark: SparkSession, sf: str) -> DataFrame:
    """The action rows of the same plan under the policy that replaces copies."""
    library = _library(spark, sf)
    meta = composed.book_meta(F.lit(""), F.lit(""), F.col("series"), F.lit(0.0))
    incoming = library.where(F.col("id") % 100 == 0).select(F.concat(F.lit("in/"), "path").alias("path"), F.regexp_replace("path", r"\.epub$", "").alias("stem"), F.lit(".epub").alias("ext"), "words", "size", "sig", meta.alias("meta"))
    return sinks.unique_paths(sinks.actions(ING.plan(incoming, library.drop("id"), on_duplicate="replace")))


#: Three quarters of the documents come in; the library is the fourth quarter, with every other copy a byte short. What is similar to
#: no book there stays if no earlier input that stays is similar: a list of those is carried through all inputs in order.
_MIXED = f"""WITH RECURSIVE {Q.SHINGLES},
y AS (SELECT doc_id AS id, s, len(s) AS n FROM x WHERE len(s) > 0),
e AS (SELECT id, n, unnest(s) AS h FROM y),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.h = b.h AND a.id <> b.id AND a.id % 4 <> 1 GROUP BY ALL),
j AS MATERIALIZED (SELECT a, b, CAST(shared AS DOUBLE) / (na + nb - shared) AS similarity FROM p WHERE CAST(shared AS DOUBLE) / (na + nb - shared) >= 0.85),
l AS (SELECT a, b, similarity FROM j WHERE b % 4 = 1 QUALIFY row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) = 1),
o AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS i, (SELECT coalesce(list(b), []) FROM j WHERE a = y.id AND b < a AND b % 4 <> 1) AS earlier FROM y WHERE id % 4 <> 1 AND id NOT IN (SELECT a FROM l)),
r(i, stay) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT o.i, CASE WHEN list_has_any(o.earlier, r.stay) THEN r.stay ELSE list_append(r.stay, o.id) END FROM r JOIN o ON o.i = r.i + 1),
z AS (SELECT unnest(stay) AS id FROM (SELECT stay FROM r ORDER BY i DESC LIMIT 1)),
w2 AS (SELECT a, b, similarity FROM j WHERE b < a AND b IN (SELECT id FROM z) AND a NOT IN (SELECT id FROM z) AND a NOT IN (SELECT a FROM l) QUALIFY row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) = 1),
m AS (SELECT a, b, similarity, true AS old FROM l UNION ALL SELECT a, b, similarity, false FROM w2),
v AS (SELECT d.doc_id AS id, x.s, m.b, m.old, similarity, coalesce(old AND CASE WHEN abs(x.n - xb.n) * 100 // greatest(x.n, xb.n, 1) >= 2 THEN x.n > xb.n
             ELSE octet_length(encode(d.text)) > octet_length(encode(db.text)) - CASE WHEN m.b % 8 = 1 THEN 1 ELSE 0 END END, false) AS wins
      FROM documents d JOIN x USING (doc_id) LEFT JOIN m ON m.a = d.doc_id LEFT JOIN x xb ON xb.doc_id = m.b LEFT JOIN documents db ON db.doc_id = m.b WHERE d.doc_id % 4 <> 1),
f AS (SELECT id, CASE WHEN s IS NULL OR len(s) = 0 THEN 'ERRO' WHEN wins THEN 'SUBSTITUI' WHEN b IS NOT NULL THEN 'DUPLICATA' ELSE 'NOVO' END AS status, b, old, similarity, wins FROM v)
"""


def _batch(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A library of a quarter of the documents, and the others coming in."""
    library = _library(spark, sf)
    meta = composed.book_meta(F.lit(""), F.lit(""), F.col("series"), F.lit(0.0))
    incoming = library.where(F.col("id") % 4 != 1).select("id", F.col("id").alias("number"), F.concat(F.lit("in/"), "path").alias("path"), F.regexp_replace("path", r"\.epub$", "").alias("stem"), F.lit(".epub").alias("ext"), "words", "size", "sig", meta.alias("meta"))
    return library.where(F.col("id") % 4 == 1).withColumn("size", F.col("size") - F.when(F.col("id") % 8 == 1, 1).otherwise(0)).withColumnRenamed("id", "number"), incoming


def _mixed(spark: SparkSession, sf: str, on_duplicate: str = "best") -> DataFrame:
    """A batch with every outcome, held against the library and against itself."""
    held, incoming = _batch(spark, sf)
    return ING.plan(incoming, held, on_duplicate=on_duplicate, dedupe_within_batch=True)


@query(_MIXED + "SELECT printf('in/d%012d.epub', id) AS path, status, CASE WHEN old THEN printf('d%012d.epub', b) WHEN NOT old THEN printf('in/d%012d.epub', b) END AS duplicate, round(similarity, 6) AS similarity FROM f")
def ingest_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Near copies within a batch: the first that stays makes those after it duplicates."""
    return _mixed(spark, sf).select("path", "status", "duplicate", F.round("similarity", 6).alias("similarity"))


@query(_MIXED + "SELECT printf('in/d%012d.epub', id) AS path, CASE status WHEN 'ERRO' THEN 'none' WHEN 'NOVO' THEN 'move' ELSE 'quarantine' END AS action, CASE WHEN status = 'NOVO' THEN true ELSE false END AS placed FROM (SELECT id, CASE status WHEN 'SUBSTITUI' THEN 'DUPLICATA' ELSE status END AS status FROM f)")
def ingest_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """The same batch where duplicates are put aside."""
    return _mixed(spark, sf, "quarantine").select("path", "action", F.col("dest").isNotNull().alias("placed"))


@query(_MIXED + "SELECT action, count(*) AS n FROM (SELECT CASE status WHEN 'ERRO' THEN 'none' WHEN 'NOVO' THEN 'move' ELSE 'skip' END AS action FROM f) GROUP BY action")
def ingest_skipped(spark: SparkSession, sf: str) -> DataFrame:
    """The same batch where duplicates are left where they are, by action."""
    return _mixed(spark, sf, "skip").groupBy("action").agg(F.count("*").alias("n"))


@query(_MIXED + "SELECT count(*) AS inputs, count(*) FILTER (WHERE status = 'NOVO') AS novo, count(*) FILTER (WHERE status = 'DUPLICATA') AS duplicata, count(*) FILTER (WHERE status = 'SUBSTITUI') AS substitui, count(*) FILTER (WHERE status = 'ERRO') AS erro FROM f")
def ingest_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ING.summary(_mixed(spark, sf))


@query(
    _MIXED + "SELECT printf('in/d%012d', id) || e.ext AS path, CASE WHEN NOT convert AND e.ext <> '.epub' THEN 'ERRO' ELSE status END AS status, CASE WHEN NOT convert AND e.ext <> '.epub' THEN 'formato ' || e.ext || ' exige conversão' WHEN status = 'ERRO' THEN 'não foi possível ler o texto do arquivo' ELSE '' END AS why, "
    "CASE WHEN (NOT convert AND e.ext <> '.epub') OR status = 'ERRO' THEN 'none' WHEN e.ext <> '.epub' AND b IS NULL THEN 'convert' WHEN b IS NULL THEN 'move' WHEN old AND wins THEN 'replace' ELSE 'skip' END AS action, convert "
    "FROM (SELECT f.id, e.ext, convert, b, old, wins, CASE WHEN e.ext <> '.epub' AND status = 'ERRO' THEN 'NOVO' ELSE status END AS status FROM f JOIN (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN '.mobi' ELSE '.epub' END AS ext FROM documents) e USING (id), (VALUES (true), (false)) c(convert)) e"
)
def ingest_formats(spark: SparkSession, sf: str) -> DataFrame:
    """A batch of which every fifth book is in another format, with and without conversion."""
    library, incoming = _batch(spark, sf)
    ext = F.when(F.col("id") % 5 == 0, ".mobi").otherwise(".epub")
    incoming = incoming.withColumn("ext", ext).withColumn("path", F.concat(F.lit("in/"), "stem", "ext"))
    best = ING.matches(incoming, library, dedupe_within_batch=True)
    made = [ING.plan(incoming, library, dedupe_within_batch=True, convert=c, best=best).withColumn("convert", F.lit(c)) for c in (True, False)]
    own = F.when(F.col("status") == "ERRO", F.col("why")).otherwise("")
    return made[0].unionByName(made[1]).select("path", "status", own.alias("why"), "action", "convert")


@query(
    _MIXED + ", g AS (SELECT source, count(*) AS freq FROM documents WHERE doc_id % 4 = 1 GROUP BY source), n AS (SELECT f.id, status, d.source[1].upper() || d.source[2:] AS label, coalesce(freq, 0) >= 3 AS often FROM f JOIN documents d ON d.doc_id = f.id LEFT JOIN g ON g.source = d.source WHERE status IN ('NOVO', 'SUBSTITUI')) "
    "SELECT printf('in/d%012d.epub', id) AS path, CASE WHEN status = 'SUBSTITUI' THEN '' WHEN often THEN 'gêneros: ' || label || ', Terror (descartados: Zzzz)' ELSE 'gêneros: Terror (descartados: ' || label || ', Zzzz)' END AS note, "
    "printf('--title|d%012d', id) || CASE WHEN status = 'SUBSTITUI' THEN '' WHEN often THEN '|--tags|' || label || ',Terror' ELSE '|--tags|Terror' END AS args FROM n"
)
def ingest_genres(spark: SparkSession, sf: str) -> DataFrame:
    """The genre policy of new books: labels that the library uses, and canonical ones, are written; rare ones are told."""
    library, incoming = _batch(spark, sf)
    library = library.withColumn("tags", F.array(F.initcap("series")))
    tags = F.array(F.upper("meta.series"), F.lit("zzzz; terror"))
    made = ING.plan(incoming.withColumn("meta", F.col("meta").withField("tags", tags)), library, dedupe_within_batch=True)
    return made.where("status IN ('NOVO', 'SUBSTITUI')").select("path", F.coalesce("genre_note", F.lit("")).alias("note"), joined(F.col("meta_args")).alias("args"))
