"""Series that titles of one author share without declaring them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions import text as T
from vellum.operators.skew import salted_join
from vellum.session import cut

# Words that name no series.
STOPWORDS = (
    "a o as os um uma uns umas de da do das dos e em no na nos nas por para com sem sob sobre ao aos à às que se ou the of and in to at "
    "seu sua seus suas meu minha este esta esse essa aquele"
).split()
GENERIC = (
    "contos conto livro livros volume vol parte obras obra coleção colecao antologia completa completo história historia histórias historias "
    "novo nova grande grandes melhor melhores vida morte amor guerra tempo mundo homem mulher noite dia casa rei senhor filho filha segredo "
    "segredos mistério misterio crime assassinato caso última ultimo último primeira primeiro edição edicao selecionados escolhidos reunidos "
    "essencial clássicos classicos clássico classico civil penal direito manual curso esquematizado comentado brasileiro brasileira português "
    "portugues literatura biblioteca trilogia saga série serie box"
).split()
PUBLISHERS = (
    "zahar record rocco intrinseca intrínseca companhia letras objetiva planeta globo sextante arqueiro aleph darkside suma leya ática atica "
    "scipione moderna saraiva atlas forense revan boitempo martins fontes penguin harper collins bertrand nova fronteira ediouro melhoramentos "
    "paulinas vozes unesp edusp autêntica autentica todavia fósforo fosforo"
).split()


def valid_term(key: Column, word: Column, position: Column) -> Column:
    """A word that can name a series: long enough, no common word, no number, capitalised, not the title's first."""
    return (
        (F.length(key) >= 4) & ~key.isin(*STOPWORDS, *GENERIC, *PUBLISHERS) & ~F.rlike(key, F.lit(r"\A[0-9]+\z"))
        & (position > 0) & F.rlike(word, F.lit(r"\A\p{Lu}"))
    )


def terms(books: DataFrame) -> DataFrame:
    """books (path, title, author) -> (author_key, path, title, title_key, term, word), a row for each valid term of a title."""
    keyed = books.select("path", "title", T.norm_key(F.col("author")).alias("author_key")).where("author_key <> ''")
    rows = keyed.select("*", F.posexplode(F.regexp_extract_all("title", F.lit(r"([\p{L}\p{N}']+)"), F.lit(1))).alias("position", "word"))
    rows = rows.withColumn("term", T.norm_key(F.col("word"))).where(valid_term(F.col("term"), F.col("word"), F.col("position")))
    first = rows.groupBy("author_key", "path", "title", "term").agg(F.min_by("word", "position").alias("word"))
    return first.withColumn("title_key", T.norm_key(F.col("title")))


def term_counts(found: DataFrame, minimum: int = 3) -> DataFrame:
    """(author_key, term, n, display): books by term; display is the first spelling that is not all capitals, by path."""
    loud = (F.regexp_count("word", F.lit(r"\p{L}")) > 1) & ~F.rlike("word", F.lit(r"[^\P{L}\p{Lu}]"))
    return found.groupBy("author_key", "term").agg(F.count("*").alias("n"), F.min_by("word", F.struct(loud, F.col("path"))).alias("display")).where(F.col("n") >= minimum)


def detect(books: DataFrame, minimum: int = 3, exclude: list[str] | None = None) -> DataFrame:
    """(author_key, name, score, path, title): the members of each series found.

    Within an author, terms go from the commonest down and take the books that no earlier term took, so a term
    depends only on earlier terms that share a free book with it. Rounds settle many at once: a term that is the first in all
    its free books takes them, if they are enough and none is named by the term alone, or it goes. A term that has
    too few free books left goes at once. Authors and terms are keys of shuffles, never one task's work.
    """
    counted = cut(term_counts(terms(books), minimum))
    open_ = salted_join(terms(books), counted, ["author_key", "term"], ["path"])
    open_ = cut(open_.select("author_key", "term", F.struct(-F.col("n"), F.col("term")).alias("order"), "n", "display", "path", "title", "title_key"))
    chosen = None
    while not open_.isEmpty():
        first = open_.withColumn("first", F.min("order").over(Window.partitionBy("author_key", "path")))
        state = first.groupBy("author_key", "term").agg(
            F.count("*").alias("free"), F.bool_and(F.col("order") == F.col("first")).alias("ready"), F.bool_or(F.col("title_key") == F.col("term")).alias("alone")
        )
        takes = F.col("ready") & (F.col("free") >= minimum) & ~F.col("alone")
        state = cut(state.select("author_key", "term", takes.alias("takes"), (F.col("ready") | (F.col("free") < minimum)).alias("settled")))
        marked = cut(salted_join(open_, state, ["author_key", "term"], ["path"]))
        now = marked.where("takes").select("author_key", "display", "n", "path", "title")
        chosen = now if chosen is None else chosen.unionByName(now)
        open_ = cut(marked.where("NOT settled").drop("takes", "settled").join(now.select("author_key", "path").distinct(), ["author_key", "path"], "left_anti"))
    if chosen is None:
        chosen = open_.select("author_key", "display", "n", "path", "title")
    if exclude:
        chosen = chosen.where(~F.lower("display").isin(*[x.lower() for x in exclude]))
    return chosen.select("author_key", F.col("display").alias("name"), F.col("n").alias("score"), "path", "title")


def candidates(members: DataFrame) -> DataFrame:
    """(author_key, name, members, score), the largest first."""
    return members.groupBy("author_key", "name", "score").agg(F.count("*").alias("members")).orderBy(F.desc("members"), "name")


def report(members: DataFrame, n: int = 25, titles: int = 4) -> DataFrame:
    """(author_key, name, members, titles, more): the n largest series, each with its first titles by path and how many more there are.

    The largest are found from counts, so only their own volumes are put in order.
    """
    largest = members.groupBy("author_key", "name").agg(F.count("*").alias("members")).orderBy(F.desc("members"), "name", "author_key").limit(n)
    rows = members.join(F.broadcast(largest), ["author_key", "name"])  # n rows
    order = Window.partitionBy("author_key", "name").orderBy("path", "title")
    first = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= titles)
    listed = first.groupBy("author_key", "name", "members").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda x: T.truncate(x["title"], 64)).alias("titles"))
    return listed.withColumn("more", F.greatest(F.col("members") - titles, F.lit(0)))
