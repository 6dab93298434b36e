"""Genre vocabularies over a library or a catalogue: frequencies, cut-offs, clean-up plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import genres as G
from vellum.functions import text as T
from vellum.operators.number import numbered
from vellum.operators.skew import salted_join
from vellum.session import cut

MIN_FREQ = 3


def cleaned(books: DataFrame, path: str = "path", tags: str = "tags", vocabulary: dict[str, str] | None = None) -> DataFrame:
    """(path, before, clean) of each row with tags: its labels in canonical form, without repeats, sorted.

    A label is cleaned once, however many rows have it: the distinct labels are, and each row's come back to it in
    their order. A label of a third of all rows is dealt out where the cleaned forms are put beside it.
    """
    held = books.where(F.size(tags) > 0).select(F.col(path).alias("path"), F.col(tags).alias("before"))
    rows = held.select("path", "before", F.posexplode("before").alias("position", "label"))
    forms = cut(rows.select("label").distinct()).select("label", F.explode(F.array(G.usable_forms(F.array("label"), vocabulary))).alias("forms"))
    made = salted_join(rows, forms.where(F.size("forms") > 0), ["label"], ["path", "position"], "left")
    listed = F.array_sort(F.collect_list(F.when(F.col("forms").isNotNull(), F.struct("position", "forms"))))
    return made.groupBy("path", "before").agg(listed.alias("all")).select("path", "before", G.merged(F.flatten(F.transform("all", lambda x: x["forms"]))).alias("clean"))


def vocabulary(books: DataFrame, tags: str = "tags", clean: bool = False, path: str = "path") -> DataFrame:
    """(genre, freq): books by genre, of lists that are clean already or are cleaned here."""
    rows = books.select(F.col(tags).alias("clean")) if clean else cleaned(books, path, tags)
    return rows.select(F.explode("clean").alias("genre")).groupBy("genre").agg(F.count("*").alias("freq"))


def kept(vocab: DataFrame, minimum: int = MIN_FREQ) -> DataFrame:
    return vocab.where(F.lit(minimum <= 1) | (F.col("freq") >= minimum))


def vocabulary_size(vocab: DataFrame, minimum: int = MIN_FREQ) -> DataFrame:
    return kept(vocab, minimum).agg(F.count("*").alias("n"))


def top(vocab: DataFrame, n: int, minimum: int = 1) -> DataFrame:
    """The n most frequent genres that are kept, ties by name; all for n = 0."""
    ordered = kept(vocab, minimum).orderBy(F.desc("freq"), "genre")
    return ordered.limit(n) if n > 0 else ordered


def clean_books(books: DataFrame, minimum: int = MIN_FREQ, path: str = "path", tags: str = "tags") -> DataFrame:
    """(path, before, after, changed, emptied): each book's tags cleaned, then cut by how many books use them."""
    held = cut(cleaned(books, path, tags))
    keep = kept(vocabulary(held, "clean", clean=True), minimum).select("genre", F.lit(True).alias("ok"))
    rows = salted_join(held.select("path", "before", F.explode_outer("clean").alias("genre")), keep, ["genre"], ["path"], "left")
    after = rows.groupBy("path", "before").agg(F.array_sort(F.collect_list(F.when(F.col("ok"), F.col("genre")))).alias("after"))
    return after.select("path", "before", "after", (~T.same_set(F.col("before"), F.col("after"))).alias("changed"), (F.size("after") == 0).alias("emptied"))


def clean_summary(cleaned: DataFrame) -> DataFrame:
    before = cleaned.select(F.explode("before").alias("g")).agg(F.countDistinct("g").alias("labels_before"))
    after = cleaned.select(F.explode("after").alias("g")).agg(F.countDistinct("g").alias("labels_after"))
    counts = cleaned.agg(F.count("*").alias("books"), F.count_if("changed").alias("changed"), F.count_if("emptied").alias("emptied"))
    return counts.crossJoin(before).crossJoin(after)  # a row each


def analyze(labels: DataFrame) -> DataFrame:
    """labels (genre, freq): totals and distinct labels before and after cleaning, each weighted by its books."""
    rows = labels.select("genre", "freq", F.explode_outer(G.clean_pt(F.array("genre"))).alias("after"))
    done = rows.agg(F.coalesce(F.sum(F.when(F.col("after").isNotNull(), F.col("freq"))), F.lit(0)).alias("after"), F.countDistinct("after").alias("distinct_after"))
    return labels.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("before"), F.countDistinct("genre").alias("distinct_before")).crossJoin(done)


def threshold_curve(books: DataFrame, thresholds: tuple[int, ...] = (1, 2, 3, 5, 10, 20), path: str = "path", tags: str = "tags") -> DataFrame:
    """(threshold, genres, books_kept, books_lost): genres that reach each threshold, and books with one and with none."""
    rows = books.select(F.col(path).alias("path"), F.explode(tags).alias("genre")).distinct()
    freq = rows.groupBy("genre").agg(F.count("*").alias("freq"))
    best = rows.join(freq, "genre").groupBy("path").agg(F.max("freq").alias("most"))
    genres = freq.agg(*(F.count_if(F.col("freq") >= t).alias(f"g{t}") for t in thresholds))
    lists = best.agg(*(F.count_if(F.col("most") >= t).alias(f"k{t}") for t in thresholds), F.count("*").alias("all"))
    made = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"g{t}").alias("genres"), F.col(f"k{t}").alias("books_kept"), (F.col("all") - F.col(f"k{t}")).alias("books_lost")) for t in thresholds)))
    return genres.crossJoin(lists).select(made.alias("r")).select("r.*")


def long_tail(vocab: DataFrame) -> DataFrame:
    """How many genres have a single book, and their share."""
    return vocab.agg(F.count_if(F.col("freq") == 1).alias("singles"), F.count("*").alias("genres"), F.round(100.0 * F.count_if(F.col("freq") == 1) / F.greatest(F.count("*"), F.lit(1)), 4).alias("percent"))


def admit(books: DataFrame, frequencies: DataFrame, minimum: int = MIN_FREQ, path: str = "path", tags: str = "tags") -> DataFrame:
    """(path, accepted, refused): cleaned labels that the library uses enough or that are canonical, and the rest."""
    bare = books.where(F.coalesce(F.size(tags), F.lit(0)) <= 0).select(F.col(path).alias("path"), F.lit(None).cast("string").alias("genre"))
    rows = cleaned(books, path, tags).select("path", F.explode_outer("clean").alias("genre")).unionByName(bare)
    rows = salted_join(rows, frequencies.select("genre", "freq"), ["genre"], ["path"], "left")
    ok = F.lit(minimum <= 1) | (F.coalesce("freq", F.lit(0)) >= minimum) | G.is_canonical(F.col("genre"))
    lists = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("genre"))))
    return rows.groupBy("path").agg(lists(ok).alias("accepted"), lists(~ok).alias("refused"))


def note(accepted: Column, refused: Column, own: Column) -> Column:
    """What the genre policy did, in words; null if nothing."""
    both = F.concat(F.lit("gêneros: "), F.array_join(accepted, ", "), F.lit(" (descartados: "), F.array_join(refused, ", "), F.lit(")"))
    only = F.concat(F.lit("gêneros descartados por serem raros/ruído: "), F.array_join(refused, ", "))
    changed = F.concat(F.lit("gêneros normalizados: "), F.array_join(accepted, ", "))
    return F.when((F.size(refused) > 0) & (F.size(accepted) > 0), both).when(F.size(refused) > 0, only).when((F.size(accepted) > 0) & ~T.same_set(accepted, own), changed)


def plan(catalog: DataFrame, names: DataFrame | None = None, minimum: int = MIN_FREQ, keep: list[str] | None = None, vocabulary: dict[str, str] | None = None) -> DataFrame:
    """catalog (id, books, name) -> (id, books, name, target, reason): what becomes of each label.

    names (name): people, whose names are no labels. target is empty for labels to remove.
    """
    rows = catalog.select("id", "books", "name", F.lower(T.strip(F.col("name"))).alias("low"))
    if names is not None:
        people = names.select(F.lower(T.strip(F.col("name"))).alias("low")).where("low <> ''").distinct().withColumn("person", F.lit(True))
        rows = rows.join(people, "low", "left")
    else:
        rows = rows.withColumn("person", F.lit(None).cast("boolean"))
    person = F.coalesce("person", F.lit(False))
    rows = rows.withColumn("clean", G.clean_en(F.array("name"), vocabulary)).withColumn("known", G.canonical_en(F.col("name"), vocabulary)["known"])
    first = F.coalesce(F.get("clean", F.lit(0)), F.lit(""))
    kept_names = F.lower("name").isin(*[k.lower() for k in keep]) if keep else F.lit(False)
    rare = (first != "") & ~F.col("known") & (F.col("books") < minimum) & ~kept_names
    reason = (
        F.when(person, "nome de autor").when(F.size("clean") == 0, "ruído").when(rare, f"raro (<{minimum})").when(F.size("clean") > 1, "lista")
        .when(F.lower(first) != F.lower("name"), "canoniza").otherwise("")
    )
    return rows.select("id", "books", "name", F.when(person | rare, "").otherwise(first).alias("target"), reason.alias("reason"))


def plan_after(planned: DataFrame) -> DataFrame:
    """(genre, books) of each final label."""
    return planned.where("target <> ''").groupBy(F.col("target").alias("genre")).agg(F.sum("books").alias("books"))


def plan_summary(planned: DataFrame) -> DataFrame:
    removed = F.col("target") == ""
    return planned.agg(
        F.count("*").alias("labels"), F.countDistinct(F.when(~removed, F.col("target"))).alias("labels_after"), F.count_if(removed).alias("removed"),
        F.coalesce(F.sum(F.when(removed, F.col("books"))), F.lit(0)).cast("long").alias("associations_lost"),
        F.count_if(~removed & (F.col("reason") != "")).alias("canonised"), F.count_if(~removed & (F.col("reason") == "")).alias("unchanged"),
    )


def plan_reasons(planned: DataFrame) -> DataFrame:
    """(reason, n) of the labels to remove, by reason."""
    return planned.where("target = ''").groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason")


def plan_top(planned: DataFrame, n: int = 30) -> DataFrame:
    """The largest labels after the clean-up, as its report shows them."""
    return plan_after(planned).orderBy(F.desc("books"), "genre").limit(n)


def plan_detail(planned: DataFrame) -> DataFrame:
    """(books, name, target, reason) of every label that changes, the largest first."""
    return planned.where("reason <> ''").select("books", "name", "target", "reason").orderBy(F.desc("books"), "name")


def id_batches(ids: DataFrame, size: int = 500, column: str = "id") -> DataFrame:
    """(batch, ids): ids in order, so many to a statement."""
    placed = numbered(ids.select(F.col(column).alias("id")), "id").select("id", F.floor(F.col("number") / size).alias("batch"))
    return placed.groupBy("batch").agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ", ").alias("ids"))


def plan_sql(planned: DataFrame) -> DataFrame:
    """(step, ord, sql): the statements that carry the plan out, to be read in order."""
    moved = planned.where((F.col("target") != "") & (F.lower("target") != F.lower("name")))
    creates = plan_after(planned).select(F.lit(1).alias("step"), F.col("genre").alias("ord"), F.concat(F.lit("INSERT IGNORE INTO category (name) VALUES ("), T.quote_sql(F.col("genre")), F.lit(");")).alias("sql"))
    redirect = F.concat(
        F.lit("INSERT IGNORE INTO book_metadata_category_mapping (book_id, category_id) SELECT m.book_id, (SELECT id FROM category WHERE name = "), T.quote_sql(F.col("target")),
        F.lit(") FROM book_metadata_category_mapping m WHERE m.category_id = "), F.col("id").cast("string"), F.lit(";"),
    )
    redirects = moved.select(F.lit(2).alias("step"), F.col("id").cast("string").alias("ord"), redirect.alias("sql"))
    batches = id_batches(planned.where((F.col("target") == "") | (F.lower("target") != F.lower("name"))))
    deletes = batches.select(F.lit(3).alias("step"), F.format_string("%012d", F.col("batch")).alias("ord"), F.concat(F.lit("DELETE FROM book_metadata_category_mapping WHERE category_id IN ("), "ids", F.lit("); DELETE FROM category WHERE id IN ("), "ids", F.lit(");")).alias("sql"))
    return creates.unionByName(redirects).unionByName(deletes)
