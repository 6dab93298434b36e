"""Decisions about incoming books, as plans: nothing on disk is touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import genres as G
from vellum.functions import metadata as M
from vellum.functions import names as N
from vellum.functions import text as T
from vellum.operators import genres as genre_ops
from vellum.operators.enrich import enriched
from vellum.operators import signature as S
from vellum.session import cut

ON_DUPLICATE = ("best", "skip", "quarantine", "replace")


def _has_series(c: Column) -> Column:
    return T.strip(F.coalesce(c["series"], F.lit(""))) != ""


def _words_decide(a: Column, b: Column) -> Column:
    gap = F.floor(F.abs(a["words"] - b["words"]) * 100 / F.greatest(a["words"], b["words"], F.lit(1)))
    return (a["words"] > 0) & (b["words"] > 0) & (gap >= 2)


def better_copy(new: Column, old: Column) -> Column:
    """Whether the new copy replaces the old: by series, volume number, words from 2 % on, then bytes. Structs of words, size, series, idx."""
    return (
        F.when(_has_series(new) != _has_series(old), _has_series(new))
        .when(_has_series(new) & ((new["idx"] > 0) != (old["idx"] > 0)), new["idx"] > 0)
        .when(_words_decide(new, old), new["words"] > old["words"])
        .otherwise(new["size"] > old["size"])
    )


def describe_choice(new: Column, old: Column) -> Column:
    """The same choice in words; volume numbers are not told."""
    text = lambda pattern, *values: F.format_string(pattern, *values)
    size = lambda c: T.human_size(c["size"])
    # The reasons.
    return (
        F.when(_has_series(new) & ~_has_series(old), "o novo tem série no metadado")
        .when(_has_series(old) & ~_has_series(new), "o da biblioteca tem série no metadado")
        .when(_words_decide(new, old) & (new["words"] > old["words"]), text("o novo tem mais texto (%d vs %d palavras)", new["words"], old["words"]))
        .when(_words_decide(new, old), text("o da biblioteca tem mais texto (%d vs %d palavras)", old["words"], new["words"]))
        .when(new["size"] > old["size"], text("mesmo texto, novo é maior (%s vs %s)", size(new), size(old)))
        .when(new["size"] < old["size"], text("mesmo texto, o da biblioteca é maior (%s vs %s)", size(old), size(new)))
        .otherwise("empate; mantém o da biblioteca")
    )


def plan(inputs: DataFrame, index: DataFrame, target: str = "grimmory", similarity: float = S.THRESHOLD, on_duplicate: str = "best", min_genre_freq: int = 3, convert: bool = True, answers: DataFrame | None = None, again: DataFrame | None = None, dedupe_within_batch: bool = False, best: DataFrame | None = None) -> DataFrame:
    """A row of outcome for each input.

    inputs: (path, stem, ext, words, size, sig, meta); index: (path, words, size, sig, series, tags);
    answers, again: what an outside metadata tool said, as `operators.enrich` has it. Returns (path, status, dest,
    duplicate, similarity, new_wins, why, meta_args, enrich_args, enrich_note, genre_note, action). status: NOVO, DUPLICATA, SUBSTITUI, ERRO.
    Inputs are held against the index and, only with `dedupe_within_batch`, against each other: of those that the
    library lacks, in the order of their paths, one that is similar to an earlier one which stays is its duplicate. It
    never replaces that one, whatever the policy, as it is not in the library yet. best: what `matches` found for the
    same inputs, where it is known.
    """
    if on_duplicate not in ON_DUPLICATE:
        raise ValueError(f"unknown way with duplicates {on_duplicate!r}; there are {', '.join(ON_DUPLICATE)}")
    best = matches(inputs, index, similarity, dedupe_within_batch) if best is None else best
    held = index.select(F.col("path").alias("duplicate"), F.struct("words", "size", "series", F.lit(0.0).alias("idx")).alias("old"))
    if dedupe_within_batch:
        held = held.unionByName(inputs.select(F.col("path").alias("duplicate"), F.struct("words", "size", F.col("meta.series").alias("series"), F.col("meta.series_index").alias("idx")).alias("old")))
    in_library = index.select(F.col("path").alias("duplicate"), F.lit(True).alias("in_library"))
    # signatures are long and matched by now: whether there is one is all that moves on
    rows = inputs.withColumn("unread", F.coalesce(F.size("sig"), F.lit(0)) <= 0).drop("sig")
    rows = rows.withColumn("book", N.parse_filename(F.col("stem"))).join(best, "path", "left").join(held, "duplicate", "left").join(in_library, "duplicate", "left")
    new = F.struct("words", "size", F.col("meta.series").alias("series"), F.col("meta.series_index").alias("idx"))
    rows = rows.withColumn("new", new).withColumn("wins", F.coalesce(F.col("in_library") & (F.lit(on_duplicate == "best") & better_copy(F.col("new"), F.col("old")) | F.lit(on_duplicate == "replace")), F.lit(False)))
    rows = N.place(rows, target)
    rows = enriched(rows, answers, again)
    duplicate = F.col("duplicate").isNotNull()
    error = F.when((F.col("ext") != ".epub") & F.lit(not convert), F.concat(F.lit("formato "), "ext", F.lit(" exige conversão"))).when(
        (F.col("ext") == ".epub") & F.col("unread"), "não foi possível ler o texto do arquivo"
    )
    # the genre policy: own and suggested tags, admitted by the library's raw frequencies
    suggested = F.flatten(F.transform(F.filter("enrich_args", lambda x, i: F.coalesce(F.get("enrich_args", i - 1) == "--tags", F.lit(False))), lambda x: F.split(x, ",")))
    rows = rows.withColumn("all_tags", F.concat("meta.tags", suggested))
    if min_genre_freq > 0:
        frequencies = index.select(F.explode("tags").alias("genre")).groupBy("genre").agg(F.count("*").alias("freq"))
        admitted = genre_ops.admit(rows.where(F.size("all_tags") > 0), frequencies, min_genre_freq, tags="all_tags").withColumnRenamed("path", "_path")
        rows = rows.join(admitted, F.col("path") == F.col("_path"), "left").drop("_path")
        ruled = F.col("accepted").isNotNull()
        note = F.when(ruled, genre_ops.note(F.col("accepted"), F.col("refused"), F.col("meta.tags")))
        extra = F.when(ruled & ~T.same_set(F.col("accepted"), F.col("meta.tags")), F.array(F.lit("--tags"), F.array_join("accepted", ",")))
        not_tags = F.filter("enrich_args", lambda x, i: ~((x == "--tags") | F.coalesce(F.get("enrich_args", i - 1) == "--tags", F.lit(False))))
        enrich = F.when(ruled, not_tags).otherwise(F.col("enrich_args"))
    else:
        note, extra, enrich = F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.col("enrich_args")
    fresh = ~duplicate & error.isNull() & (F.col("ext") == ".epub")
    none = F.array().cast("array<string>")
    status = F.when(error.isNotNull(), "ERRO").when(duplicate & F.col("wins"), "SUBSTITUI").when(duplicate, "DUPLICATA").otherwise("NOVO")
    action = (
        F.when(error.isNotNull(), "none").when((F.col("ext") != ".epub") & ~duplicate, "convert").when(duplicate & F.col("wins"), "replace")
        .when(duplicate & F.lit(on_duplicate == "quarantine"), "quarantine").when(duplicate, "skip").otherwise("move")
    )
    dest = F.when(fresh, F.concat_ws("/", "placement.dir", "placement.filename")).when(duplicate & F.col("wins"), F.col("duplicate"))
    return rows.select(
        "path", status.alias("status"), dest.alias("dest"), "duplicate", "similarity", F.when(duplicate, F.col("wins")).alias("new_wins"),
        F.when(error.isNotNull(), error).when(duplicate, describe_choice(F.col("new"), F.col("old"))).alias("why"),
        F.when(fresh, F.concat("placement.meta_args", F.coalesce(extra, none))).when(duplicate & F.col("wins"), F.col("placement.meta_args")).otherwise(none).alias("meta_args"),
        F.when(fresh, enrich).otherwise(none).alias("enrich_args"), F.when(fresh, F.col("enrich_note")).alias("enrich_note"), F.when(fresh, note).alias("genre_note"), action.alias("action"),
    )


def matches(inputs: DataFrame, index: DataFrame, similarity: float = S.THRESHOLD, dedupe_within_batch: bool = False) -> DataFrame:
    """(path, duplicate, similarity): of each input that is similar to an entry, the most similar; else, if asked for, what `within_batch` finds.

    Where both have a column `number`, unique longs in the order of their paths, they are taken as cut and numbers are compared and moved
    in place of paths; paths come back at the end.
    """
    given = "number" in inputs.columns and "number" in index.columns
    key = "number" if given else "path"
    asked, held = inputs.select(F.col(key).alias("id"), "sig"), index.select(F.col(key).alias("id"), "sig")
    if not given:
        asked, held = (cut(x.where(F.size("sig") > 0)) for x in (asked, held))
    best = cut(S.top_matches(S._cross_join(asked, held, similarity), 1).select("a", "b", "similarity"))
    within = cut(S.top_matches(S._come_after(asked.where(F.size("sig") > 0), similarity, best.select(F.col("a").alias("id"))), 1).select("a", "b", "similarity")) if dedupe_within_batch else None
    of = lambda end, name, books: books.select(F.col(key).alias(end), F.col("path").alias(name))
    named = lambda pairs, books: pairs.join(of("a", "path", inputs), "a").join(of("b", "duplicate", books), "b").select("path", "duplicate", "similarity")
    return cut(named(best, index) if within is None else named(best, index).unionByName(named(within, inputs)))


def within_batch(inputs: DataFrame, similarity: float = S.THRESHOLD) -> DataFrame:
    """(path, duplicate, similarity) of the inputs that an earlier one, which stays, makes a duplicate: the most similar such one. inputs: (path, sig)."""
    pairs = S.come_after(inputs.select(F.col("path").alias("id"), "sig"), similarity)
    return S.top_matches(pairs, 1).select(F.col("a").alias("path"), F.col("b").alias("duplicate"), "similarity")


def summary(outcomes: DataFrame) -> DataFrame:
    kinds = ("NOVO", "DUPLICATA", "SUBSTITUI", "ERRO")
    return outcomes.agg(F.count("*").alias("inputs"), *(F.count_if(F.col("status") == k).alias(k.lower()) for k in kinds))


def check(queries: DataFrame, index: DataFrame, similarity: float = S.THRESHOLD, k: int = 3) -> DataFrame:
    """(path, exists, rank, match, similarity): up to k similar entries of each input, and whether there are any. Both: (path, sig)."""
    return checked(queries, S.cross_join(queries.select(F.col("path").alias("id"), "sig"), index.select(F.col("path").alias("id"), "sig"), similarity), k)


def checked(queries: DataFrame, pairs: DataFrame, k: int = 3) -> DataFrame:
    """The same from similar pairs (a, b, similarity), as `postings.look_up` gives them."""
    found = S.top_matches(pairs, k)
    return queries.select("path").join(found.select(F.col("a").alias("path"), "rank", F.col("b").alias("match"), "similarity"), "path", "left").withColumn("exists", F.col("match").isNotNull())


def needs_work(books: DataFrame, target: str = "grimmory", enrich: bool = False, relayout: bool = False, limit: int = 0) -> DataFrame:
    """books (path, stem, meta) that an edit would change, each path once, in order: lacking metadata, misplaced, or with changed fields.

    Both switches may be on. limit: how many an edit takes at most, 0 for all.
    """
    # placed once, and filtered as rows: a condition pushed below would place them again
    rows = cut(N.place(books.dropDuplicates(["path"]).withColumn("book", N.parse_filename(F.col("stem"))), target))
    local = F.size("placement.meta_args") > 0
    wanted = local if relayout or not enrich else F.lit(False)
    if enrich:
        wanted = wanted | M.lacks_metadata(F.col("meta"))
    if relayout:
        wanted = wanted | (F.col("path") != _place_of())
    found = rows.where(wanted).orderBy("path")
    return found.limit(limit) if limit > 0 else found


def _place_of() -> Column:
    return F.concat_ws("/", "placement.dir", "placement.filename")


def edit_plan(found: DataFrame, enrich: bool = False, relayout: bool = False) -> DataFrame:
    """(path, missing, args, dst) of the books that `needs_work` finds: fields to look up, local changes, and where a book moves."""
    meta = F.col("meta")
    # The names of the fields.
    lacks = F.array(F.when(F.size(meta["tags"]) == 0, "gêneros"), F.when(meta["isbn"] == "", "ISBN"), F.when(meta["publisher"] == "", "editora"), F.when(~meta["has_desc"], "sinopse"))
    missing = F.filter(lacks, lambda x: x.isNotNull()) if enrich else F.array().cast("array<string>")
    dst = F.when(F.lit(relayout) & (_place_of() != F.col("path")), _place_of())
    return found.select("path", missing.alias("missing"), F.col("placement.meta_args").alias("args"), dst.alias("dst"))


def preview(planned: DataFrame, n: int = 12) -> DataFrame:
    """The first rows of an edit's plan, as its report shows them."""
    return planned.orderBy("path").limit(n)


def import_tags(requested: DataFrame, current: DataFrame, merge: bool = False) -> DataFrame:
    """requested (path, tags) against current (path, tags): (path, tags, state), state absent, correct or pending."""
    held = current.select(F.col("path").alias("_path"), F.col("tags").alias("now"))
    rows = requested.join(held, F.col("path") == F.col("_path"), "left")
    tags = T.union_sorted(F.col("tags"), F.coalesce("now", F.array().cast("array<string>"))) if merge else F.col("tags")
    state = F.when(F.col("_path").isNull(), "absent").when(T.same_set(tags, F.col("now")), "correct").otherwise("pending")
    return rows.select("path", tags.alias("tags"), state.alias("state"))


def import_summary(planned: DataFrame) -> DataFrame:
    return planned.agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("correct", "absent", "pending")))


def series_inputs(books: DataFrame) -> DataFrame:
    """Books whose metadata declares no series, with a title and an author: (path, title, author)."""
    blank = lambda c: T.strip(F.coalesce(F.col(c), F.lit(""))) == ""
    return books.where(blank("meta.series") & (F.col("meta.title") != "") & (F.col("meta.author") != "")).select("path", F.col("meta.title").alias("title"), F.col("meta.author").alias("author"))


def genres_of(books: DataFrame) -> DataFrame:
    return books.select("path", G.clean_pt(F.col("meta.tags")).alias("tags"))
