"""Content signatures and similarity.

A signature is the set of hashes of a text's 8-word shingles, whole or sampled by content. Similarity is
the Jaccard index of two signatures. Joins first bring texts of equal signatures together, so that copies
cost one row, and find candidates through each signature's rarest hashes (a prefix long enough that two
signatures above the threshold must share one of them), so that a passage which many texts share makes
no candidates. Candidates are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions import text as T
from vellum.operators.graph import components
from vellum.operators.skew import SALTS, salted_join
from vellum.session import cut, ship

SHINGLE = 8
SPARE = 50
SAMPLE = 128
THRESHOLD = 0.85
#: So many ids at most are sent to all tasks; more are joined by shuffles.
FEW_IDS = 200_000
#: The common hashes are counted over documents that hold about this many hashes; one that fewer of them than OFTEN have is not common.
COUNTED, OFTEN = 1 << 23, 4
#: Open signatures of so many hashes together are settled in one task, in place of in rounds.
TOGETHER = 1 << 22


def shingles(words: Column, size: int = SHINGLE) -> Column:
    """Windows of `size` words, each followed by a space; none for fewer words than that."""
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat(F.concat_ws(" ", F.slice(words, i, F.lit(size))), F.lit(" ")))


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """A 64-bit hash of each window of `size` words, made from the hashes of its words."""
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    return T.bind(F.transform(words, lambda w: F.xxhash64(w)), lambda hs: F.transform(starts, lambda i: F.xxhash64(*[F.get(hs, i + k) for k in range(size)])))


def _enough(words: Column, values: Column, size: int) -> Column:
    return F.when(F.size(words) >= size + SPARE, values)


def _once(df: DataFrame, id_col: str, text_col: str, made, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_words, sig) with sig = made(words), and the columns to keep. The generator keeps what follows from repeating the work: no filter or projection is folded into it."""
    words = T.tokens(F.coalesce(F.col(text_col), F.lit("")))
    held = T.bind(words, lambda w: F.struct(F.size(w).alias("n_words"), made(w).alias("sig")))
    return df.select(F.col(id_col).alias("id"), *keep, F.explode(F.array(held)).alias("m")).select("id", "m.n_words", "m.sig", *keep)


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_words, sig) and the columns to keep: unsampled, 64-bit hashes in order; null for texts that are too short."""
    return _once(df, id_col, text_col, lambda w: _enough(w, F.sort_array(F.array_distinct(shingle_hashes(w, size))), size), keep)


def sampled_md5(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, n_words, sig): shingles whose MD5 starts with 00 or 80, one in 128, as hexadecimal strings."""
    hashes = lambda w: F.filter(F.transform(shingles(w, size), lambda s: F.md5(s)), lambda h: F.substring(h, 1, 2).isin("00", "80"))
    return _once(df, id_col, text_col, lambda w: _enough(w, F.array_sort(F.array_distinct(hashes(w))), size))


# The parameters of FNV-1a with 64 bits.
FNV_OFFSET, FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


def fnv1a(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The FNV-1a hash of each slice of a byte array; all slices step together."""
    out = np.full(len(starts), FNV_OFFSET)
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, live = starts[order], lengths[order], np.full(len(starts), FNV_OFFSET)
    for step in range(int(lengths[0]) if len(lengths) else 0):
        n = int(np.searchsorted(-lengths, -step, "left"))  # those that are longer than step
        live[:n] = (live[:n] ^ data[starts[:n] + step].astype(np.uint64)) * FNV_PRIME
    out[order] = live
    return out


def sampled_fnv(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, sample: int = SAMPLE) -> DataFrame:
    """(id, n_words, sig): FNV-1a hashes divisible by `sample`, as the bits of signed longs, in unsigned order.

    Words come from the JVM joined, each before a space, and all shingles of a batch are hashed together.
    """
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [x or b"" for x in batch.column(1).to_pylist()]
            data = np.frombuffer(b"".join(lines), np.uint8)
            ends = np.flatnonzero(data == 32) + 1
            line_ends = np.cumsum([len(x) for x in lines])
            last = np.searchsorted(ends, line_ends, "right")  # of each line: the words up to its end
            n_words = np.diff(last, prepend=0)
            enough = n_words >= size + SPARE
            # a shingle starts at each word but the last ones of its line
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else np.zeros(0, np.int64)
            of = np.repeat(np.arange(len(lines)), n_words)
            first = np.flatnonzero(enough[of] & (np.arange(len(ends)) <= last[of] - size))
            hashes = fnv1a(data, starts[first], ends[first + size - 1])
            hit = hashes % np.uint64(sample) == 0
            hashes, of = hashes[hit], of[first][hit]
            cuts = np.searchsorted(of, np.arange(len(lines) + 1))
            sigs = [np.unique(hashes[a:b]).view(np.int64) if ok else None for a, b, ok in zip(cuts, cuts[1:], enough, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int32()), pa.array(sigs, pa.list_(pa.int64()))], ["id", "n_words", "sig"])

    line = T.bind(T.tokens(F.coalesce(F.col(text_col), F.lit(""))), lambda w: F.when(F.size(w) > 0, F.concat(F.array_join(w, " "), F.lit(" "))).otherwise(""))
    return df.select(F.col(id_col).alias("id"), line.cast("binary").alias("line")).mapInArrow(run, f"id {kind}, n_words int, sig array<bigint>")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty or null."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / (F.size(a) + F.size(b) - shared)).otherwise(F.lit(0.0))


def keyed(sigs: DataFrame) -> DataFrame:
    """(id, n_words, key) of each non-empty signature, with its hash in its place."""
    return sigs.where(F.size("sig") > 0).select("id", "n_words", F.sha2(F.array_join(F.col("sig").cast("array<string>"), ","), 256).alias("key"))


def classes(sigs: DataFrame) -> DataFrame:
    """(id, rep): texts of equal, non-empty signatures share the smallest id."""
    held = sigs.where(F.size("sig") > 0).select("id", F.sha2(F.array_join(F.col("sig").cast("array<string>"), ","), 256).alias("key"))
    least = held.groupBy("key").agg(F.min("id").alias("rep"))
    return salted_join(held, least, ["key"], ["id"]).select("id", "rep")


def representatives(sigs: DataFrame) -> DataFrame:
    """(id, sig) of the smallest id of each class."""
    held = sigs.where(F.size("sig") > 0).select("id", "sig", F.sha2(F.array_join(F.col("sig").cast("array<string>"), ","), 256).alias("key"))
    return held.groupBy("key").agg(F.min(F.struct("id", "sig")).alias("m")).select("m.*")


def _prefixes(sigs: DataFrame, threshold: float) -> DataFrame:
    """(id, n, h): each signature's rarest hashes, of those that occur elsewhere.

    Hashes that occur nowhere else come first in the order; they are only counted, so the rows that move
    after the count are those that can meet.
    """
    rows = sigs.select("id", F.size("sig").alias("n"), F.explode("sig").alias("h"))
    shared = rows.withColumn("f", F.count("*").over(Window.partitionBy("h"))).where("f > 1")
    ordered = shared.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("hs"))
    kept = F.slice("hs", F.lit(1), F.greatest(prefix_length(F.col("n"), threshold) - (F.col("n") - F.size("hs")), F.lit(0)))
    return ordered.select("id", "n", F.explode(kept).alias("e")).select("id", "n", F.col("e.h").alias("h"))


def common_hashes(sigs: DataFrame, more_than: int = 64) -> DataFrame:
    """(h, f): hashes that more than so many of all signatures have, and how many about. sigs: (id, sig).

    Counted over all of a small table and over documents drawn by their id of a large one, so there are COUNTED / OFTEN
    at most, whatever the corpus. They serve to put hashes in an order; any choice of them gives right results.
    """
    total = sigs.agg(F.sum(F.size("sig"))).first()[0] or 0
    share = max(1, total // COUNTED)
    drawn = sigs if share == 1 else sigs.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0)
    least = more_than + 1 if share == 1 else max(OFTEN, more_than // share + 1)
    counts = drawn.select(F.explode("sig").alias("h")).groupBy("h").agg(F.count("*").alias("f")).where(F.col("f") >= least)
    return cut(counts.select("h", (F.col("f") * share).alias("f")))


def first_hashes(sigs: DataFrame, common: DataFrame, threshold: float) -> DataFrame:
    """(h, id, n): the first hashes of each signature, so many that a similar one has one of them among its own first.

    The order is the same for all: common hashes come last, the others by their value. So a signature is cut where it
    lies, and only its first hashes move. common: (h) of a bounded number of rows, as `common_hashes` has them.
    """
    ship(sigs.sparkSession)
    kind = sigs.schema["id"].dataType.simpleString()
    held = np.sort(common.select("h").toArrow().column(0).to_numpy().astype(np.int64))
    often = sigs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = often.value
        for batch in batches:
            n = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            take = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            h = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(n)), n)
            late = last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h if len(last) else np.zeros(len(h), bool)
            # in the order of a signature's hashes: how many of the same kind stand before each, and how many that are not common there are
            starts, before, later = np.cumsum(n) - n, np.cumsum(~late) - ~late, np.cumsum(late) - late
            early = np.add.reduceat(~late, starts, dtype=np.int64) if len(n) else n
            place = np.where(late, early[of] + later - later[starts][of], before - before[starts][of])
            kept = np.flatnonzero(place < take[of])
            yield pa.RecordBatch.from_arrays([pa.array(h[kept], pa.int64()), batch.column(0).take(pa.array(of[kept])), pa.array(n[of[kept]], pa.int32())], ["h", "id", "n"])

    n = F.size("sig")
    return sigs.where(n > 0).select("id", F.sort_array("sig").alias("sig"), n.alias("n"), prefix_length(n, threshold).alias("take")).mapInArrow(run, f"h long, id {kind}, n int")


def meeting(sigs: DataFrame, threshold: float, without: DataFrame | None = None) -> DataFrame:
    """The signatures that have one of their first hashes among those of another: all that are similar to another, and few else.

    sigs: (id, sig), ids unique. without: (id) of those that are left out; only their hashes are moved for it.
    """
    first = first_hashes(sigs, common_hashes(sigs), threshold).select("h", "id")
    first = cut(first if without is None else first.join(without, "id", "left_anti"))
    shared = first.groupBy("h").agg(F.count("*").alias("f")).where("f > 1").select("h")
    return _only(sigs, first.join(shared, "h", "left_semi"))


def _only(sigs: DataFrame, ids: DataFrame) -> DataFrame:
    """The signatures whose id is among these; where these are few, signatures stay where they lie."""
    ids = cut(ids.select("id").distinct())
    return cut(sigs.select("id", "sig").join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, "id", "left_semi"))


def _asked_for(sigs: DataFrame, ids: DataFrame) -> DataFrame:
    """The signatures that a join with these ids needs, where the ids are few; else all, as the join drops the others."""
    ids = cut(ids.distinct())
    return sigs.join(F.broadcast(ids), "id", "left_semi") if ids.count() <= FEW_IDS else sigs


def self_join(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, shared, similarity) of every pair a < b of distinct signatures at `threshold` or above. reps: (id, sig)."""
    reps = meeting(cut(reps), threshold)
    prefix = cut(_prefixes(reps, threshold))
    left, right = prefix.select("h", F.col("id").alias("a"), F.col("n").alias("na")), prefix.select("h", F.col("id").alias("b"), F.col("n").alias("nb"))
    near = (F.col("a") < F.col("b")) & near_sizes(threshold)
    return verified(dealt_join(left, right, "a").where(near).select("a", "b").distinct(), reps, reps, threshold)


def linked(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): similar pairs that connect whatever `self_join` would, without all pairs of a cluster.

    Signatures are first held against the smallest that shares a rare hash with them, which ties a cluster of near
    copies to few hubs; then only pairs that these links leave in different components are compared.
    """
    reps = meeting(cut(reps), threshold)
    prefix = cut(_prefixes(reps, threshold).select("h", "id", "n"))
    near = near_sizes(threshold)
    hubs = prefix.groupBy("h").agg(F.min(F.struct("id", "n")).alias("hub")).select("h", F.col("hub.id").alias("a"), F.col("hub.n").alias("na"))
    stars = salted_join(prefix.select("h", F.col("id").alias("b"), F.col("n").alias("nb")), hubs, ["h"], ["b"]).where((F.col("a") < F.col("b")) & near)
    first = cut(verified(stars.select("a", "b").distinct(), reps, reps, threshold).select("a", "b"))
    rooted = components(first)
    held = prefix.join(rooted, F.col("id") == F.col("node"), "left").select("h", "id", "n", F.coalesce("root", "id").alias("root"))
    apart = held.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("h")
    held = cut(held.join(apart, "h", "left_semi"))
    left, right = held.select("h", F.col("id").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra")), held.select("h", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    rest = dealt_join(left, right, "a").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & near).select("a", "b").distinct()
    return first.unionByName(verified(rest, reps, reps, threshold).select("a", "b"))


def cross_join(queries: DataFrame, library: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, shared, similarity): every library row b similar to query row a. Both: (id, sig).

    Only rows with a first hash in common go on (`first_hashes`). Of these, the library hashes that some query has tell how
    rare a query's hashes are. So many of its rarest that a similar row must have one lead to candidates; those that the
    library lacks come first and lead to none.
    """
    return _cross_join(cut(queries.where(F.size("sig") > 0)), cut(library.where(F.size("sig") > 0)), threshold)


def _cross_join(queries: DataFrame, library: DataFrame, threshold: float) -> DataFrame:
    """The same of tables that are cut, or read again at no cost."""
    queries, library = queries.where(F.size("sig") > 0), library.where(F.size("sig") > 0)
    common = common_hashes(library)
    first = cut(first_hashes(queries, common, threshold).select("h", "id"))
    near = cut(first_hashes(library, common, threshold).select("h", "id").join(first.select("h").distinct(), "h", "left_semi"))
    queries, library = _only(queries, first.join(near.select("h").distinct(), "h", "left_semi")), _only(library, near)
    asked = queries.select(F.col("id").alias("a"), F.size("sig").alias("na"), F.explode("sig").alias("h"))
    held = library.select(F.col("id").alias("b"), F.size("sig").alias("nb"), F.explode("sig").alias("h"))
    met = cut(held.join(asked.select("h").distinct(), "h", "left_semi"))
    frequencies = met.groupBy("h").agg(F.count("*").alias("f"))
    known = asked.join(frequencies, "h")
    ordered = known.groupBy("a", "na").agg(F.array_sort(F.collect_list(F.struct("f", "h"))).alias("hs"))
    absent = F.col("na") - F.size("hs")
    rare = F.slice("hs", F.lit(1), F.greatest(prefix_length(F.col("na"), threshold) - absent, F.lit(0)))
    prefix = ordered.select("a", "na", F.explode(rare).alias("e")).select("a", "na", F.col("e.h").alias("h"))
    return verified(dealt_join(met, prefix, "b").where(near_sizes(threshold)).select("a", "b").distinct(), queries, library, threshold)


def first_come(sigs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, kept): taken in the order of their ids, a signature is kept if no kept one before it is similar. sigs: (id, sig), ids unique.

    Rounds settle many at once. Whoever comes first among all that hold one of its rare hashes has no similar one before it
    and is kept; all others of these hashes are held against it, and the similar ones go. Each round compares a
    signature with the first of each of its hashes alone, so near copies cost a round and a row each, not all pairs.
    Once what is open has TOGETHER hashes at most, whatever the corpus, one task takes it in order, in place of many rounds of few rows.
    """
    sigs = _own(sigs)
    settled = _first_come(sigs, threshold)[0]
    return sigs.select("id").join(settled, "id", "left").select("id", F.coalesce("kept", F.lit(True)).alias("kept"))


def come_after(sigs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, shared, similarity) of each signature a that `first_come` lets go with every kept one before it that is similar, found by the rare hashes that it used."""
    return _come_after(_own(sigs), threshold)


def _come_after(sigs: DataFrame, threshold: float, without: DataFrame | None = None) -> DataFrame:
    settled, prefix, held = _first_come(sigs, threshold, without)
    marked = cut(prefix.join(settled, "id"))
    go, stay = (marked.where(F.col("kept") == k).select("h", F.col("id").alias(x), F.col("n").alias(f"n{x}")) for k, x in ((False, "a"), (True, "b")))
    pairs = dealt_join(stay, go, "b").where((F.col("b") < F.col("a")) & near_sizes(threshold)).select("a", "b").distinct()
    return verified(pairs, held, held, threshold)


def _own(sigs: DataFrame) -> DataFrame:
    return cut(sigs.where(F.size("sig") > 0).select("id", "sig"))


def _first_come(sigs: DataFrame, threshold: float, without: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, kept) of the signatures that have a rare hash in common with another; the rare hashes (h, id, n) that they were compared by; and those signatures.

    sigs: cut, or read again at no cost. without: (id) of signatures that take no part.
    """
    compared = held = meeting(sigs, threshold, without)
    open_ = prefix = cut(_prefixes(held, threshold).select("h", "id", "n"))
    settled = open_.select("id", F.lit(True).alias("kept")).limit(0)
    ids, size = cut(open_.select("id", "n").distinct()), held.count()
    while not open_.isEmpty():
        left, hashes = ids.agg(F.count("*"), F.sum("n")).first()
        if hashes <= TOGETHER:
            settled = settled.unionByName(_in_order(open_, _only(held, ids), threshold))
            break
        # the signatures still held against others are written again when half of them have gone, so all rounds write no more than the first
        if left * 2 <= size:
            held, size = _only(held, ids), left
        least = open_.groupBy("h").agg(F.min(F.struct("id", "n")).alias("first"))
        stars = cut(open_.join(least, "h"))
        ready = cut(stars.groupBy("id").agg(F.bool_and(F.col("id") == F.col("first.id")).alias("ready")).where("ready").select("id"))
        near = stars.select(F.col("first.id").alias("a"), F.col("first.n").alias("na"), F.col("id").alias("b"), F.col("n").alias("nb")).where(F.col("a") < F.col("b")).where(near_sizes(threshold))
        met = near.select("a", "b").distinct().join(ready.withColumnRenamed("id", "a"), "a", "left_semi")
        gone = verified(met, held, held, threshold).select(F.col("b").alias("id")).distinct()
        now = cut(ready.withColumn("kept", F.lit(True)).unionByName(gone.withColumn("kept", F.lit(False))))
        settled = settled.unionByName(now)
        # a hash that one signature is left with brings no two together, and a signature left with none is kept
        open_ = open_.join(now.select("id"), "id", "left_anti")
        open_ = cut(open_.join(open_.groupBy("h").agg(F.count("*").alias("f")).where("f > 1").select("h"), "h", "left_semi"))
        ids = cut(open_.select("id", "n").distinct())
    # one that met another, and was left with no hash in common before its turn came, is kept as well
    settled = prefix.select("id").distinct().join(settled, "id", "left").select("id", F.coalesce("kept", F.lit(True)).alias("kept"))
    return settled, prefix, compared


def _in_order(rare: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """(id, kept) of a bounded number of signatures, taken one after the other in one task. rare: (h, id) by which they meet; sigs: (id, sig)."""
    ship(sigs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stay, holders = [], {}
        for batch in batches:
            out = []
            for at in range(batch.num_rows):
                first, sig = (batch.column(c)[at].values.to_numpy(zero_copy_only=False) for c in (1, 2))
                first = first.tolist()
                met = sorted({i for h in first for i in holders.get(h, ())})
                kept = True
                for other in (stay[i] for i in met):
                    if min(len(sig), len(other)) < max(len(sig), len(other)) * threshold - 1e-9:
                        continue
                    place = np.minimum(np.searchsorted(other, sig), len(other) - 1)
                    shared = int(np.count_nonzero(other[place] == sig))
                    if shared / (len(sig) + len(other) - shared) >= threshold:
                        kept = False
                        break
                if kept:
                    for h in first:
                        holders.setdefault(h, []).append(len(stay))
                    stay.append(sig.copy())
                out.append(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.bool_())], ["id", "kept"])

    rows = rare.groupBy("id").agg(F.collect_list("h").alias("first")).join(sigs.select("id", F.sort_array("sig").alias("sig")), "id")
    return cut(rows.select("id", "first", "sig").repartition(1).sortWithinPartitions("id").mapInArrow(run, f"id {sigs.schema['id'].dataType.simpleString()}, kept boolean"))


def dealt_join(rows: DataFrame, others: DataFrame, salt_of: str, key: str = "h", salts: int = SALTS) -> DataFrame:
    """rows joined with others on a key: a key's rows are dealt to several tasks, and the others of the key go to each."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_of), F.lit(salts)).cast("int"))
    copied = others.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copied, [key, "_salt"]).drop("_salt")


def prefix_length(n: Column, threshold: float) -> Column:
    """So many hashes of n that a similar signature must have one of them."""
    return (n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int")


def near_sizes(threshold: float) -> Column:
    """Signatures of na and nb hashes can be similar."""
    return F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, shared, similarity) of the pairs (a, b) at `threshold` or above. left, right: (id, sig), cut; only signatures of pairs move where these are few."""
    pairs = cut(pairs)
    left, right = _asked_for(left, pairs.select(F.col("a").alias("id"))), _asked_for(right, pairs.select(F.col("b").alias("id")))
    rows = pairs.join(left.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(right.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    rows = rows.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("shared"), F.size("sa").alias("na"), F.size("sb").alias("nb"))
    return rows.withColumn("similarity", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).where(F.col("similarity") >= threshold).select("a", "b", "shared", "similarity")


def top_matches(pairs: DataFrame, k: int = 1) -> DataFrame:
    """The k most similar rows of each query, ties to the smaller id, with their rank."""
    order = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
