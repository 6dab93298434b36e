"""Collocations: phrases whose words stand together more often than their parts would by chance.

Texts fall into pieces at punctuation and line ends, and equal pieces of a language are folded into one with a
multiplicity. Each task turns its pieces into n-grams weighted by multiplicity, folds equal ones, and sends them by a
hash of language and n-gram to a bucket, where duckdb counts them out of core: its memory is bounded, and what does
not fit goes to a scratch folder that lives as long as the task. A bucket keeps what stands often enough.

A phrase that counts has no pair of words that counts less, so words and pairs are counted first, and longer n-grams are made
only where every pair in them may be frequent: a filter of fixed size says so for each pair, never wrongly no.
Candidates then ask for the counts of their parts: a request goes to the part's bucket, the answer back to the phrase.

Defined results: a null text has no pieces; a null language is `und`; a piece of any length is one row, cut into
stretches nowhere; repeated rows count each time; ties in score go by count, then by the phrase's bytes; a table without a frequent phrase
gives no rows; only the text and language columns are read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.operators.skew import SALTS, salted_join
from vellum.session import cut, drop_path, publish, shared_path, ship

LONGEST = 5
LEAST = 100
FIRST = 2000
UNKNOWN = "und"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words whose n-grams are folded together before they leave a task, and words for each bucket.
FOLD, BUCKET = 1 << 20, 1 << 22
#: What duckdb may hold of a bucket in memory.
MEMORY = "192MB"
#: Bits of the filter of frequent pairs, whatever the corpus; a pair sets one by each of two halves of its hash.
FILTER_BITS = 25
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
GRAMS = "lang string, gram string, n long"


def pieces(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, times): each distinct piece of a language, its words joined by one space."""
    plain = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER + "\t.,;:!?\x0b\f\r", LOWER + " " + "\n" * 9)
    found = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.explode(F.split(plain, "\n")).alias("piece"))
    found = found.select("lang", F.btrim(F.when(F.col("piece").contains("  "), F.regexp_replace("piece", " +", " ")).otherwise(F.col("piece")), F.lit(" ")).alias("piece"))
    return found.where("piece != ''").groupBy("lang", "piece").agg(F.count("*").alias("times"))


def _hashes(values: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, values.to_pylist()), np.uint64, len(values))


def _pair(lang: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The hash of a pair of words in a language."""
    x = (lang * ODD[0] + first) * ODD[1]
    x = ((x ^ (x >> np.uint64(29))) + second) * ODD[2]
    return x ^ (x >> np.uint64(32))


def _bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64), (hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


class Stretch:
    """The words of many pieces as numbers; `left` is how many words of its piece a word has from itself on."""

    def __init__(self, langs: pa.Array, found: pa.Array, times: np.ndarray):
        lists = pc.split_pattern(found, " ")
        words = lists.flatten().dictionary_encode()
        langs = langs.dictionary_encode()
        self.langs, self.vocabulary = langs.dictionary, words.dictionary
        self.word = words.indices.to_numpy().astype(np.int64)
        lengths = lists.value_lengths().to_numpy().astype(np.int64)
        self.lang = np.repeat(langs.indices.to_numpy().astype(np.int64), lengths)
        self.times = np.repeat(times, lengths).astype(np.float64)
        self.left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(self.word))

    def grams(self, sizes: range, allowed: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """The distinct n-grams of these sizes with their weights. allowed: the filter that each pair in them has to pass."""
        width = len(self.vocabulary)
        starts, number, chain = np.arange(len(self.word)), None, None
        good = self._good(allowed) if allowed is not None else None
        for size in range(1, sizes.stop):
            stay = self.left[starts] >= max(size, sizes.start)
            if good is not None:  # from the first size on, every pair that the shortest n-gram has
                for at in range(max(size, sizes.start) - 1):
                    stay[stay] = good[starts[stay] + at]
            starts = starts[stay]
            before = self.lang[starts] if number is None else number[stay]
            number, distinct = pd.factorize(before * width + self.word[starts + size - 1])
            chain = (distinct // width, distinct % width, chain)
            if size in sizes and len(distinct):
                yield from self._rows(chain, size, np.bincount(number, self.times[starts], len(distinct)))

    def _good(self, allowed: np.ndarray) -> np.ndarray:
        """Whether the pair that starts at a word passes the filter."""
        lang, word = _hashes(self.langs)[self.lang], _hashes(self.vocabulary)[self.word]
        ok = np.zeros(len(word), bool)
        if len(word) > 1:
            one, two = _bits(_pair(lang[:-1], word[:-1], word[1:]))
            ok[:-1] = (self.left[:-1] > 1) & ((allowed[one >> 3] >> (one & 7)) & (allowed[two >> 3] >> (two & 7)) & 1).astype(bool)
        return ok

    def _rows(self, chain: tuple, size: int, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
        """In an order in which n-grams with the same beginning follow each other, so that the shuffle packs them well."""
        order = np.lexsort((chain[1], chain[0]))
        for at in range(0, len(order), 1 << 16):
            here = order[at : at + (1 << 16)]
            words, step, rows = [], chain, here
            while step is not None:
                words.append(self.vocabulary.take(pa.array(step[1][rows])))
                rows, step = step[0][rows], step[2]
            gram = words[0] if size == 1 else pc.binary_join_element_wise(*reversed(words), pa.scalar(" ", words[0].type))
            yield pa.RecordBatch.from_arrays([self.langs.take(pa.array(rows)), gram, pa.array(weights[here].astype(np.int64))], ["lang", "gram", "n"])


def grams(folded: DataFrame, sizes: range, pairs: str | None = None) -> DataFrame:
    """Weighted n-grams, folded within stretches of FOLD words; several rows of an n-gram may remain. pairs: the published filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = np.memmap(SparkFiles.get(pairs), "u1", "r") if pairs else None
        held, words = [], 0

        def fold() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            lang, piece = (table[c].chunk(0).cast(pa.large_string()) for c in ("lang", "piece"))
            yield from Stretch(lang, piece, table["times"].to_numpy()).grams(sizes, allowed)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                words += batch.num_rows + pc.sum(pc.count_substring(batch.column(1), " ")).as_py()
            if words >= FOLD:
                yield from _small(fold())
                held, words = [], 0
        if held:
            yield from _small(fold())

    return folded.select("lang", "piece", "times").mapInArrow(run, GRAMS)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
    for batch in batches:
        yield batch.cast(kinds)


def frequent(counted: DataFrame, buckets: int, least: int) -> DataFrame:
    """(lang, gram, size, n) of the n-grams that stand `least` times or more, counted by duckdb in each hash bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        import duckdb

        def chained() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        with tempfile.TemporaryDirectory(prefix="vellum-scratch-") as scratch:
            con = duckdb.connect(config={"memory_limit": MEMORY, "temp_directory": scratch, "threads": 1, "preserve_insertion_order": False})
            rows = pa.RecordBatchReader.from_batches(first.schema, chained())  # noqa: F841
            made = con.sql(f"SELECT lang, gram, CAST(sum(n) AS BIGINT) AS n FROM rows GROUP BY lang, gram HAVING sum(n) >= {least}")
            yield from made.to_arrow_reader(1 << 16)
            con.close()

    held = counted.repartition(buckets, "lang", "gram").mapInArrow(run, GRAMS)
    return held.select("lang", "gram", (F.length("gram") - F.length(F.translate("gram", " ", "")) + 1).alias("size"), "n")


def pair_filter(pairs: DataFrame) -> str:
    """Publish the filter of these pairs (lang, gram): 2^FILTER_BITS bits, of which the words that are not 0 come to the driver."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pc.split_pattern(batch.column(1), " ").flatten()
            hashes = _hashes(words)
            for bits in _bits(_pair(_hashes(batch.column(0)), hashes[::2], hashes[1::2])):
                yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array((np.uint64(1) << (bits & 63).astype(np.uint64)).view(np.int64))], ["place", "mask"])

    made = pairs.select("lang", "gram").mapInArrow(marks, "place long, mask long").groupBy("place").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 6, np.int64)
    bits[made["place"].to_numpy()] = made["mask"].to_numpy()
    return publish(pairs.sparkSession, bits.astype("<i8").tobytes(), ".pairs")[0]


def _score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 a n / (l r)), exactly, in decimal numbers of 38 digits."""
    big = lambda name: f"CAST({name} AS DECIMAL(19, 0))"
    return F.expr(f"CAST(1000 AS DECIMAL(4, 0)) * {big(a)} * {big(n)} div ({big(left)} * {big(right)})")


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, n, score) of every candidate: its lowest-scoring cut, the shortest first part among equals."""
    candidates = counts.where("size > 1").select("lang", F.col("gram").alias("phrase"), "size", F.col("n").alias("a"))
    words = F.split("phrase", " ")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    asked = cuts.select(
        "*",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("side"), F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("gram")),
                F.struct(F.lit(1).alias("side"), F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("gram")),
            )
        ).alias("part"),
    ).select("lang", "phrase", "size", "a", "k", "part.side", "part.gram")
    answers = salted_join(asked, counts.select("lang", "gram", "n"), ["lang", "gram"], ["phrase", "k", "side"])
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("n")))
    held = answers.groupBy("lang", "phrase", "size", "a", "k").agg(side(0).alias("l"), side(1).alias("r"))
    held = salted_join(held, totals, ["lang"], ["phrase"]).withColumn("score", _score("a", "n", "l", "r"))
    lowest = held.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    return lowest.select("lang", "phrase", "size", "a", "low.l", "low.r", "n", "low.score")


def undominated(found: DataFrame) -> DataFrame:
    """Candidates without a longer candidate around them that stands as often."""
    words = F.split("phrase", " ")
    inner = found.where("size > 2").select("lang", words.alias("words"), "size", "a")
    inner = inner.select("*", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("length"))
    inner = inner.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)).alias("at"))
    longer = inner.groupBy("lang", F.array_join(F.slice("words", F.col("at"), F.col("length")), " ").alias("phrase")).agg(F.max("a").alias("most"))
    return found.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * 100)).drop("most")


def first_of_each(found: DataFrame, first: int) -> DataFrame:
    """Each language's first rows with their rank: those of each share of a language, then those of the shares together."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    dealt = found.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(4 * SALTS)))
    dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("rank") <= first).drop("_share")
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of 2 to `longest` words that stand `least` times or more."""
    spark = df.sparkSession
    ship(spark)
    path = shared_path(spark, "pieces")
    pieces(df, text_col, lang_col).write.parquet(path)
    folded = spark.read.parquet(path)
    n = F.length("piece") - F.length(F.translate("piece", " ", "")) + 1
    totals = cut(folded.groupBy("lang").agg(F.sum(F.col("times") * n).alias("n")))
    words = totals.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), words // BUCKET)
    short = cut(frequent(grams(folded, range(1, 3)), buckets, least))
    pairs = pair_filter(short.where("size = 2"))
    long = cut(frequent(grams(folded, range(3, longest + 1), pairs), buckets, least))
    drop_path(spark, path)
    found = cut(scored(short.unionByName(long), totals))
    return first_of_each(undominated(found), first)


ORACLE_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang,
         regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words
  FROM documents),
w AS (SELECT lang, words, count(*) AS times FROM p WHERE len(words) > 0 GROUP BY ALL),
t AS (SELECT lang, CAST(sum(times * len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
i AS (SELECT lang, words, times, k, unnest(range(1, len(words) - k + 2)) AS pos FROM w, range(1, {LONGEST + 1}) s(k)),
c AS (SELECT lang, words[pos : pos + k - 1] AS gram, CAST(sum(times) AS BIGINT) AS f FROM i GROUP BY ALL HAVING sum(times) >= {LEAST}),
k AS (SELECT lang, gram, f, unnest(range(1, len(gram))) AS k FROM c WHERE len(gram) > 1),
s AS (SELECT k.lang, k.gram, k.f AS a, k, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * k.f * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
      FROM k JOIN c x ON x.lang = k.lang AND x.gram = k.gram[1:k] JOIN c y ON y.lang = k.lang AND y.gram = k.gram[k + 1:] JOIN t ON t.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1),
z AS (SELECT lang, gram, f, length, unnest(range(1, len(gram) - length + 2)) AS pos FROM c, range(2, {LONGEST}) q(length) WHERE len(gram) > length),
d AS (SELECT lang, gram[pos : pos + length - 1] AS gram, max(f) AS most FROM z GROUP BY ALL),
o AS (SELECT b.lang, array_to_string(b.gram, ' ') AS phrase, a, l, r, n, score FROM b LEFT JOIN d ON d.lang = b.lang AND d.gram = b.gram
      WHERE most IS NULL OR 100 * most < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM o QUALIFY rank <= {FIRST}
"""
