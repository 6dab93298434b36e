"""Mixing sources to target weights by hash-threshold histograms.

Each source's words are summed by hash bucket. Running sums over a source's few thousand buckets
find the bucket in which its budget ends; only that bucket's rows are summed again, by the next bits,
and so on. A row is then taken once more than its source's whole copies where its hash is below the
source's threshold. Nothing is sorted but buckets, and a rerun finds the same thresholds.

Sources are put in order, and their targets found, in windows over a row for each source; one source's buckets,
4,096 at most a level, meet in one task. Texts never do.

A row's hash is made from its id and its text, so rows without an id, or with one that repeats, are taken one by
one. Rows that have words and are equal in id, text and source are counted from 0, and the count enters their hash: which of
them is taken more often does not matter, how many are is the same in every run.

Defined results: a null text has size 0; a very long text is split into its words in one row; null is a source of
its own, last in order; an empty table gives an empty result; a source without words
has target 0; extra columns are carried by `apply_mix` and ignored by `plan_mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.llm import texts
from vellum.operators.skew import salted_join
from vellum.session import cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
HASH_BITS = 60
LEVEL_BITS = 12
LEVELS = 3
#: Sources up to which their table of a row each (under 100 bytes) is broadcast; beyond, it is joined by key.
BROADCAST_SOURCES = 20_000


def _hash(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def hash60(id_column: Column, text: Column) -> Column:
    """Of an id and a text; equal rows share it until `tell_apart`."""
    return _hash(F.concat_ws("|", F.coalesce(id_column.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def _key() -> Column:
    return F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"), "h")


def repeated(rows: DataFrame) -> DataFrame | None:
    """The (source, h) that several rows with words have; None where there are none."""
    found = cut(rows.where("size > 0").groupBy(_key().alias("_key")).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    return None if found.isEmpty() else found


def tell_apart(held: DataFrame, again: DataFrame | None) -> DataFrame:
    """held, a written table with (source, h), where rows of a repeated (source, h) get a hash for each by their number.

    A key's rows are numbered within each partition of the table and start after those of the partitions before it, so
    a key with a third of all rows meets in no task; only a count for each partition does.
    """
    if again is None:
        return held
    place = held.withColumn("_place", F.monotonically_increasing_id()).withColumn("_key", _key())
    marked = salted_join(place, again.withColumn("_again", F.lit(True)), ["_key"], ["_place"], "left").withColumn("_part", F.shiftright("_place", 33))
    many = marked.where("_again")
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = many.groupBy("_key", "_part").agg(F.count("*").alias("_n")).select("_key", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = many.withColumn("_at", F.row_number().over(Window.partitionBy("_key", "_part").orderBy("_place")) - 1)
    number = F.col("_start") + F.col("_at")
    numbered = within.join(starts, ["_key", "_part"]).withColumn("h", F.when(number > 0, _hash(F.concat_ws("#", "h", number))).otherwise(F.col("h")))
    return numbered.select(*held.columns).unionByName(marked.where("_again IS NULL").select(*held.columns))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> also weight and target, by filling each source up to its cap in order of cap over weight."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("room", F.col("source_size") * cap).withColumn("level", F.col("room") / F.col("weight"))
    filled = Window.orderBy("level", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    sums = ranked.select(
        "*",
        F.coalesce(F.sum("room").over(filled), F.lit(0)).alias("before"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0))).alias("open_weight"),
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("budget"),
    )
    reached = F.col("before") + F.col("level") * F.col("open_weight") >= F.col("budget")
    lam = F.min(F.when(reached, F.struct("level", "before", ((F.col("budget") - F.col("before")) / F.col("open_weight")).alias("lam")))).over(everything)
    return sums.select("source", "source_size", "weight", F.least(F.col("room").cast("double"), lam["lam"] * F.col("weight")).alias("target"))


def _beside(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Rows with what is known of their source: broadcast where the sources are counted to be few, else by a join that deals a hot source out."""
    if few:
        held = sources.withColumnRenamed("source", "of")
        return rows.join(F.broadcast(held), rows["source"].eqNullSafe(held["of"])).drop("of")
    mark = lambda df: df.withColumn("_key", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")))
    return salted_join(mark(rows), mark(sources).drop("source"), ["_key"], ["h"]).drop("_key")


def thresholds(rows: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> tuple[DataFrame, bool]:
    """rows: (source, h, size). A row for each source: its size, target, whole copies and hash threshold; and whether they are few."""
    low, high = rows, HASH_BITS
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    state = targets(sizes, weights, share, cap)
    copies = F.when(F.col("source_size") == 0, 1).when(F.col("target") >= 2 * F.col("source_size"), 2).when(F.col("target") >= F.col("source_size"), 1).otherwise(0)
    state = state.withColumn("copies", copies).withColumn("need", F.col("target") - F.col("copies") * F.col("source_size"))
    state = cut(state.withColumn("open", (F.col("need") > 0) & (F.col("source_size") > 0)).withColumn("prefix", F.lit(0).cast("long")))
    few = state.count() <= BROADCAST_SOURCES
    for level in range(LEVELS):
        shift = high - LEVEL_BITS
        inside = _beside(low, state.select("source", "need", "prefix", "open"), few).where(F.col("open") & (F.shiftright("h", high) == F.col("prefix")))
        sums = inside.groupBy("source", "need", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        running = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("n").over(running)).where(F.col("upto") > F.col("need"))
        edge = sums.groupBy("source").agg(F.min(F.struct("bucket", "upto", "n")).alias("edge"))
        edge = edge.select(F.col("source").alias("of"), F.col("edge.bucket").alias("bucket"), F.col("edge.upto").alias("upto"), F.col("edge.n").alias("n"))
        joined = state.join(edge, state["source"].eqNullSafe(edge["of"]), "left")
        found = F.col("open") & F.col("bucket").isNotNull()
        past = (F.col("prefix") + 1) * (1 << LEVEL_BITS)  # all of the bucket fits
        prefix = F.when(found, F.col("bucket")).when(F.col("open"), past).otherwise(F.col("prefix") * (1 << LEVEL_BITS))
        need = F.when(found, F.col("need") - (F.col("upto") - F.col("n"))).otherwise(F.col("need"))
        if level == LEVELS - 1:  # the last bucket is taken where that comes nearer
            prefix = F.when(found & (F.col("n") - need < need), prefix + 1).otherwise(prefix)
        state = cut(joined.select("source", "source_size", "weight", "target", "copies", need.alias("need"), found.alias("open"), prefix.alias("prefix")))
        high = shift
    return state.select("source", "source_size", "target", "copies", (F.col("prefix") * (1 << high)).alias("threshold")), few


def _rows(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    id_, text = F.col(id_col), F.col(text_col)
    return df.select(id_.alias("id"), F.col(source_col).cast("string").alias("source"), hash60(id_, text).alias("h"), texts.n_words(text).alias("size"))


def plan_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """(id, size, source_size, target, taken, copies) of every row."""
    rows = cut(_rows(df, id_col, text_col, source_col))
    rows = tell_apart(rows, repeated(rows))
    sources, few = thresholds(rows, weights, share, cap)
    copies = (F.col("copies") + (F.col("h") < F.col("threshold")).cast("int")).cast("long")
    return _beside(rows, sources, few).select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def apply_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """The mixed table: the input's columns, each row as often as the mix takes it. Where rows are equal the input is written once, for their numbers to stay."""
    plain = cut(_rows(df, id_col, text_col, source_col))
    again = repeated(plain)
    sources, few = thresholds(tell_apart(plain, again), weights, share, cap)
    rows = df.select(F.struct("*").alias("row"), F.col(source_col).cast("string").alias("source"), hash60(F.col(id_col), F.col(text_col)).alias("h"))
    rows = rows if again is None else tell_apart(cut(rows), again)
    copies = F.col("copies") + (F.col("h") < F.col("threshold")).cast("int")
    return _beside(rows, sources, few).select(F.explode(F.array_repeat(F.col("row"), copies.cast("int"))).alias("row")).select("row.*")


ORACLE_SQL = """
WITH g AS (
  SELECT doc_id, source, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
-- rows that are equal are counted, and the count enters their hash
k AS (SELECT *, row_number() OVER (PARTITION BY source, h, size > 0 ORDER BY doc_id, size) - 1 AS number FROM g),
d AS (SELECT doc_id, source, size,
             CASE WHEN size > 0 AND number > 0 THEN CAST('0x' || substr(md5(h || '#' || number), 1, 15) AS BIGINT) ELSE h END AS h FROM k),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
r AS (SELECT *, 2 * source_size AS room, (2 * source_size) / CAST(weight AS DOUBLE) AS level FROM w),
f AS (SELECT *, coalesce(sum(room) OVER o, 0) AS before, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS open_weight,
             CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget
      FROM r WINDOW o AS (ORDER BY level, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT (budget - CAST(before AS DOUBLE)) / CAST(open_weight AS DOUBLE) AS lam FROM f
      WHERE CAST(before AS DOUBLE) + level * CAST(open_weight AS DOUBLE) >= budget ORDER BY level, before LIMIT 1),
t AS (SELECT source, source_size, least(CAST(room AS DOUBLE), lam * weight) AS target FROM f, l),
c AS (SELECT *, CASE WHEN source_size = 0 THEN 1 WHEN target >= 2 * source_size THEN 2 WHEN target >= source_size THEN 1 ELSE 0 END AS copies FROM t),
n AS (SELECT *, target - copies * source_size AS need FROM c),
-- a threshold at the finest bucket: all before it fit, and it is taken where that comes nearer
b AS (SELECT source, h >> 24 AS bucket, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY bucket) AS upto FROM b),
e AS (SELECT n.source, arg_min(CASE WHEN u.n - (need - (upto - u.n)) < need - (upto - u.n) THEN bucket + 1 ELSE bucket END, bucket) AS edge
      FROM n JOIN u ON u.source IS NOT DISTINCT FROM n.source WHERE need > 0 AND source_size > 0 AND upto > need GROUP BY n.source)
SELECT doc_id, size, n.source_size, n.target,
       size * (copies + CASE WHEN e.edge IS NOT NULL AND (h >> 24) < e.edge THEN 1 ELSE 0 END) AS taken,
       CAST(copies + CASE WHEN e.edge IS NOT NULL AND (h >> 24) < e.edge THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
