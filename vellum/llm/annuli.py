"""Vector codes of product codebooks, with nearest entries found by annular norm pruning.

Vectors of integers floor(256 x) are cut into 16 parts, and each part position has a codebook of up to 64 entries. The
entries stand sorted by norm. A part's distance to its neighbours by norm gives a first best; an entry can only be as
near if its norm differs from the part's by no more than that, so a binary search finds the interval of norms that the
best allows, both ends included, and every entry of this annulus is evaluated exactly, in integers.

Each round is one map over the vectors that leaves sums and counts for each entry and partition, summed by Spark; the
codebooks, at most 64 entries for each of 16 positions, go to the tasks with the plan. Vectors never meet.

Defined results: rows whose vector is null, empty, or holds null or non-finite components are dropped; of the rest, those
whose length differs from that of the smallest kept id too; a length that is no multiple of 16 is filled up with
zeros. Integers are held within +-2^24 (components beyond +-65,536), so that sums of squares of up to 4,096 fit 64 bits.
Null ids come last among the starting entries, of equal ids the lesser vector comes first; equal entries are told by
their index, and the lower one is taken; a table without a kept row gives no rows. Repeated rows are coded each;
only the id, vector and label columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators.skew import SALTS, salted_join
from vellum.session import cut, ship

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
BOUND = 1 << 24
#: Vectors that are coded at once.
BLOCK = 4096
#: Norms are rounded, so an annulus is widened by this share of its radius.
SLACK = 1e-9


class Codebook:
    """One position's entries, an integer matrix, sorted by norm for the search."""

    def __init__(self, entries: np.ndarray):
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.entries = norms[self.order], entries[self.order]

    def _distance(self, parts: np.ndarray, at: np.ndarray) -> np.ndarray:
        gap = parts - self.entries[at]
        return np.einsum("ij,ij->i", gap, gap)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of each part, the lowest index among equals; its squared distance; how many distances were taken."""
        n, last = len(parts), len(self.norms) - 1
        norms = np.sqrt((parts.astype(np.float64) ** 2).sum(1))
        place = np.searchsorted(self.norms, norms)
        best = np.minimum(self._distance(parts, np.minimum(place, last)), self._distance(parts, np.maximum(place - 1, 0)))
        radius = np.sqrt(best.astype(np.float64))
        slack = SLACK * (radius + norms + 1)
        low = np.searchsorted(self.norms, norms - radius - slack, "left")
        high = np.searchsorted(self.norms, norms + radius + slack, "right")
        sizes = high - low  # one at least: the entry that gave the best
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(n), sizes)
        at = np.arange(int(sizes.sum())) - starts[owner] + low[owner]
        distance = self._distance(parts[owner], at)
        least = np.minimum.reduceat(distance, starts)
        index = np.where(distance == least[owner], self.order[at], len(self.order))
        return np.minimum.reduceat(index, starts), least, int(sizes.sum()) + 2 * n


def whole(vectors: pa.Array, width: int) -> np.ndarray:
    """The integer vectors of a list column, without null or lengths that differ, filled up to a multiple of PARTS."""
    values = np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), width)
    made = np.clip(np.floor(SCALE * values), -BOUND, BOUND).astype(np.int64)
    return np.pad(made, ((0, 0), (0, -width % PARTS)))


def kept(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, DataFrame, int]:
    """(id, vector, label) of the rows that count; those that the codebooks start from; and the vectors' length."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)
    order = [F.col("id").asc_nulls_last(), F.transform("vector", lambda x: F.floor(x * SCALE))]
    first = rows.orderBy(*order).select(F.size("vector").alias("n")).limit(1).collect()
    width = first[0]["n"] if first else PARTS
    rows = rows.where(F.size("vector") == width)
    return rows, rows.orderBy(*order).limit(ENTRIES).select("vector"), width


def _start(seeds: DataFrame, width: int) -> list[np.ndarray]:
    """At most ENTRIES rows come to the driver."""
    found = [r["vector"] for r in seeds.collect()]
    vectors = whole(pa.array(found, pa.list_(pa.float64())), width)
    return [part.copy() for part in np.split(vectors, PARTS, axis=1)]


def _refine(rows: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Each entry becomes the floored mean of the parts that are nearest to it; an entry that none is nearest to stays."""
    step = books[0].shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Codebook(b) for b in books]
        count, total = np.zeros((PARTS, len(books[0])), np.int64), np.zeros((PARTS, len(books[0]), step), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                vectors = whole(batch.column(0).slice(at, BLOCK), width)
                for p, part in enumerate(np.split(vectors, PARTS, axis=1)):
                    entry = search[p].nearest(part)[0]
                    count[p] += np.bincount(entry, minlength=len(books[p]))
                    np.add.at(total[p], entry, part)
        p, entry = np.nonzero(count)
        for i in range(step):
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(entry), pa.array(np.full(len(p), i)), pa.array(total[p, entry, i]), pa.array(count[p, entry])], ["part", "entry", "place", "total", "n"])

    made = rows.select("vector").mapInArrow(sums, "part long, entry long, place long, total long, n long")
    made = made.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    books = [b.copy() for b in books]
    for r in made.collect():  # a row for each integer of the codebooks at most
        books[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return books


def codebooks(rows: DataFrame, seeds: DataFrame, width: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The final entries of each position."""
    ship(rows.sparkSession)
    books = _start(seeds, width)
    for _ in range(rounds if len(books[0]) else 0):
        books = _refine(rows, books, width)
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all integers by part, entry and position within the part."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """(id, label, code, error, evaluated): two hex digits for each part, the squared distances' sum, and how many distances were taken."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Codebook(b) for b in books]
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = batch.slice(at, BLOCK)
                vectors = whole(block.column(1), width)
                error, codes, taken = np.zeros(len(vectors), np.int64), np.zeros((len(vectors), PARTS), np.uint8), 0
                for p, part in enumerate(np.split(vectors, PARTS, axis=1)):
                    entry, least, n = search[p].nearest(part)
                    codes[:, p] = entry
                    error += least
                    taken += n
                text = codes.tobytes().hex()
                texts = [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]
                evaluated = np.diff(np.linspace(0, taken, len(vectors) + 1).astype(np.int64))
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(2), pa.array(texts, pa.string()), pa.array(error), pa.array(evaluated)], ["id", "label", "code", "error", "evaluated"])

    return rows.select("id", "vector", "label").mapInArrow(run, f"id {kind['id']}, label {kind['label']}, code string, error long, evaluated long")


def summary(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every kept row. A hot label is dealt out where its error is put beside its rows."""
    rows, seeds, width = kept(df, id_col, vector_col, label_col)
    books = codebooks(rows, seeds, width)
    if not len(books[0]):
        return rows.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    key = F.struct(F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("name"))
    coded = cut(encode(rows, books, width)).withColumn("_label", key)
    dealt = coded.groupBy("_label", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).alias("salt")).agg(F.sum("error").alias("error"))
    errors = dealt.groupBy("_label").agg(F.sum("error").alias("label_error"))
    joined = salted_join(coded, errors, ["_label"], ["id", "code"])
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle_sql(rounds: int = ROUNDS) -> str:
    """Every part held against every entry, for tables whose vectors have one length, a multiple of PARTS."""
    head = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, len(embedding) // {PARTS} AS w,
         list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT rid, CAST(p AS INTEGER) AS part, list_slice(v, p * w + 1, (p + 1) * w) AS q FROM kept, range({PARTS}) t(p)),
book0 AS (SELECT part, CAST(rid - 1 AS INTEGER) AS entry, q AS c FROM parts WHERE rid <= {ENTRIES}),"""
    nearest = """
near{r} AS (
  SELECT rid, part, min(d) AS d, arg_min(entry, d * 64 + entry) AS entry
  FROM (SELECT rid, parts.part, entry, CAST(list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
        FROM parts JOIN book{r} ON parts.part = book{r}.part)
  GROUP BY rid, part),"""
    renew = """
sum{r} AS (
  SELECT part, entry, i, CAST(sum(q[i]) AS BIGINT) AS s, count(*) AS n
  FROM near{r} JOIN parts USING (rid, part), LATERAL (SELECT unnest(range(1, len(q) + 1)) AS i) GROUP BY ALL),
mean{r} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM sum{r} GROUP BY part, entry),
book{n} AS (SELECT part, entry, coalesce(mean{r}.c, book{r}.c) AS c FROM book{r} LEFT JOIN mean{r} USING (part, entry)),"""
    steps = "".join(nearest.format(r=r) + renew.format(r=r, n=r + 1) for r in range(rounds))
    tail = f"""
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds}),
coded AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (rid), digest
"""
    return head + steps + nearest.format(r=rounds) + tail
