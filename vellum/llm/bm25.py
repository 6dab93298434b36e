"""Exact top-k search: BM25 over sharded inverted indexes with block-max WAND.

Each task turns the rows it reads into shards of at most SHARD_DOCS rows: sorted terms, postings by term,
lengths. The index is a Parquet table in the shared folder, a row for each shard. Queries come in blocks
of bounded size, whatever their number: a block's terms get their document counts from all shards, and
every shard then answers the whole block under those global statistics, so that merging the shards' best
k by score gives exactly the best k of the corpus. Each block's answer is appended to one table.

Inside a shard each term in COMMON of the rows keeps its largest contribution to every block of BLOCK_DOCS rows, and
each rarer one its largest to the shard. For a query these sum to an upper bound for each block, and a shard without a block
whose bound reaches the query's k-th score so far is skipped. Queries are whole texts of hundreds of terms, and a text
shares frequent words with every other, so bounds over all terms leave most blocks; what prunes is their order. Rare terms
give their part to all rows from posting lists, and terms in COMMON of the rows from arrays with a place for every row,
the rarest group first. Before each group a row stays only if its score so far and its block's bound for the groups still
to come reach the k-th score; the most frequent terms are thus read for few rows. Partial scores are scores that k rows have
at least, so they raise the k-th score where a task has none yet. A task carries the scores on from shard to shard.
Contributions are rounded to whole millionths, so sums do not depend on order and bounds are exact; they are held in 32
bits, and in 64 for a query whose bound does not fit.

score(q, d) = sum over q's distinct terms of round(1e6 * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)))
/ 1e6, with idf = ln(1 + (N - df + 0.5) / (df + 0.5)). Terms: runs of 0-9, a-z after lower-casing A-Z, and
everything outside ASCII. Ties go to the smaller id.

Defined results: ids are whole numbers; null and empty texts have no terms, are found by no query, and find
nothing as queries; a row that shares no term with a query is not returned; a very long text is indexed and asked
by all its terms, and takes the memory of its words while that is done; repeated rows are rows of their own, on
either side; an empty table gives an empty result; null ids are found, and come first among ties; extra columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.llm.licenses import joined
from vellum.session import cut, shared_path, ship

K1, B = 1.2, 0.75
UNIT = 1_000_000
SHARD_DOCS, SHARD_WORDS = 8_192, 8_000_000
BLOCK_DOCS = 32
QUERIES_TOGETHER = 64
#: Groups of common terms, by the share of a shard's rows that have them at least; terms that are kept as arrays at most.
COMMON, MOST_ARRAYS = (1 / 4, 1 / 8, 1 / 24), 4_096
#: Before this group, partial scores raise the least score; rows are taken one by one once fewer than one in FEW are left.
RAISED, FEW = 1, 8
QUERIES_AT_ONCE, CHARACTERS_AT_ONCE = 4_096, 16_000_000

_INDEX = "n_docs int, n_words long, ids binary, known binary, lengths binary, n_terms int, terms binary, ends binary, offsets binary, docs binary, freqs binary"


def terms_of(text: str | None) -> list[bytes]:
    return joined(text)[1:-1].split(b" ") if text else []


class _Shard:
    """Rows gathered for one shard."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.numbers: dict[bytes, int] = {}
        self.terms: list[np.ndarray] = []
        self.freqs: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.words = 0

    def add(self, doc: int | None, text: str | None) -> None:
        counts = Counter(t for t in terms_of(text) if t)
        number = self.numbers
        self.terms.append(np.fromiter((number.setdefault(t, len(number)) for t in counts), np.int32, len(counts)))
        self.freqs.append(np.fromiter(counts.values(), np.int32, len(counts)))
        self.sizes.append(len(counts))
        self.ids.append(doc)
        self.lengths.append(int(self.freqs[-1].sum()))
        self.words += self.lengths[-1]

    def row(self) -> pa.RecordBatch:
        names = sorted(self.numbers)
        place = np.empty(len(names), np.int32)
        place[[self.numbers[t] for t in names]] = np.arange(len(names), dtype=np.int32)
        terms = place[np.concatenate(self.terms)] if names else np.zeros(0, np.int32)
        docs = np.repeat(np.arange(len(self.ids), dtype=np.uint16), self.sizes)
        order = np.argsort(terms, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(names)))]).astype(np.int32)
        freqs = np.concatenate(self.freqs)[order] if names else np.zeros(0, np.int32)
        ends = np.cumsum([len(t) for t in names], dtype=np.int32)
        values = [len(self.ids), self.words, np.array([i or 0 for i in self.ids], np.int64).tobytes(), np.array([i is not None for i in self.ids], np.uint8).tobytes(), np.array(self.lengths, np.int32).tobytes(), len(names), b"".join(names), ends.tobytes(), offsets.tobytes(), docs[order].tobytes(), freqs.tobytes()]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [x.split(" ")[0] for x in _INDEX.split(", ")])


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Writes the shards of every row to `path` (the shared folder's, by default) and returns them as a table."""
    spark = df.sparkSession
    ship(spark)
    path = path or shared_path(spark, "bm25")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                shard.add(doc.as_py(), text.as_py())
                if len(shard.ids) >= SHARD_DOCS or shard.words >= SHARD_WORDS:
                    yield shard.row()
                    shard = _Shard()
        if shard.ids:
            yield shard.row()

    df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _INDEX).write.parquet(path)
    return spark.read.schema(_INDEX).parquet(path)


def query_terms(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, terms array<binary>, characters) of every query row."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(terms_of(x.as_py())) - {b""}) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary())), pa.array([sum(map(len, t)) for t in terms], pa.int64())], ["query_id", "terms", "characters"])

    return df.select(F.col(id_col).cast("long").alias("query_id"), F.col(text_col).alias("text")).mapInArrow(run, "query_id long, terms array<binary>, characters long")


def _numbered(row: dict, numbers: dict[bytes, int]) -> np.ndarray:
    """Of each of a shard's terms: its number among a block's terms, which are numbered in their order; -1 for one that no query has."""
    offsets = np.concatenate([[0], np.frombuffer(row["ends"], np.int32)]).astype(np.int32)
    names = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(row["terms"])])
    return pc.index_in(names, value_set=pa.array(list(numbers), pa.binary())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + size), one after another."""
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - before, sizes)


#: No score yet: scores, ids (0 for none), and whether there is an id.
NOTHING = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))


class Searcher:
    """One shard, prepared for a block of queries: arrays of their common terms, postings of the others, and the largest contributions of both."""

    def __init__(self, row: dict, numbers: dict[bytes, int], idf: np.ndarray, average: float):
        self.ids, self.known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], np.uint8).astype(bool)
        lengths = np.frombuffer(row["lengths"], np.int32)
        offsets = np.frombuffer(row["offsets"], np.int32).astype(np.int64)
        wanted = _numbered(row, numbers)
        here = np.flatnonzero(wanted >= 0)
        here = here[np.argsort(offsets[here] - offsets[here + 1], kind="stable")]  # most frequent ones first
        sizes = (offsets[1:] - offsets[:-1])[here]
        self.groups = [min(int((sizes >= len(self.ids) * share).sum()), MOST_ARRAYS) for share in COMMON]  # where each ends
        self.n_common = n_common = self.groups[-1]
        self.place = np.full(len(idf), -1, np.int64)  # of a block's term: its number in this shard
        self.place[wanted[here]] = np.arange(len(here))
        take = _runs(offsets[:-1][here], sizes)
        docs = np.frombuffer(row["docs"], np.uint16)[take]
        tf = np.frombuffer(row["freqs"], np.int32)[take].astype(np.float64)
        idfs = np.repeat(idf[wanted[here]], sizes)
        gain = np.rint(UNIT * idfs * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[docs] / average)))
        self.n_blocks = (len(self.ids) + BLOCK_DOCS - 1) // BLOCK_DOCS
        dense = int(sizes[:n_common].sum())
        self.rows = np.zeros((n_common, self.n_blocks * BLOCK_DOCS), np.int32)
        self.rows[np.repeat(np.arange(n_common), sizes[:n_common]), docs[:dense]] = gain[:dense]
        self.most = self.rows.reshape(n_common, self.n_blocks, BLOCK_DOCS).max(2).astype(np.float64)
        self.docs, self.gain, self.size = docs[dense:], gain[dense:].astype(np.int32), sizes[n_common:]
        self.start = np.cumsum(self.size) - self.size
        self.list_most = np.maximum.reduceat(self.gain, self.start) if len(self.start) else np.zeros(0)

    def best(self, queries: list[np.ndarray], k: int, tops: list[tuple]) -> list[tuple]:
        """For each query the best k of this shard and of its `top`, which is ordered and may be shorter than k."""
        tops = list(tops)
        chosen, lists = np.zeros((len(queries), self.n_common)), []
        for q, terms in enumerate(queries):
            at = self.place[terms]
            chosen[q, at[(at >= 0) & (at < self.n_common)]] = 1
            lists.append(at[at >= self.n_common] - self.n_common)
        starts = [0, *self.groups[:-1]]
        # for each query and block: what a group and those of more frequent terms give a row at most
        bounds = np.cumsum([chosen[:, a:b] @ self.most[a:b] for a, b in zip(starts, self.groups, strict=True)], axis=0)
        for q, top in enumerate(tops):
            most = bounds[-1, q].max(initial=0) + self.list_most[lists[q]].sum()
            if most >= (top[0][-1] if len(top[0]) == k else 1):
                common = np.flatnonzero(chosen[q])
                groups = [common[a:b] for a, b in zip(*(np.searchsorted(common, x) for x in (starts, self.groups)), strict=True)]
                tops[q] = self._score(groups, lists[q], bounds[:, q], np.int32 if most < 1 << 31 else np.int64, k, top)
        return tops

    def _left(self, sums: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The rows that have at least what their block asks for."""
        return np.flatnonzero(sums.reshape(self.n_blocks, BLOCK_DOCS) >= least.astype(sums.dtype)[:, None])

    def _score(self, groups: list[np.ndarray], lists: np.ndarray, bounds: np.ndarray, kind: type, k: int, top: tuple) -> tuple:
        """The best k of `top` and this shard's rows. bounds: of each group and block, what is still to come before it; kind: whole numbers that hold a score."""
        least = top[0][-1] if len(top[0]) == k else 1
        taken = _runs(self.start[lists], self.size[lists])
        sums = np.bincount(self.docs.take(taken), self.gain.take(taken), self.n_blocks * BLOCK_DOCS).astype(kind)
        at = None  # the rows that are left, once they are few
        for g in reversed(range(len(groups))):
            if at is None:
                left = self._left(sums, least - bounds[g])
                if g == RAISED and len(left) * FEW >= len(sums) > k:  # k rows have a score already
                    least = max(least, np.partition(sums, len(sums) - k)[len(sums) - k])
                    left = self._left(sums, least - bounds[g])
                if len(left) * FEW < len(sums):
                    at, sums = left, sums[left]
            else:
                left = sums >= (least - bounds[g])[at // BLOCK_DOCS]
                at, sums = at[left], sums[left]
            for term in groups[g].tolist():
                np.add(sums, self.rows[term] if at is None else self.rows[term].take(at), out=sums)
        found = sums >= least
        docs, sums = np.flatnonzero(found) if at is None else at[found], sums[found]
        if len(docs) > k:  # the k-th largest, and all its ties
            kept = sums >= np.partition(sums, len(sums) - k)[len(sums) - k]
            docs, sums = docs[kept], sums[kept]
        if not len(docs):
            return top
        scores, ids, known = (np.concatenate(x) for x in zip(top, (sums.astype(np.int64), self.ids[docs], self.known[docs]), strict=True))
        keep = np.lexsort((ids, known, -scores))[:k]
        return scores[keep], ids[keep], known[keep]


_FOUND = "query int, doc_id long, gain long"


def _answer(index: DataFrame, queries: list[tuple[int | None, list[bytes]]], n_docs: int, average: float, k: int) -> DataFrame:
    """(query, doc_id, gain): each task's best k rows for each query of a block, by its number."""
    context = index.sparkSession.sparkContext
    numbers: dict[bytes, int] = {}
    lists = [np.array([numbers.setdefault(t, len(numbers)) for t in terms], np.int64) for _, terms in queries]
    held = context.broadcast(numbers)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                offsets = np.frombuffer(row["offsets"], np.int32)
                found = _numbered(row, held.value)
                here = found >= 0
                total[found[here]] += (offsets[1:] - offsets[:-1])[here]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    counted = index.select("terms", "ends", "offsets").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(numbers), np.int64)
    df[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    statistics = context.broadcast((lists, np.log(1 + (n_docs - df + 0.5) / (df + 0.5))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, idf = statistics.value
        best = [NOTHING] * len(asked)
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Searcher(batch.slice(i, 1).to_pylist()[0], held.value, idf, average)
                for low in range(0, len(asked), QUERIES_TOGETHER):
                    best[low : low + QUERIES_TOGETHER] = shard.best(asked[low : low + QUERIES_TOGETHER], k, best[low : low + QUERIES_TOGETHER])
        query = np.repeat(np.arange(len(asked), dtype=np.int32), [len(top[0]) for top in best])
        scores, ids, known = (np.concatenate(x) for x in zip(NOTHING, *best, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids, mask=~known), pa.array(scores)], ["query", "doc_id", "gain"])

    return index.mapInArrow(search, _FOUND)


def search(index: DataFrame, queries: DataFrame, k: int = 10, path: str | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score): the best k rows for each query; queries as `query_terms` gives them.

    Blocks of queries follow each other, each over all shards at once, and append to a table at `path` (in the
    shared folder, by default).
    """
    spark = index.sparkSession
    schema = "query_id long, rank int, doc_id long, score double"
    totals = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_words").alias("words")).first()
    # rows are numbered, so that repeated ones are dealt to blocks like others
    queries = cut(queries.withColumn("at", F.monotonically_increasing_id()))
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum("characters"), F.lit(0)).alias("characters")).first()
    if not totals["docs"] or not totals["words"] or not size["n"]:
        return spark.createDataFrame([], schema)
    path = path or shared_path(spark, "bm25-found")
    blocks = max(-(-size["n"] // QUERIES_AT_ONCE), -(-size["characters"] // CHARACTERS_AT_ONCE))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("at"), F.lit(blocks)))
    for block in range(blocks):
        rows = sorted(((r["query_id"], [bytes(t) for t in r["terms"]]) for r in dealt.where(F.col("block") == block).collect()), key=lambda r: (r[0] is not None, r))
        found = _answer(index, rows, totals["docs"], totals["words"] / totals["docs"], k)
        order = Window.partitionBy("query").orderBy(F.desc("gain"), "doc_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(rows)], "query int, query_id long")  # one block's
        ranked = ranked.join(F.broadcast(names), "query")
        ranked.select("query_id", "rank", "doc_id", (F.col("gain") / float(UNIT)).alias("score")).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


ORACLE_SQL = f"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
l AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY doc_id),
s AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM l) / CAST((SELECT count(*) FROM documents) AS DOUBLE) AS avgdl),
f AS (SELECT term, ln(1 + (s.n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, s GROUP BY term, s.n),
q AS (SELECT doc_id AS query_id, term FROM p WHERE doc_id % 100 = 0),
g AS (SELECT query_id, p.doc_id, sum(CAST(round({UNIT} * idf * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * dl / avgdl))) AS BIGINT)) AS gain
      FROM q JOIN p USING (term) JOIN f USING (term) JOIN l ON l.doc_id = p.doc_id, s GROUP BY query_id, p.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) AS rank FROM g)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(gain AS DOUBLE) / {float(UNIT)} AS score FROM r WHERE rank <= 10
"""
