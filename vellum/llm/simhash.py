"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint is the majority, bit by bit, of the hashes of its 4-word shingles. Fingerprints
link where at most RADIUS bits differ; classes are the connected components of those links.

Comparing each fingerprint with all others would grow with the square of the corpus, so the grid of
tiles is cut first: the 64 bits are split into BLOCKS blocks, and two fingerprints that differ in at
most RADIUS bits agree on BLOCKS - RADIUS of them, so every choice of that many blocks gives a key, and
each link falls inside some key's rows. A key's distinct fingerprints are sorted by population count
and compared tile by tile, with numpy's exclusive-or and bit counts; a tile pair whose population
counts differ by more than RADIUS cannot hold a link and is skipped. A key with more than TILE_ROWS
fingerprints is dealt out as pairs of tiles to many tasks, so no task gets an unbounded group; the count that
decides so is brought to its rows by a salted join, as are the classes of a hot fingerprint and of a large class.

Only a star for each component found in a tile pair leaves a task, never its pairs. The stars are
joined to components by alternating hooking of neighbours onto their smallest (large-star and
small-star), each round of which is written to the shared folder.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other;
texts of fewer than four words have one shingle; a very long text is taken in strips of STRIP_BYTES and needs
no more memory beside its bytes; exact copies share a fingerprint and a class;
`dedup` keeps one row of every class, whatever ids are null, repeated or shared between classes: that of
the smallest id, of several the one whose row hash is smallest, of equal rows one; a null id takes part
and is never the smallest; an empty table gives an empty result; extra columns are carried by `dedup` and
ignored by `classes`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.graph import components
from vellum.operators.skew import salted_join
from vellum.session import cut, ship

SHINGLE = 4
SEED = 42
RADIUS = 4
BLOCKS = 6
TILE = 2048
TILE_ROWS = 16_384
#: Bytes of a text that are split into words at once.
STRIP_BYTES = 1 << 18
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def fingerprint(text: str | None) -> int:
    # bytes.split() without arguments splits at space and the controls from tab to carriage return; lower() touches A-Z only
    data, at, n, ones = (text or "").encode("utf-8", "surrogatepass"), 0, 0, np.zeros(64, np.int64)
    held: list[bytes] = []  # the words before that later shingles need
    while at < len(data):
        end = len(data)
        if end - at > STRIP_BYTES and (space := _SPACE.search(data, at + STRIP_BYTES)):
            end = space.start()
        held += data[at:end].lower().split()
        at = end
        if len(held) >= SHINGLE:
            ones += _bit_counts(_shingle_hashes(held))
            n += len(held) - SHINGLE + 1
            held = held[1 - SHINGLE :]
    if not n:
        if not held:
            return 0
        ones, n = _bit_counts(np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], "<u8")), 1
    return int(np.packbits((2 * ones > n)[::-1]).view(">u8")[0])


def _shingle_hashes(words: list[bytes]) -> np.ndarray:
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-SHINGLE] + 1).tolist()]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)], "<u8")


_SPREAD = np.unpackbits(np.arange(256, dtype="u1")[:, None], axis=1, bitorder="little").astype(np.int64)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, lowest first: byte values are counted, then spread to bits."""
    if len(hashes) < 512:
        return np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    columns = hashes.view("u1").reshape(-1, 8)
    return np.concatenate([np.bincount(columns[:, i], minlength=256) @ _SPREAD for i in range(8)])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carried: dict[str, Column] | None = None) -> DataFrame:
    """(id, the longs of `carried`, fp) of every row; fp holds the 64 bits as a signed long."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", *(carried or {}), "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(made.view(np.int64))], names)

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[c.alias(n) for n, c in (carried or {}).items()])
    return rows.mapInArrow(run, ", ".join([f"id {kind}", *(f"{n} long" for n in names[1:])]))


def block_masks(blocks: int = BLOCKS) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def stars(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(member, hub) for each fingerprint linked with another; hub: the smallest of its component.

    With `right`, only pairs across the two are compared; else those inside `left`. Both distinct.
    """
    nodes = left if right is None else np.concatenate([left, right])
    counts = np.bitwise_count(nodes).astype(np.int16)
    order = np.argsort(counts, kind="stable")
    nodes, counts = nodes[order], counts[order]
    side = None if right is None else (order >= len(left))
    label = np.arange(len(nodes))

    def root(i: np.ndarray) -> np.ndarray:
        while True:
            up = label[i]
            if (up == i).all():
                return i
            label[i] = label[up]
            i = label[up]

    for a in range(0, len(nodes), TILE):
        one = nodes[a : a + TILE]
        for b in range(a, len(nodes), TILE):
            if counts[b] - counts[min(a + TILE, len(nodes)) - 1] > radius:
                break  # later tiles have higher counts still
            two = nodes[b : b + TILE]
            for at in range(0, len(one), 128):  # 128 by 2048 exclusive-ors fit the cache
                near = np.bitwise_count(one[at : at + 128, None] ^ two[None, :]) <= radius
                if side is not None:
                    near &= side[a + at : a + at + 128, None] != side[b : b + len(two)][None, :]
                i, j = np.nonzero(near)
                i, j = i + a + at, j + b
                upper = i < j
                i, j = i[upper], j[upper]
                while len(i):
                    i, j = root(i), root(j)
                    apart = i != j
                    i, j = np.minimum(i, j)[apart], np.maximum(i, j)[apart]
                    label[j] = i  # of several, the last stays; the others go round again
    hub = root(np.arange(len(nodes)))
    smallest = np.full(len(nodes), np.iinfo(np.int64).max)
    signed = nodes.view(np.int64)
    np.minimum.at(smallest, hub, signed)
    hubs = smallest[hub]
    linked = hubs != signed
    return signed[linked], hubs[linked]


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): for each component within a key's tiles, its members beside its smallest. distinct: (fp)."""
    ship(distinct.sparkSession)
    masks = block_masks()
    chosen = [sum(x) for x in combinations(masks, BLOCKS - RADIUS)]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in chosen])).alias("choice", "bits"))
    keyed = keyed.select("fp", F.xxhash64("choice", "bits").alias("key"))  # keys that collide share tiles, which costs time alone
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # a hot key's rows learn its count by a salted join, and go by their own hashes while the others meet by key
    hot = sizes.where(F.col("n") > TILE_ROWS).select("key", F.col("n").alias("many"))
    keyed = salted_join(keyed, hot, ["key"], ["fp"], "left").withColumn("by", F.when(F.col("many").isNull(), F.col("key")).otherwise(F.xxhash64("fp", F.lit(13))))
    few = sizes.where(F.col("n") <= TILE_ROWS).select(F.col("key").alias("by"), "n")
    keyed = keyed.join(few, "by", "left").select("fp", "key", F.coalesce("many", "n").alias("n")).where("n IS NOT NULL")
    tiles = F.ceil(F.col("n") / TILE_ROWS).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), tiles).cast("int")
    # a fingerprint of tile t goes to the pairs (t, u) and (u, t) of its key
    spread = keyed.select("fp", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    spread = spread.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("upper"), "fp")
    dealt = spread.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "upper")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        held: list[tuple[np.ndarray, np.ndarray]] = []
        group = None

        def flush() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            fp, upper = (np.concatenate(x) for x in zip(*held, strict=True))
            fp = fp.view(np.uint64)
            if len(fp) > 1:
                if group[1] == group[2]:
                    yield stars(fp, None)
                elif upper.any() and not upper.all():
                    yield stars(fp[~upper], fp[upper])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, low, high, upper, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            at = np.flatnonzero((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            bounds = [0, *at.tolist(), len(key)]
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for x, y in zip(bounds, bounds[1:], strict=False):
                now = (int(key[x]), int(low[x]), int(high[x]))
                if now != group and held:
                    out += flush()
                    held.clear()
                group = now
                held.append((fp[x:y].copy(), upper[x:y].astype(bool)))
            if out:
                a, b = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)
        if held:
            for a, b in flush():
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _rooted(marked: DataFrame, least: Column) -> DataFrame:
    """(fp, least, root) of each fingerprint: an aggregate of its rows, and its class. marked: rows with fp."""
    firsts = cut(marked.groupBy("fp").agg(least.alias("least")))
    rooted = components(links(firsts.select("fp")))
    return firsts.join(rooted, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def _classes(marked: DataFrame, ids: str) -> DataFrame:
    """(fp, component): the smallest id reachable from each fingerprint. marked: rows with fp and an id."""
    held = _rooted(marked, F.min(ids))
    # only linked fingerprints can have a smaller id than their own
    smallest = held.groupBy("root").agg(F.min("least").alias("component"))
    return salted_join(held, smallest, ["root"], ["fp"]).select("fp", "component")


def _row_hashes(df: DataFrame) -> dict[str, Column]:
    """128 bits of hash of all columns. Nulls are marked, as a hash passes over them; maps cannot be hashed but as JSON."""
    columns = [F.col("`" + f.name.replace("`", "``") + "`") for f in df.schema.fields]
    values = [F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c for c, f in zip(columns, df.schema.fields, strict=True)]
    parts = [x for c, v in zip(columns, values, strict=True) for x in (c.isNull(), v)]
    return {"one": F.xxhash64(*parts), "two": F.xxhash64(F.lit(7), *parts)}


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row."""
    marked = cut(fingerprints(df, id_col, text_col))
    return salted_join(marked, _classes(marked, "id"), ["fp"], ["id"]).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with the columns it came with: that with the smallest id, or one of them."""
    ship(df.sparkSession)
    hashes = _row_hashes(df)
    # equal rows have equal texts and so one fingerprint: n counts all of them
    marked = cut(fingerprints(df, id_col, text_col, hashes).groupBy("fp", "id", "one", "two").agg(F.count("*").alias("n")))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "one", "two", "n"))
    firsts = cut(_rooted(marked, first).groupBy("root").agg(F.min("least").alias("m")).select("m.one", "m.two", "m.n"))
    unique = firsts.where("n > 1").isEmpty()
    rows = df.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in hashes.items()])
    held = rows.join(firsts, ["one", "two"], "left_semi")
    if unique:  # as rows are; else equal ones have to be brought together
        return held.select("row.*")
    return held.groupBy("one", "two").agg(F.any_value("row").alias("row")).select("row.*")


# The primes of XXH64.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _xxh64_sql(source: str, seed: int = SEED) -> str:
    """CTEs from source (g) to hashed (g, h): XXH64 in whole numbers of 128 bits, remainders of 2^64."""
    one, two, three, four, five = (f"{p}::UHUGEINT" for p in PRIMES)
    whole, size = 1 << 64, "18446744073709551616::UHUGEINT"
    turned = lambda x, r: f"(({x}) * {1 << r}::UHUGEINT % {size} + ({x}) // {1 << 64 - r}::UHUGEINT)"
    # bytes in hexadecimal, the last one of a number first
    number = lambda at, n: "CAST('0x' || " + " || ".join(f"x[{at} + {k}:{at} + {k + 1}]" for k in range(2 * n - 1, 0, -2)) + " AS UBIGINT)::UHUGEINT"
    starts = ((seed + PRIMES[0] + PRIMES[1]) % whole, (seed + PRIMES[1]) % whole, seed, (seed - PRIMES[0]) % whole)
    stripe = turned(f"(v + l * {two} % {size}) % {size}", 31) + f" * {one} % {size}"
    sums = ", ".join(f"list_reduce(list_prepend({s}::UHUGEINT, list_transform(range(0, size // 32), lambda j: lanes[4 * j + {k + 1}])), lambda v, l: {stripe}) AS v{k}" for k, s in enumerate(starts))
    first = " + ".join(turned(f"v{k}", r) for k, r in enumerate((1, 7, 12, 18)))
    lane = lambda x: turned(f"{x} * {two} % {size}", 31) + f" * {one} % {size}"
    merges = "".join(f"y{k + 1} AS (SELECT *, CASE WHEN size < 32 THEN a{k} ELSE (xor(a{k}, {lane(f'v{k}')}) * {one} % {size} + {four}) % {size} END AS a{k + 1} FROM y{k}),\n" for k in range(4))
    return f"""
s0 AS (SELECT g, hex(encode(g)) AS x, CAST(octet_length(encode(g)) AS BIGINT) AS size FROM {source}),
s1 AS (SELECT *, list_transform(range(0, size // 8), lambda i: {number("16 * i", 8)}) AS lanes FROM s0),
s2 AS (SELECT *, {sums} FROM s1),
y0 AS (SELECT *, CASE WHEN size < 32 THEN {(seed + PRIMES[4]) % whole}::UHUGEINT ELSE ({first}) % {size} END AS a0 FROM s2),
{merges}s3 AS (SELECT *, list_reduce(list_prepend((a4 + size::UHUGEINT) % {size}, list_transform(lanes[4 * (size // 32) + 1:], lambda l: {lane("l")})), lambda h, k: ({turned("xor(h, k)", 27)} * {one} % {size} + {four}) % {size}) AS b FROM y4),
s4 AS (SELECT *, CASE WHEN size % 8 >= 4 THEN ({turned(f"xor(b, {number('16 * (size // 8)', 4)} * {one} % {size})", 23)} * {two} % {size} + {three}) % {size} ELSE b END AS c FROM s3),
s5 AS (SELECT *, list_reduce(list_prepend(c, list_transform(range(size - size % 4, size), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS UBIGINT)::UHUGEINT * {five} % {size})), lambda h, k: {turned("xor(h, k)", 11)} * {one} % {size}) AS e FROM s4),
s6 AS (SELECT g, xor(e, e // {1 << 33}::UHUGEINT) * {two} % {size} AS e FROM s5),
s7 AS (SELECT g, xor(e, e // {1 << 29}::UHUGEINT) * {three} % {size} AS e FROM s6),
hashed AS (SELECT g, CAST(xor(e, e // {1 << 32}::UHUGEINT) AS UBIGINT) AS h FROM s7)"""


def oracle_sql() -> str:
    """All pairs of distinct fingerprints, and components as a recursion; for tables whose ids are unique and not null."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, unnest(CASE WHEN len(words) < {SHINGLE} THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - {SHINGLE - 2}), lambda i: array_to_string(words[i:i + {SHINGLE - 1}], ' ')) END) AS g FROM w WHERE len(words) > 0),
t AS (SELECT doc_id, g, count(*) AS times FROM p GROUP BY ALL),
distinct_texts AS (SELECT DISTINCT g FROM t),{_xxh64_sql("distinct_texts")},
bits AS (SELECT doc_id, bit, sum(CASE WHEN (h >> bit) & 1 = 1 THEN times ELSE 0 END) * 2 > sum(times) AS one FROM t JOIN hashed USING (g), (SELECT CAST(unnest(range(0, 64)) AS UBIGINT) AS bit) GROUP BY ALL),
prints AS (SELECT doc_id, bit_or(CASE WHEN one THEN CAST(1 AS UBIGINT) << bit ELSE CAST(0 AS UBIGINT) END) AS fp FROM bits GROUP BY doc_id),
f AS MATERIALIZED (SELECT w.doc_id, coalesce(fp, CAST(0 AS UBIGINT)) AS fp FROM w LEFT JOIN prints USING (doc_id)),
n AS MATERIALIZED (SELECT fp, min(doc_id) AS least FROM f GROUP BY fp),
l AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b FROM n a JOIN n b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= {RADIUS}),
m(fp, root) AS (SELECT fp, least FROM n UNION SELECT l.b, m.root FROM m JOIN l ON m.fp = l.a),
z AS (SELECT fp, min(root) AS component_id FROM m GROUP BY fp)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM f JOIN z USING (fp)
"""
