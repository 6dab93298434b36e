"""Language identification by prediction by partial matching.

For each language, counts of bytes after contexts of up to three bytes form a context tree. The cost of
a byte after a context is the code length that PPM assigns: what the longest known context gives it, or
an escape to the next shorter one (method C: a context seen n times with d different bytes escapes with
probability d / (n + d)), down to a uniform byte. Statistics are frozen after training, so the cost is a
function of a context and a byte; costs are held in units of 2 ** -20 bit, so that a text's code length is an
exact sum of integers whatever the order. The language with the shortest code length is predicted. Every
language has its own tree, which holds all contexts of its sample; a tree is stored sparsely, by the grams
that occur. Texts are read as their bytes in UTF-8, unchanged.

Training reads about `sample_docs` rows of each language, spread by a hash of the id; this bound limits the
model and never which texts are scored. Every language that has a row is learned. A language's counts meet in one task, which makes its tree; trees become files
in the shared folder, one after another, and Python workers map them into memory, so neither the driver nor a
worker holds more than one tree's arrays, however many languages there are.

`keep` rejects texts without a letter, and texts that no learned language explains: those whose shortest code
length is over MOST_BITS a byte. Prose of the learned languages takes 2 to 3.5 and a uniform byte 8.

Defined results: null and letterless texts are `und` with score 0; a very long text is read in strips of STRIP
bytes and needs little memory beside its bytes; repeated rows are classified each; a null id belongs to no sample
and counts as the empty string for held_out; equal code lengths go to the first language by code point; where
nothing can be learned all is `und`, and `keep` keeps what has a letter; an empty table gives an empty result;
extra columns are carried by `keep` and ignored by `classify`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.bpe import pack, unpack
from vellum.session import cut, publish, ship

ORDER = 3
SIZE = 256
UNDETERMINED = "und"
UNIT = 1 << 20
STRIP = 1 << 20
MAGIC, KINDS = b"VPPM0001", ("<i8",) * 4 + ("<f8",) * 4 + ("<i8",) * 4 + ("<f8",) * 4
#: Bits a byte above which no language explains a text.
MOST_BITS = 7.0


def symbols_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def packed(symbols: np.ndarray) -> np.ndarray:
    """Each symbol behind the three before it, as one number; the first three are only contexts."""
    s = symbols.astype(np.int64)
    return ((s[:-3] * SIZE + s[1:-2]) * SIZE + s[2:-1]) * SIZE + s[3:]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Tree:
    """One language's contexts. By order: the grams seen, packed and sorted, with the bits of their last byte; the contexts seen, with those of an escape."""

    grams: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def open(self) -> Tree:
        return self

    def to_bytes(self) -> bytes:
        """One file: the arrays of each order behind each other."""
        return pack(MAGIC, [x.astype(k) for x, k in zip([*self.grams, *self.bits, *self.contexts, *self.escapes], KINDS, strict=True)])

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """The cost of the last of four packed bytes after the others, in units."""
        total, left = np.zeros(len(grams)), np.arange(len(grams))
        for order in range(ORDER, -1, -1):
            at, hit = _find(self.grams[order], grams[left] % SIZE ** (order + 1))
            total[left[hit]] += self.bits[order][at[hit]]
            left = left[~hit]
            at, hit = _find(self.contexts[order], grams[left] // SIZE % SIZE**order)
            total[left[hit]] += self.escapes[order][at[hit]]
        total[left] += np.log2(SIZE)
        return np.rint(total * UNIT).astype(np.int64)


_OPEN: dict[str, Tree] = {}


@dataclass(frozen=True)
class Stored:
    """A published tree, by the name of its file, which changes with what it holds."""

    name: str

    def open(self) -> Tree:
        """The tree, mapped into memory."""
        if self.name not in _OPEN:
            arrays = unpack(SparkFiles.get(self.name), MAGIC, KINDS)
            _OPEN[self.name] = Tree(*(arrays[at : at + ORDER + 1] for at in range(0, len(arrays), ORDER + 1)))
        return _OPEN[self.name]


def _find(sorted_values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_values):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return at, sorted_values[at] == wanted


@dataclass
class Model:
    """languages, sorted, and the tree of each."""

    languages: list[str]
    trees: list[Tree | Stored]

    def lengths(self, texts: list[str]) -> np.ndarray:
        """The code length of each text in each language, in units."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at + len(group) < len(texts) and (not group or size < STRIP):
                group.append(symbols_of(texts[at + len(group)]))
                size += len(group[-1])
            gap = np.zeros(ORDER, np.uint8)
            symbols = np.concatenate([x for one in group for x in (gap, one)])
            sizes = np.array([len(x) + ORDER for x in group])
            starts = np.cumsum(sizes) - sizes
            for low in range(0, max(len(symbols) - ORDER, 0), STRIP):
                gram = packed(symbols[low : low + STRIP + ORDER])
                where = np.arange(low + ORDER, low + ORDER + len(gram))
                text = np.searchsorted(starts, where, "right") - 1
                real = where - starts[text] >= ORDER  # not the gaps
                gram, text = gram[real], text[real]
                if not len(text):
                    continue
                cuts = np.flatnonzero(np.diff(text, prepend=-1))
                grams, place = np.unique(gram, return_inverse=True)
                for k, tree in enumerate(self.trees):
                    np.add.at(out[:, k], at + text[cuts], np.add.reduceat(tree.open().costs(grams).take(place), cuts, dtype=np.int64))
            at += len(group)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """The language, the score, and the bits a byte of the shortest code length, of each text."""
        found = [(UNDETERMINED, 0.0, 0.0)] * len(texts)
        read = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        if read:
            lengths = self.lengths([texts[i] for i in read])
            best = lengths.argmin(1)
            over = (lengths - lengths.min(1, keepdims=True)) / UNIT
            scores = 1 / np.exp2(-np.minimum(over, 1000)).sum(1)
            for i, b, s, least in zip(read, best.tolist(), scores.tolist(), lengths.min(1).tolist(), strict=True):
                found[i] = (self.languages[b], s, least / UNIT / len(texts[i].encode("utf-8", "surrogatepass")))
        return found

    def explains(self, texts: list[str | None], most_bits: float = MOST_BITS) -> list[bool]:
        """Whether each text has a letter and a language that explains it."""
        if not self.languages:
            return [has_letter(t) for t in texts]
        return [name != UNDETERMINED and bits <= most_bits for name, _, bits in self.predict(texts)]


def context_counts(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) of every four bytes in a row, summed inside each partition first; a long text goes in strips."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def out(name: str, grams: list[np.ndarray]) -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(grams), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values), pa.array(counts)], ["lang", "gram", "n"])

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not value.is_valid:
                    continue
                s = np.concatenate([np.zeros(ORDER, np.uint8), symbols_of(value.as_py())])
                for low in range(0, max(len(s) - ORDER, 0), STRIP):
                    held.setdefault(name, []).append(packed(s[low : low + STRIP + ORDER]))
                    size += len(held[name][-1])
                    if size > 2 * STRIP:
                        yield from map(out, held.keys(), held.values())
                        held.clear()
                        size = 0
        for name, grams in held.items():
            yield out(name, grams)

    rows = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def plant(rows: np.ndarray, n: np.ndarray, least: int = 1) -> Tree:
    """The tree of one language. rows: four packed bytes each, n: how often each occurs; contexts seen less than `least` times are left out."""
    tree = Tree([], [], [], [])
    for order in range(ORDER + 1):
        grams, inverse = np.unique(rows % SIZE ** (order + 1), return_inverse=True)
        seen = np.bincount(inverse, n, len(grams))
        contexts, inverse, kinds = np.unique(grams // SIZE, return_inverse=True, return_counts=True)
        total = np.bincount(inverse, seen, len(contexts))
        known = (total >= least) | (order == 0)
        hit = known[inverse]
        tree.grams.append(grams[hit])
        tree.bits.append(np.log2((total + kinds)[inverse] / seen)[hit])
        tree.contexts.append(contexts[known])
        tree.escapes.append(np.log2((total + kinds) / kinds)[known])
    return tree


def build(languages: list[str], grams: list[tuple[np.ndarray, np.ndarray]], least: int = 1) -> Model:
    """grams: of each language, packed rows of four bytes, and how often each occurs."""
    return Model(languages, [plant(rows, n, least) for rows, n in grams])


def _text_of(id_column: Column) -> Column:
    return F.coalesce(id_column.cast("string"), F.lit(""))


def remainder(id_column: Column, divisor: int) -> Column:
    return F.crc32(_text_of(id_column).cast("binary")) % divisor


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 2_500, held_out: int | None = 5) -> Model:
    """A model of the rows whose language is known; those with crc32(id) mod `held_out` equal to 0 stay out."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    if held_out:
        rows = rows.where(remainder(F.col("id"), held_out) != 0)
    shares = rows.groupBy(F.col("lang").alias("of")).agg(F.least(F.lit(1.0), F.lit(float(sample_docs)) / F.count("*")).alias("share"))
    drawn = F.pmod(F.xxhash64(_text_of(F.col("id"))), F.lit(1 << 30)) / float(1 << 30)
    # a row for each language, of which the model holds a tree
    rows = rows.join(F.broadcast(shares), F.col("lang") == F.col("of")).where(drawn < F.col("share"))
    planted = cut(context_counts(rows).groupBy("lang").applyInArrow(_planted, "lang string, tree binary"))
    # a row for each language; one tree at a time comes through the driver
    names = {r["lang"]: publish(df.sparkSession, bytes(r["tree"]), ".tree")[0] for r in planted.toLocalIterator()}
    languages = sorted(names, key=lambda x: x.encode())
    return Model(languages, [Stored(names[x]) for x in languages])


def _planted(counted: pa.Table) -> pa.Table:
    """The tree of one language's (lang, gram, n)."""
    tree = plant(counted.column("gram").to_numpy(), counted.column("n").to_numpy())
    return pa.table({"lang": counted.column("lang").slice(0, 1), "tree": pa.array([tree.to_bytes()], pa.binary())})


def classify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = model.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _, _ in found], pa.string()), pa.array([x for _, x, _ in found], pa.float64())], [id_col, "lang_pred", "score"])

    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def keep(df: DataFrame, model: Model, text_col: str = "text", most_bits: float = MOST_BITS) -> DataFrame:
    """The rows that a learned language explains, with the columns they came with."""
    ship(df.sparkSession)
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield part.filter(pa.array(model.explains(part.column(place).to_pylist(), most_bits), pa.bool_()))

    return df.mapInArrow(run, df.schema)
