"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded into FEATURES numbers (shares
of character kinds, word shapes, repetition within the document, and a signed random projection of its
hashed words), a hidden layer h = tanh(Wx + b) follows, and gated attention gives passage i the weight
softmax(w . (tanh(Vh_i) * sigmoid(Uh_i))). The weighted sum of the passages goes through one logistic
unit. Only documents have labels; which passages matter is learned from them, by full-batch Adam.

Training reads about `sample_docs` labelled rows, and fewer where these have more than `sample_passages`
passages together: rows are taken in the order of a hash until that many are reached. Every passage of a
row that is taken is read. These bounds limit the model; scoring encodes every passage of every whole text.

A long text is encoded in strips of whole passages, so beside its bytes it needs the hash of each word, by which
repeats are found over the whole text, and a row for each passage.

Defined results: null, empty and blank texts are a bag of one empty passage; a very long text is all its
passages; repeated rows, ties in score and rows that share an id are scored each; of labels that repeat an id the highest counts; a null id has no label and counts as the empty
string for held_out; where only one label, or none, can be learned every score is its share (0.5 for
none); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.language_id import remainder
from vellum.session import ship

PASSAGE = 64
PROJECTED = 16
FEATURES = 16 + PROJECTED
#: The feature that counts words in repeated trigrams.
AGAIN = 12
#: Bytes of a text that are encoded at once.
STRIP = 1 << 18
THRESHOLD = 0.7
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

SPACE, LOWER, UPPER, DIGIT, STOP, SHOUT, SYMBOL, HIGH = range(8)


def _kinds() -> np.ndarray:
    table = np.full(256, SYMBOL, np.uint8)
    for kind, characters in ((SPACE, " \t\n\x0b\x0c\r"), (STOP, ".,;:?'\"-()"), (SHOUT, "!"), (DIGIT, "0123456789")):
        table[[ord(c) for c in characters]] = kind
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[0x80:] = LOWER, UPPER, HIGH
    return table


KINDS = _kinds()
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))


def _powers(n: int, of: np.uint64) -> np.ndarray:
    """of ** 0 .. of ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, of, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_KEPT = [_powers(STRIP + 1, x) for x in (MULTIPLIER, INVERSE)]


def _again(trigrams: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    order = np.argsort(trigrams, kind="stable")
    same = trigrams[order][1:] == trigrams[order][:-1]
    out = np.zeros(len(trigrams), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def encode(text: str | None) -> np.ndarray:
    """The passages of one text, a row each."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    rows, hashes, at, size = [], [], 0, STRIP
    while at < len(data):
        strip = data[at : at + size]
        inside = KINDS[strip] != SPACE
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        if at + size < len(data):  # more follows: whole passages only, and no word that the strip may cut
            n = max(len(starts) - 1, 0) // PASSAGE * PASSAGE
            if not n:
                if len(starts) or size >= len(data):
                    size *= 2  # the words are long
                else:
                    at += size  # white space alone
                continue
            used, starts, ends = int(starts[n]), starts[:n], ends[:n]
        else:
            used = len(strip)
        if len(starts):
            made, found = _passages(strip[:used], starts, ends)
            rows.append(made)
            hashes.append(found)
        at, size = at + used, STRIP
    if not rows:
        return np.zeros((1, FEATURES), np.float32)
    words = np.concatenate(hashes)
    again = np.zeros(len(words), bool)
    if len(words) > 2:
        again[:-2] = _again(words[:-2] + words[1:-1] * np.uint64(3) + words[2:] * np.uint64(7))
    out = np.concatenate(rows)
    first = np.arange(0, len(words), PASSAGE)
    out[:, AGAIN] = np.add.reduceat(again, first, dtype=np.float64) / np.diff(first, append=len(words))
    return out


def _passages(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The passages of a strip that starts with one, but for what depends on the whole text; and its words' hashes."""
    kinds, n = KINDS[data], len(starts)
    up, down = (k[: len(data) + 1] if len(data) < len(k) else _powers(len(data) + 1, x) for k, x in zip(_KEPT, (MULTIPLIER, INVERSE), strict=True))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    hashes = (hashes ^ (hashes >> np.uint64(29))) * MULTIPLIER
    lengths = ends - starts
    # reduceat runs to the next start, and so counts the spaces between; no kind here is a space
    counts = {k: np.add.reduceat(kinds == k, starts, dtype=np.int32) for k in (LOWER, UPPER, DIGIT, STOP, SHOUT, SYMBOL, HIGH)}
    first = np.arange(0, n, PASSAGE)
    size = np.diff(first, append=n).astype(np.float64)
    letters = counts[LOWER] + counts[UPPER] + counts[HIGH]
    bytes_in = np.add.reduceat(lengths, first).astype(np.float64)
    passage = np.arange(n) // PASSAGE
    # words in order of passage and hash, to tell the distinct ones of each
    within = np.lexsort((hashes, passage))
    fresh = np.ones(n, bool)
    fresh[1:] = (hashes[within][1:] != hashes[within][:-1]) | (passage[1:] != passage[:-1])
    distinct = np.bincount(passage[fresh], minlength=len(first))
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    each = lambda x: np.add.reduceat(x, first) / size
    shares = [np.add.reduceat(counts[k], first) / bytes_in for k in (LOWER, UPPER, DIGIT, STOP, SHOUT, SYMBOL, HIGH)]
    shapes = [
        bytes_in / size / 10,
        each((letters == 0).astype(np.float64)),
        each((counts[SYMBOL] > 0).astype(np.float64)),
        each(((counts[UPPER] > 1) & (counts[LOWER] == 0)).astype(np.float64)),
        1 - distinct / size,
        np.zeros(len(first)),
        each((lengths <= 3).astype(np.float64)),
        (lines[ends[np.minimum(first + PASSAGE, n) - 1]] - lines[starts[first]]) / size,
        size / PASSAGE,
    ]
    signs = np.unpackbits((hashes >> np.uint64(48)).astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)
    projected = np.add.reduceat(signs, first, axis=0, dtype=np.int32) / size[:, None] * 2 - 1
    return np.column_stack([*shares, *shapes, projected]).astype(np.float32), hashes


@dataclass
class Model:
    """The weights by name, and the scaling of the features; `share` where nothing could be learned."""

    weights: dict[str, np.ndarray] | None
    mean: np.ndarray | None
    scale: np.ndarray | None
    share: float = 0.5

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(bags), self.share)
        sizes = np.array([len(b) for b in bags])
        return forward(self.weights, (np.concatenate(bags) - self.mean) / self.scale, np.cumsum(sizes) - sizes)["p"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def forward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    e = (t * g) @ w["w"]
    bag = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(x)))
    a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a /= np.add.reduceat(a, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "bag": bag, "z": z, "p": _sigmoid(z @ w["c"] + w["d"])}


def backward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, f: dict[str, np.ndarray], error: np.ndarray) -> dict[str, np.ndarray]:
    """The gradient of the loss; error: its derivative by each bag's logit."""
    dz = error[:, None] * w["c"]
    here = dz[f["bag"]]
    dot = (here * f["h"]).sum(1)
    de = f["a"] * (dot - np.add.reduceat(f["a"] * dot, starts)[f["bag"]])
    dt, dg = de[:, None] * w["w"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * w["w"] * f["t"] * f["g"] * (1 - f["g"])
    dh = (here * f["a"][:, None] + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ error, "d": np.array(error.sum())}


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 16, attention: int = 8, rounds: int = 250, rate: float = 0.03, decay: float = 1e-4, seed: int = 7) -> Model:
    labels = np.asarray(labels, np.float64)
    if not len(labels) or labels.min() == labels.max():
        return Model(None, None, None, float(labels.mean()) if len(labels) else 0.5)
    rows, sizes = np.concatenate(bags).astype(np.float64), np.array([len(b) for b in bags])
    mean, scale = rows.mean(0), rows.std(0) + 1e-3
    x, starts = (rows - mean) / scale, np.cumsum(sizes) - sizes
    rnd = np.random.default_rng(seed)
    shapes = {"W": (x.shape[1], hidden), "b": (hidden,), "V": (hidden, attention), "U": (hidden, attention), "w": (attention,), "c": (hidden,), "d": ()}
    w = {k: rnd.normal(0, 1 / np.sqrt(s[0]) if s else 0.01, s) if k not in ("b", "d") else np.zeros(s) for k, s in shapes.items()}
    first, second = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    for step in range(1, rounds + 1):
        f = forward(w, x, starts)
        grad = backward(w, x, starts, f, (f["p"] - labels) / len(labels))
        for k in w:
            g = grad[k] + decay * w[k]
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
            w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(w, mean, scale)


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = 5_000, sample_passages: int = 240_000, held_out: tuple[int, int] = (4, 2)) -> Model:
    """A model of the labelled rows whose crc32(id) mod held_out[0] is not held_out[1]."""
    ship(documents.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (remainder(F.col(id_col), held_out[0]) != held_out[1]))
    known = known.groupBy(F.col(id_col).cast("string").alias("of")).agg(F.max(label_col).cast("int").alias("label"))
    share = min(1.0, sample_docs / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("of", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)) + (share >= 1))
    rows = documents.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    # sample_docs, on the average, of an id and a label each: bounded whatever the input
    rows = rows.join(F.broadcast(drawn), F.col("id") == F.col("of")).select("of", "label", "text")

    def bags(texts: pa.Array) -> Iterator[bytes]:
        return (encode(text.as_py()).tobytes() for text in texts)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in bags(batch.column(2))], pa.int64())], ["of", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(bags(part.column(2)), pa.binary())], ["label", "bag"])

    # a row for each drawn id, so as many as above
    measured = rows.mapInArrow(sizes, "of string, size long").groupBy("of").agg(F.sum("size").alias("size"))
    measured = measured.orderBy(F.xxhash64("of", F.lit(5)), "of").collect()
    before = np.cumsum([0, *(r["size"] // (4 * FEATURES) for r in measured)])[:-1]
    if len(taken := [r["of"] for r, n in zip(measured, before, strict=True) if n < sample_passages]) < len(measured):
        ids = documents.sparkSession.createDataFrame([(x,) for x in taken], "of string")
        rows = rows.join(F.broadcast(ids), "of", "left_semi")

    got = sorted((r["label"], bytes(r["bag"])) for r in rows.mapInArrow(run, "label int, bag binary").collect())  # in an order that reruns share
    return fit([np.frombuffer(b, np.float32).reshape(-1, FEATURES) for _, b in got], np.array([y for y, _ in got]))


def classify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted) of every row."""
    ship(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores = held.value.score([encode(x.as_py()) for x in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")
