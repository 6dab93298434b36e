"""SentencePiece encoding and decoding of merge-type vocabularies by an agenda of adjacent symbol pairs.

A text becomes symbols, one for each character, and adjacent pairs whose joined text is a piece wait in an agenda
in order of that piece's score, leftmost first; the best pair is joined until none waits. No piece has a word mark
behind another character, so pairs never join across the start of a word, and each word (its marks and what follows
them) has an agenda of its own. Words that are new to a worker take their next pair together, as arrays; a very
long word runs through a heap to the same ids. What has no piece falls back to the pieces of its bytes.

Every word is checked against the sentencepiece library once, when a worker meets it: the new words of an Arrow
batch go through the library together, and a difference raises. Work is a map over the rows, without a shuffle; a
worker holds the vocabulary's tables as a mapped file, a memo of MEMO_BYTES and the words of CHUNK characters. The
longest word alone bounds what can exceed that.

Defined results: a null text counts as empty; an empty text has the end id alone and decodes to the empty text; a
very long text gives what the library gives for it whole; repeated rows, and rows that share an id, are encoded
each; an empty table gives an empty result; only the id and text columns are read, whatever others exist; null ids
decode to the empty text, and ids outside the vocabulary raise.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.bpe import SPREAD, Vocabulary, pack, unpack
from vellum.session import publish, ship

CHUNK = 1 << 19
MEMO_BYTES = 96 << 20
#: Characters up to which words are joined many at once; the heap joins longer ones to the same ids.
LONGEST_TOGETHER = 64
MAGIC = b"VSPM0001"
#: A symbol without a piece is BARE plus its character; a pair's key is its first symbol times WIDE plus its second.
BARE, WIDE, NEVER = 1 << 21, 1 << 22, 1 << 40
#: A pair's value is the rank of its score times MADE plus the piece that it makes.
MADE = 1 << 21
MARK, MARKED = "▁", "|"
#: Control ids decode to this, which goes once the bytes on each side are put together.
SILENT = "\ud800"


def _is_word(piece: str) -> bool:
    """No mark stands behind another character."""
    return MARK not in piece.lstrip(MARK)


class Pieces:
    """A merge-type vocabulary compiled from a model file of the sentencepiece library, mapped for joining."""

    KINDS = ("<i8", "<i8", "<i8", "<i8", "<i4", "u1", "<i8")

    @staticmethod
    def compile(path: str) -> bytes:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            model = proto.ModelProto.FromString(f.read())
        norm, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != trainer.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: not a merge-type vocabulary with byte fallback and word marks in front")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError(f"{path}: the texts' normalisation is not the identity with a mark in front")
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.vocab_size()
        kind = [p.type for p in model.pieces]
        if any(k in (4, 5) for k in kind):
            raise ValueError(f"{path}: pieces that users define, or that are unused, are not known here")
        score = {p.piece: p.score for p in model.pieces if p.type == 1}
        ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        ids |= {c: BARE + ord(c) for piece in score for c in piece if c not in ids}
        rank = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = {}
        for piece, s in score.items():
            for at in range(1, len(piece)):
                if (a := ids.get(piece[:at])) is not None and (b := ids.get(piece[at:])) is not None:
                    pairs[a * WIDE + b] = rank[s] * MADE + ids[piece]
        keys, numbers = Vocabulary.table(list(pairs))
        values = np.array([*pairs.values(), NEVER * MADE])[np.where(keys >= 0, numbers, len(pairs))]
        single = sorted((ord(p), i) for p, i in ids.items() if len(p) == 1 and i < BARE)
        first_byte = kind.index(6)
        if kind[first_byte : first_byte + 256] != [6] * 256:
            raise ValueError(f"{path}: the bytes' pieces do not follow each other")
        # what an id decodes to: bytes that are no ASCII stand as lone surrogates until they are put together
        shown = {1: lambda i: model.pieces[i].piece.replace(MARK, " "), 2: lambda i: trainer.unk_surface, 3: lambda i: SILENT, 6: lambda i: chr(b) if (b := i - first_byte) < 128 else chr(0xDC00 + b)}
        texts = [shown[kind[i]](i).encode("utf-8", "surrogatepass") for i in range(size)]
        flags = [all(map(_is_word, score)), not any("\n" in p for p in score), first_byte, library.eos_id()]
        arrays = [keys, values, [c for c, _ in single], [i for _, i in single], np.cumsum([0, *map(len, texts)]), list(b"".join(texts)), flags]
        return pack(MAGIC, [np.array(x, k) for x, k in zip(arrays, Pieces.KINDS, strict=True)])

    def __init__(self, path: str):
        self.keys, self.values, self.characters, self.single, ends, texts, flags = unpack(path, MAGIC, self.KINDS)
        self.half = len(self.keys) // 2
        self.shift = 65 - self.half.bit_length()
        by_word, by_line, self.first_byte, self.end = flags.tolist()
        data, ends = bytes(texts), ends.tolist()
        self.texts = [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(ends, ends[1:], strict=False)]
        bare = {self.first_byte + b for b in range(256)} | {i for i, t in enumerate(self.texts) if "⁇" in t}
        self.marked = {i for i, t in enumerate(self.texts) if t.startswith(" ")} - bare
        apart = " " if by_word else ""
        apart += "\n" if by_line and by_word else ""
        self.by_line = "\n" in apart
        self.segment = re.compile(f" +[^{apart}]*|\n[^{apart}]*" if self.by_line else f" +[^{apart}]*" if apart else r"(?s:.+)")
        self.gap = re.compile("(?<=[^ ]) |\n" if self.by_line else "(?<=[^ ]) ") if apart else None

    def segments(self, text: str) -> Iterator[list[str]]:
        """The words of a text with their marks (as spaces) in front, in lists of about CHUNK characters; a line's start is a word without a mark."""
        if not text:
            return
        text = " " + text.replace(MARK, " ")
        start = 0
        while self.gap and len(text) - start > CHUNK and (found := self.gap.search(text, start + CHUNK)):
            yield self.segment.findall(text, start, found.start())
            start = found.start()
        yield self.segment.findall(text, start)

    def symbols(self, words: list[str]) -> np.ndarray:
        """A symbol for each character of the joined words."""
        codes = np.frombuffer("".join(words).replace(" ", MARK).encode("utf-32-le"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.characters, codes), len(self.characters) - 1)
        return np.where(self.characters[at] == codes, self.single[at], BARE + codes)

    def _values(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The value of each pair of symbols; that of NEVER where they make no piece."""
        key = first * WIDE + second
        wide, shift = key.view(np.uint64), np.uint64(self.shift)
        one = ((wide * np.uint64(SPREAD[0])) >> shift).astype(np.int64)
        two = ((wide * np.uint64(SPREAD[1])) >> shift).astype(np.int64) + self.half
        place = np.where(self.keys[one] == key, one, two)
        return np.where(self.keys[place] == key, self.values[place], NEVER * MADE)

    def join(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words, none empty, one word's after another's, and how many each has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        parts, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(lengths > LONGEST_TOGETHER).tolist():
            made = self._agenda(words[i])
            parts.append(made)
            owners.append(np.full(len(made), i))
        short = np.flatnonzero(lengths <= LONGEST_TOGETHER)
        if len(short):
            self._agendas(self.symbols([words[i] for i in short.tolist()]), np.repeat(short, lengths[short]), parts, owners)
        ids, word = np.concatenate(parts), np.concatenate(owners)
        order = np.argsort(word, kind="stable")
        ids, word = self._bytes(ids[order], word[order])
        return ids, np.bincount(word, minlength=len(words))

    def _agendas(self, ids: np.ndarray, word: np.ndarray, parts: list, owners: list) -> None:
        """Short words: each takes the best pair of its agenda, all at once, until no word has one."""

        def look(at: np.ndarray) -> np.ndarray:
            after = np.minimum(at + 1, len(ids) - 1)
            return np.where((after > at) & (word[at] == word[after]), self._values(ids[at], ids[after]), NEVER * MADE)

        values = look(np.arange(len(ids)))
        while len(ids):
            ranks = values // MADE
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.repeat(np.minimum.reduceat(ranks, starts), np.diff(starts, append=len(ids)))
            open_ = best < NEVER
            if not open_.all():  # words whose agenda is empty go out
                parts.append(ids[~open_])
                owners.append(word[~open_])
                ids, word, values, ranks, best = ids[open_], word[open_], values[open_], ranks[open_], best[open_]
                if not len(ids):
                    break
            hits = np.flatnonzero(ranks == best)
            left = hits[np.diff(word[hits], prepend=-1) != 0]
            ids[left] = values[left] % MADE
            keep = np.ones(len(ids), bool)
            keep[left + 1] = False
            left = left - np.arange(len(left))  # where they stand once the right halves are gone
            ids, word, values = ids[keep], word[keep], values[keep]
            values[left] = look(left)
            before = left[left > 0] - 1
            values[before] = look(before)

    def _agenda(self, text: str) -> np.ndarray:
        """One long word: a heap of (rank, place) over linked symbols, where entries that a join has outdated are passed over."""
        start = self.symbols([text])
        first = self._values(start[:-1], start[1:])
        ids, values = start.tolist(), [*first.tolist(), NEVER * MADE]
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        known: dict[tuple[int, int], int] = {}

        def look(a: int, b: int) -> int:
            if (a, b) not in known:
                known[a, b] = int(self._values(np.array([a]), np.array([b]))[0])
            return known[a, b]

        places = np.flatnonzero(first < NEVER * MADE)
        heap = ((first[places] // MADE << 40) + places).tolist()
        heapq.heapify(heap)
        while heap:
            rank, i = divmod(heapq.heappop(heap), 1 << 40)
            if ids[i] < 0 or values[i] // MADE != rank:
                continue
            j = right[i]
            ids[i], ids[j] = values[i] % MADE, -1
            right[i] = after = right[j]
            if after >= 0:
                left[after] = i
            for x, y in ((left[i], i), (i, after)):
                if x >= 0:
                    values[x] = look(ids[x], ids[y]) if y >= 0 else NEVER * MADE
                    if values[x] < NEVER * MADE:
                        heapq.heappush(heap, (values[x] // MADE << 40) + x)
        return np.array([x for x in ids if x >= 0], np.int64)

    def _bytes(self, ids: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without a piece become the pieces of their bytes."""
        bare = np.flatnonzero(ids >= BARE)
        if not len(bare):
            return ids, word
        code = ids[bare] - BARE
        n = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        times = np.ones(len(ids), np.int64)
        times[bare] = n
        ids, word = np.repeat(ids, times), np.repeat(word, times)
        at = np.flatnonzero(ids >= BARE)
        code, n = np.repeat(code, n), np.repeat(n, n)
        step = at - np.maximum.accumulate(np.where(np.diff(np.repeat(bare, times[bare]), prepend=-1) != 0, at, 0))
        shift = 6 * (n - 1 - step)
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n]
        byte = np.where(n == 1, code, np.where(step == 0, lead | (code >> shift), 0x80 | ((code >> shift) & 0x3F)))
        ids[at] = self.first_byte + byte
        return ids, word


class Codec:
    """Encodes and decodes with a compiled vocabulary; one for each Python worker. library: what new words are checked against."""

    def __init__(self, pieces: Pieces, library=None, memo: int = MEMO_BYTES):
        self.pieces, self.library, self.limit, self.held = pieces, library, memo, 0
        self.memo: dict[str, str] = {}
        self.names = [*map(str, range(len(pieces.texts))), MARKED]
        self.text_of = dict(zip(self.names, pieces.texts, strict=False))

    def _check(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """The library puts a mark in front of a text, so a word loses its first; a line's start gets one, that goes again."""
        lines = np.array([w[0] == "\n" for w in words])
        end = "\n" if self.pieces.by_line else ""
        made = self.library.encode([(w if w[0] == "\n" else w[1:]) + end for w in words], num_threads=1)
        made = [m[at : len(m) - len(end)] for m, at in zip(made, lines.astype(int).tolist(), strict=True)]
        same = np.array_equal(sizes, np.fromiter(map(len, made), np.int64, len(made))) and np.array_equal(ids, np.fromiter(chain.from_iterable(made), np.int64, len(ids)))
        if not same:
            ends = np.cumsum(sizes).tolist()
            wrong = next(w for w, m, a, b in zip(words, made, [0, *ends], ends, strict=False) if ids[a:b].tolist() != m)
            raise RuntimeError(f"the agenda and the library differ on {wrong[:200]!r}")

    def _learn(self, lists: list[list[str]]) -> None:
        """Make the memo hold every word of these lists, which are of bounded size together."""
        known = self.memo
        new = set().union(*(set(words).difference(known) for words in lists))
        if not new:
            return
        if self.held > self.limit:
            known.clear()
            self.held = 0
            new = set().union(*lists)
        words = list(new)
        ids, sizes = self.pieces.join(words)
        if self.library is not None:
            self._check(words, ids, sizes)
        # all ids as one text with a mark behind each word, which falls apart into the words'
        marked = np.insert(ids, np.cumsum(sizes), len(self.names) - 1)
        text = " ".join(map(self.names.__getitem__, marked.tolist()))
        known.update(zip(words, text[: -len(MARKED) - 1].split(f" {MARKED} "), strict=True))
        self.held += 200 * len(words) + 2 * sum(map(len, words)) + len(text)

    def encode_parts(self, text: str | None) -> Iterator[str]:
        """The decimal ids, the end's among them, joined by spaces, in as many parts as a long text needs."""
        for words in self.pieces.segments(text or ""):
            self._learn([words])
            yield " ".join(map(self.memo.__getitem__, words))
        yield str(self.pieces.end)

    def encode_many(self, texts: list[str | None]) -> Iterator[list[str] | Iterator[str]]:
        """`encode_parts` of each text; the new words of texts that fit into one chunk together are learned together."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size := size + len(texts[end] or "")) <= CHUNK:
                end += 1
            if end == at:
                yield self.encode_parts(texts[at])
                at += 1
                continue
            group = [[words for words in self.pieces.segments(text or "")] for text in texts[at:end]]
            self._learn([words for lists in group for words in lists])
            look = self.memo.__getitem__
            for lists in group:
                yield [*(" ".join(map(look, words)) for words in lists), str(self.pieces.end)]
            at = end

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for part in self.encode_parts(text) for i in part.split(" ")]

    def raw(self, part: str) -> str:
        """What ids decode to, before bytes are put together and the first mark goes."""
        return "".join(map(self.text_of.__getitem__, part.split(" ")))

    def decode(self, ids: list[int]) -> str:
        """As the library decodes: bytes that are no UTF-8 give a replacement character each, the first piece loses one mark."""
        if not ids:
            return ""
        text = self.raw(" ".join(map(str, ids)))
        first = next((i for i in ids if self.pieces.texts[i] != SILENT), -1)
        if first in self.pieces.marked:
            text = text.replace(" ", "", 1)
        return _bytes_together(text)

    def digests(self, parts) -> tuple[int, str, str]:
        """Of an encoded text: the number of ids, and SHA-256 of the joined ids and of the text that they decode to."""
        n, ids, decoded, gap, first = 0, hashlib.sha256(), hashlib.sha256(), b"", True
        for part in parts:
            n += part.count(" ") + 1
            ids.update(gap + part.encode())
            gap = b" "
            text = self.raw(part)
            decoded.update(_bytes_together(text[1:] if first and text.startswith(" ") else text).encode())
            first = False
        return n, ids.hexdigest(), decoded.hexdigest()


def _bytes_together(text: str) -> str:
    """Lone surrogates back to the bytes that they stand for; a part of a text holds characters' bytes whole."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        if SILENT in text:
            return "".join(map(_bytes_together, text.split(SILENT)))
        data = text.encode("utf-8", "surrogateescape")
    try:
        return data.decode()
    except UnicodeDecodeError:  # one replacement for each byte that fits nowhere
        return re.sub("[\udc80-\udcff]", "�", data.decode("utf-8", "surrogateescape"))


_OPEN: dict[tuple, Codec] = {}


def _open(compiled: str, model: str) -> Codec:
    """The worker's codec; the files' names change with their contents."""
    if (compiled, model) not in _OPEN:
        import sentencepiece

        _OPEN.clear()
        _OPEN[compiled, model] = Codec(Pieces(SparkFiles.get(compiled)), sentencepiece.SentencePieceProcessor(model_file=SparkFiles.get(model)))
    return _OPEN[compiled, model]


def prepare(spark, model_path: str) -> tuple[str, str]:
    """Compile a model and publish it; the names of the compiled file and of the model itself."""
    ship(spark)
    with open(model_path, "rb") as f:
        model = f.read()
    return publish(spark, Pieces.compile(model_path), ".pieces")[0], publish(spark, model, ".model")[0]


def _map(df: DataFrame, files: tuple[str, str], id_col: str, value_col: str, schema: str, rows) -> DataFrame:
    """rows(codec, values): a row of results for each value."""
    kinds = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[k]) for n, k in (x.split(" ") for x in schema.split(", "))])
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _open(*files)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = list(rows(codec, part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), kinds, strict=True))], [id_col, *kinds.names])

    return df.select(F.col(id_col), F.col(value_col).alias("value")).mapInArrow(run, f"`{id_col}` {kind}, {schema}")


def encode(df: DataFrame, files: tuple[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) of every text, with the end id."""

    def rows(codec: Codec, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        for parts in codec.encode_many(texts):
            ids = np.array(" ".join(parts).split(), np.int32)
            yield len(ids), ids

    return _map(df, files, id_col, text_col, "n_tokens long, ids array<int>", rows)


def decode(df: DataFrame, files: tuple[str, str], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of encoded rows."""
    return _map(df, files, id_col, ids_col, "text string", lambda codec, lists: ((codec.decode(ids or []),) for ids in lists))


def digests(df: DataFrame, files: tuple[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded, in one pass."""
    return _map(df, files, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda codec, texts: map(codec.digests, codec.encode_many(texts)))
