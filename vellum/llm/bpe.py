"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The words that are frequent in the corpus are merged once, on the driver, and compiled into a
minimal acyclic automaton: equal suffixes share states, and the counts stored on the transitions
sum to a word's rank, which points at its ids. A word that the automaton rejects is merged exactly, by
rank, so what the lexicon holds changes the speed of an encoding and never its ids.

The vocabulary (merge table, pieces) and the lexicon are one flat file each, published through the shared
folder; a Python worker maps both into memory and holds no more beside them than the pieces, a memo of
MEMO_BYTES, and the words of CHUNK characters. A text of any length goes through in chunks that end at
white space; one word is never split, so the longest word bounds what a chunk can exceed.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty
text; a very long text gives what the library gives for it whole; repeated rows, and rows that share an id,
are encoded each; ties in frequency need no order, as the lexicon changes no result; an empty table gives an
empty result; only the id and text columns are read, whatever others exist.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vellum.session import cut, publish, ship

#: Characters that are split into words at once.
CHUNK = 1 << 19
#: What a worker's memo, or its counts of words, may take, by an estimate of each entry.
MEMO_BYTES = 24 << 20
COUNT_BYTES = 16 << 20
MAGIC, MAGIC_VOCABULARY = b"VLEX0001", b"VBPE0001"
WIDE, NEVER = 1 << 20, 1 << 30
MARK = "|"
#: Odd multipliers that spread keys over the places of a table.
SPREAD, MASK = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (1 << 64) - 1
#: Bytes up to which words are merged many at once; the heap merges longer ones to the same ids.
LONGEST_TOGETHER = 64
#: Below this code point the fast splitter's classes are spelled out; other texts take the library's splitter.
PLAIN_LIMIT = 0x250


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return [table[b] for b in range(256)]


def _class(prefix: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(PLAIN_LIMIT) if unicodedata.category(chr(c)).startswith(prefix))


_SPACE = "\t-\r \x85\xa0"
_PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^{_SPACE}{_class('L')}{_class('N')}]+")
#: White space as the tokenizer has it; str.isspace() also holds for U+001C to U+001F, which are parts of words.
_WHITE = re.compile(f"[{_SPACE}\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ODD = re.compile(f"[^\x00-{chr(PLAIN_LIMIT - 1)}]")


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """Pieces of about `size` characters that end at white space, which no token spans."""
    start = 0
    while len(text) - start > size and (cut_at := _WHITE.search(text, start + size)):
        yield text[start : cut_at.start()]
        start = cut_at.start()
    yield text[start:]


def pack(magic: bytes, arrays: list[np.ndarray]) -> bytes:
    """Arrays behind each other, each from a multiple of 8 bytes on, after the number of items of each."""
    head = np.array([*map(len, arrays)], "<i8").tobytes()
    return magic + head + b"".join(x.tobytes() + bytes(-x.nbytes % 8) for x in arrays)


def unpack(path: str, magic: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The arrays of a packed file, mapped into memory."""
    data = np.memmap(path, "u1", "r").view(np.ndarray)  # mapped still, without the subclass's cost at every slice
    if bytes(data[:8]) != magic:
        raise ValueError(f"{path} does not start with {magic.decode()}")
    at, out = 8 + 8 * len(kinds), []
    for kind, n in zip(kinds, data[8:at].view("<i8").tolist(), strict=True):
        size = np.dtype(kind).itemsize * n
        out.append(data[at : at + size].view(kind))
        at += size + -size % 8
    return out


class Vocabulary:
    """A word-level BPE vocabulary, compiled from a file of the tokenizers library and mapped for exact merging.

    A pair's key is its first id times WIDE plus its second. It stands in one of two places of a hash table, in the
    first or the second half of `pair_keys`, with its rank in `pair_ranks`; a rank leads through `made` to the id that
    the pair merges to.
    """

    KINDS = ("<i8", "<i4", "<i4", "<i4", "<i4", "<i4", "u1", "u1")

    @staticmethod
    def table(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The keys by place, -1 where none is, and their numbers. A key that finds its place taken sends the other to its second one."""
        bits = max(4, len(keys).bit_length() + 1)
        for _ in range(8):
            half = 1 << bits
            held, numbers = [-1] * (2 * half), [0] * (2 * half)
            for number, key in enumerate(keys):
                side = 0
                for _ in range(200):
                    at = side * half + ((key * SPREAD[side] & MASK) >> 64 - bits)
                    held[at], key, numbers[at], number = key, held[at], number, numbers[at]
                    if key < 0:
                        break
                    side = 1 - at // half  # the one that stood here goes to its other place
                else:
                    break
            else:
                return np.array(held, np.int64), np.array(numbers, np.int64)
            bits += 1
        raise ValueError("the pairs find no places")

    @staticmethod
    def compile(path: str) -> bytes:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        bpe = model["model"]
        suffix = bpe["end_of_word_suffix"] or ""
        vocab: dict[str, int] = bpe["vocab"]
        characters = byte_characters()
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in bpe["merges"]]
        keys = np.array([vocab[a] * WIDE + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs])
        table, ranks = Vocabulary.table(keys.tolist())
        names = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in model["added_tokens"]}
        pieces = [names.get(i, "").encode() for i in range(max(names) + 1)]
        # what splits and normalises a text, without the tables
        shell = json.dumps(model | {"model": bpe | {"vocab": {}, "merges": []}, "added_tokens": []})
        rest = json.dumps({"special": {x["content"]: x["id"] for x in model["added_tokens"]}, "shell": shell})
        arrays = [table, ranks, made, [vocab[c] for c in characters], [vocab[c + suffix] for c in characters], np.cumsum([0, *map(len, pieces)]), list(b"".join(pieces)), list(rest.encode())]
        return pack(MAGIC_VOCABULARY, [np.array(x, kind) for x, kind in zip(arrays, Vocabulary.KINDS, strict=True)])

    def __init__(self, path: str):
        self.pair_keys, self.pair_ranks, self.made_table, self.inner_table, self.last_table, ends, pieces, rest = unpack(path, MAGIC_VOCABULARY, self.KINDS)
        self.half = len(self.pair_keys) // 2
        self.shift = 65 - self.half.bit_length()
        data, ends = bytes(pieces), ends.tolist()
        self.pieces = [data[a:b].decode() for a, b in zip(ends, ends[1:], strict=False)]
        held = json.loads(bytes(rest))
        self.special_ids: dict[str, int] = held["special"]
        self.special = re.compile("|".join(re.escape(x) for x in sorted(self.special_ids, key=len, reverse=True))) if self.special_ids else None
        self.shell, self.library = held["shell"], None
        self.back = {c: b for b, c in enumerate(byte_characters())}

    def _by_library(self, text: str) -> list[str]:
        """The words as the library splits them; loaded where the first text needs it."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.shell)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.back[c] for c in piece).decode("utf-8", "surrogateescape") for piece, _ in pieces]

    def words(self, text: str) -> list[str]:
        """The words of a text without special strings, normalised."""
        return self._by_library(text) if _ODD.search(text) else _PLAIN.findall(text.lower())

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of ordinary text, and special strings, in order."""
        at = 0
        if self.special and "<" in text:
            for m in self.special.finditer(text):
                yield text[at : m.start()], False
                yield m[0], True
                at = m.end()
        yield text[at:], False

    def merge(self, word: str) -> list[int]:
        """The ids of one word: lowest rank first, leftmost first."""
        return self._merge_long(word.encode("utf-8", "surrogateescape"))

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """The ids of many words, none empty."""
        ids, sizes = self.merge_flat(words)
        ends, flat = np.cumsum(sizes).tolist(), ids.tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge_flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words, one word's after another's, and how many each has. All take their next merge together, until none has one."""
        done_ids, done_words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def finish(ids: np.ndarray, word: np.ndarray) -> None:
            done_ids.append(ids)
            done_words.append(word)

        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(lengths > LONGEST_TOGETHER).tolist():
            made = np.array(self._merge_long(words[i]))
            finish(made, np.full(len(made), i))
        short = np.flatnonzero(lengths <= LONGEST_TOGETHER)
        if len(short):
            lengths = lengths[short]
            data = np.frombuffer(b"".join([words[i] for i in short.tolist()]), np.uint8)
            ids = self.inner_table[data].astype(np.int64)
            ends = np.cumsum(lengths) - 1
            ids[ends] = self.last_table[data[ends]]
            self._merge_rounds(ids, np.repeat(short, lengths), finish)
        ids, word = np.concatenate(done_ids), np.concatenate(done_words)
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def _merge_rounds(self, ids: np.ndarray, word: np.ndarray, finish) -> None:
        ranks = self._ranks(ids, word, np.arange(len(ids)))
        while len(ids):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(starts, append=len(ids))
            best = np.repeat(best, sizes)
            stay = best < NEVER
            if not stay.all():  # words without a merge left go out
                finish(ids[~stay], word[~stay])
                ids, word, ranks, best = ids[stay], word[stay], ranks[stay], best[stay]
                if not len(ids):
                    break
            hits = np.flatnonzero(ranks == best)
            first = hits[np.diff(word[hits], prepend=-1) != 0]
            ids[first] = self.made_table[ranks[first]]
            keep = np.ones(len(ids), bool)
            keep[first + 1] = False
            first = first - np.arange(len(first))  # where they stand once the second halves are gone
            ids, word, ranks = ids[keep], word[keep], ranks[keep]
            ranks[first] = self._ranks(ids, word, first)
            before = first[first > 0] - 1
            ranks[before] = self._ranks(ids, word, before)

    def _ranks(self, ids: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank of the pair at each place; NEVER across words and where there is no merge."""
        after = np.minimum(at + 1, len(ids) - 1)
        key = ids[at] * WIDE + ids[after]
        wide, shift = key.view(np.uint64), np.uint64(self.shift)
        one, two = ((wide * np.uint64(SPREAD[0])) >> shift).astype(np.int64), ((wide * np.uint64(SPREAD[1])) >> shift).astype(np.int64) + self.half
        place = np.where(self.pair_keys[one] == key, one, two)
        return np.where((self.pair_keys[place] == key) & (word[at] == word[after]) & (after > at), self.pair_ranks[place], NEVER)

    def _rank(self, a: int, b: int) -> int:
        key = a * WIDE + b
        for side in (0, 1):
            at = side * self.half + ((key * SPREAD[side] & MASK) >> self.shift)
            if self.pair_keys[at] == key:
                return int(self.pair_ranks[at])
        return NEVER

    def _merge_long(self, word: bytes) -> list[int]:
        """One word, with a heap: its length does not tell in the square. A heap's entry is a rank and a place in one number."""
        data = np.frombuffer(word, np.uint8)
        start = self.inner_table[data].astype(np.int64)
        start[-1] = self.last_table[data[-1]]
        n = len(start)
        first = self._ranks(start, np.zeros(n, np.int8), np.arange(n)).astype(np.int64)
        ids, ranks = start.tolist(), first.tolist()  # a rank: of the pair that starts there
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        known: dict[tuple[int, int], int] = {}
        heap = ((first << 32) + np.arange(n))[first < NEVER].tolist()
        heapq.heapify(heap)
        while heap:
            best, i = divmod(heapq.heappop(heap), 1 << 32)
            if ids[i] < 0 or ranks[i] != best:
                continue
            j = right[i]
            ids[i], ids[j] = int(self.made_table[best]), -1
            right[i] = after = right[j]
            if after >= 0:
                left[after] = i
            for x, y in ((left[i], i), (i, after)):
                if x < 0:
                    continue
                rank = NEVER
                if y >= 0 and (rank := known.get(pair := (ids[x], ids[y]), -1)) < 0:
                    rank = known[pair] = self._rank(*pair)
                ranks[x] = rank
                if rank < NEVER:
                    heapq.heappush(heap, (rank << 32) + x)
        return [x for x in ids if x >= 0]


class Lexicon:
    """A minimal acyclic transducer from words to ids, in one flat file.

    Arrays: `keys` holds state * 256 + byte for each transition, sorted; `targets` the next state;
    `skips` how many words precede those that take the transition; `final` whether a word ends in a
    state. The skips along a word, and the words that end on the way, sum to its rank; `offsets` and
    `ids` hold the ids by rank.
    """

    KINDS = ("<i8", "<i8", "<i4", "<i4", "u1", "<i4", "<i4")

    @staticmethod
    def compile(words: Iterable[tuple[bytes, list[int]]]) -> bytes:
        """words: distinct, in byte order."""
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []
        path: list[list] = [[False, []]]  # of [final, transitions] that may still change
        previous, offsets, flat = b"", [0], []

        def freeze(down_to: int) -> None:
            while len(path) - 1 > down_to:
                final, moves = path.pop()
                form = (final, tuple(moves))
                if (state := register.get(form)) is None:
                    state = register[form] = len(states)
                    states.append(form)
                path[-1][1][-1] = (path[-1][1][-1][0], state)

        for word, ids in words:
            shared = len(os.path.commonprefix([previous, word]))
            freeze(shared)
            for b in word[shared:]:
                path[-1][1].append((b, -1))
                path.append([False, []])
            path[-1][0] = True
            previous = word
            flat += ids
            offsets.append(len(flat))
        freeze(0)
        root = len(states)
        states.append((path[0][0], tuple(path[0][1])))
        below: list[int] = []
        keys, targets, skips = [], [], []
        for state, (final, moves) in enumerate(states):  # a state's targets come before it
            total = int(final)
            for b, target in moves:
                keys.append(state * 256 + b)
                targets.append(target)
                skips.append(total)
                total += below[target]
            below.append(total)
        arrays = ([root], keys, targets, skips, [s[0] for s in states], offsets, flat)
        return pack(MAGIC, [np.array(x, kind) for x, kind in zip(arrays, Lexicon.KINDS, strict=True)])

    def __init__(self, path: str):
        root, self.keys, self.targets, self.skips, self.final, self.offsets, self.ids = unpack(path, MAGIC, self.KINDS)
        self.root, self.states = int(root[0]), len(self.final)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 if the automaton rejects it; all words step together."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), "u1")
        starts = np.cumsum(lengths) - lengths
        state, rank = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        live = np.arange(len(words))
        for step in range(int(lengths.max(initial=0))):
            live = live[(lengths[live] > step) & (state[live] >= 0)]
            if not len(live) or not len(self.keys):
                break
            key = state[live] * 256 + data[starts[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            state[live] = np.where(hit, self.targets[at], -1)
            rank[live] += np.where(hit, self.skips[at], 0)
        ends = state >= 0
        ends[ends] = self.final[state[ends]] > 0
        return np.where(ends & (len(self.keys) > 0), rank, -1)

    def flat(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words of these ranks, one word's after another's, and how many each has."""
        starts, sizes = self.offsets[ranks].astype(np.int64), np.diff(self.offsets)[ranks].astype(np.int64)
        at = np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
        return self.ids[at].astype(np.int64), sizes


class Codec:
    """Encodes and decodes with a vocabulary and a lexicon; one for each Python worker."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None, memo: int = MEMO_BYTES):
        self.vocabulary, self.lexicon, self.memo, self.limit, self.held = vocabulary, lexicon, {}, memo, 0
        self.names = [*map(str, range(len(vocabulary.pieces))), MARK]
        self.piece_of = dict(zip(self.names, vocabulary.pieces, strict=False))

    def _learn(self, lists: list[list[str]]) -> None:
        """Make the memo hold every word of these lists, which are of bounded size together; before them it holds at most `limit` bytes."""
        known = self.memo
        new = set().union(*(set(words).difference(known) for words in lists))
        if not new:
            return
        if self.held > self.limit:
            known.clear()
            self.held = 0
            new = set().union(*lists)
        words = list(new)
        data = [w.encode("utf-8", "surrogateescape") for w in words]
        ranks = self.lexicon.ranks(data) if self.lexicon else np.full(len(words), -1)
        found, missing = np.flatnonzero(ranks >= 0), np.flatnonzero(ranks < 0)
        parts = [self.vocabulary.merge_flat([data[i] for i in missing.tolist()])]
        if len(found):
            parts.append(self.lexicon.flat(ranks[found]))
        ids, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        # all ids as one text with a mark behind each word, which falls apart into the words'
        marked = np.insert(ids, np.cumsum(sizes), len(self.names) - 1)
        text = " ".join(map(self.names.__getitem__, marked.tolist()))
        known.update(zip([words[i] for i in np.concatenate([missing, found]).tolist()], text[: -len(MARK) - 1].split(f" {MARK} "), strict=True))
        # two strings and a place in the table for each
        self.held += 200 * len(words) + 2 * sum(map(len, data)) + len(text)

    def _split(self, text: str) -> Iterator[list[str] | str]:
        """A text's special ids, as strings, and the words between them, in bounded lists."""
        for segment, special in self.vocabulary.segments(text):
            if special:
                yield str(self.vocabulary.special_ids[segment])
                continue
            for chunk in chunks(segment):
                if words := self.vocabulary.words(chunk):
                    yield words

    def encode_parts(self, text: str) -> Iterator[str]:
        """The decimal ids, joined by spaces, in as many parts as a long text needs; no part is empty."""
        for part in self._split(text):
            if isinstance(part, str):
                yield part
            else:
                self._learn([part])
                yield " ".join(map(self.memo.__getitem__, part))

    def encode_many(self, texts: list[str | None]) -> Iterator[Iterable[str]]:
        """`encode_parts` of each text; the new words of texts that fit into one chunk together are learned together."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size := size + len(texts[end] or "")) <= CHUNK:
                end += 1
            if end == at:  # a long text goes part by part
                yield self.encode_parts(texts[at])
                at += 1
                continue
            group = [list(self._split(text or "")) for text in texts[at:end]]
            self._learn([part for parts in group for part in parts if not isinstance(part, str)])
            look = self.memo.__getitem__
            for parts in group:
                yield [part if isinstance(part, str) else " ".join(map(look, part)) for part in parts]
            at = end

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for part in self.encode_parts(text or "") for i in part.split(" ")]

    def decode_part(self, part: str) -> str:
        return " ".join(map(self.piece_of.__getitem__, part.split(" ")))

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_part(" ".join(map(str, ids))) if (ids := list(ids)) else ""

    def digests(self, parts: Iterable[str]) -> tuple[int, str, str]:
        """Of an encoded text: the number of ids, and SHA-256 of the joined ids and of the text that they decode to."""
        n, ids, decoded, gap = 0, hashlib.sha256(), hashlib.sha256(), b""
        for part in parts:
            n += part.count(" ") + 1
            ids.update(gap + part.encode())
            decoded.update(gap + self.decode_part(part).encode("utf-8", "replace"))
            gap = b" "
        return n, ids.hexdigest(), decoded.hexdigest()


_OPEN: dict[tuple, Codec] = {}


def _open(vocabulary: str, lexicon: str | None) -> Codec:
    """The worker's codec; the files' names change with their contents."""
    if (vocabulary, lexicon) not in _OPEN:
        _OPEN.clear()
        _OPEN[vocabulary, lexicon] = Codec(Vocabulary(SparkFiles.get(vocabulary)), Lexicon(SparkFiles.get(lexicon)) if lexicon else None)
    return _OPEN[vocabulary, lexicon]


def word_counts(df: DataFrame, vocabulary: str, text_col: str = "text", hold: int = COUNT_BYTES) -> DataFrame:
    """(word, n) over all texts, counted inside each partition before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, seen, sizes = _open(vocabulary, None).vocabulary, Counter(), 0

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([w.encode("utf-8", "surrogateescape") for w in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return made

        for batch in batches:
            for value in batch.column(0):
                for segment, special in opened.segments(value.as_py() or ""):
                    for chunk in chunks(segment) if not special else ():
                        before = len(seen)
                        words = opened.words(chunk)
                        seen.update(words)
                        new = len(seen) - before
                        sizes += 150 * new + (sum(map(len, words)) * new // len(words) if words else 0)
                        if sizes >= hold:
                            yield out()
                            sizes = 0
        yield out()

    return df.select(F.col(text_col).alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(df: DataFrame, tokenizer_path: str, text_col: str = "text", max_words: int = 1 << 16, min_count: int = 2) -> tuple[str, str]:
    """Compile the words that are at least 1 / max_words of the corpus; returns the names of the two published files.

    No more than max_words words can be that frequent, which bounds the lexicon and what reaches the driver.
    It bounds no result: other words are merged exactly.
    """
    spark = df.sparkSession
    ship(spark)
    compiled = Vocabulary.compile(tokenizer_path)
    vocabulary, path = publish(spark, compiled, ".bpe")
    total = Observation()
    counts = word_counts(df, vocabulary, text_col).observe(total, F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    counts = cut(counts.where(F.col("n") >= min_count))
    frequent = counts.where(F.col("n") * max_words >= total.get["n"])
    words = sorted(bytes(r[0]) for r in frequent.select("word").collect())
    opened = Vocabulary(path)
    lexicon = Lexicon.compile(zip(words, opened.merge_many(words), strict=True))
    return vocabulary, publish(spark, lexicon, ".lex")[0]


def _map(df: DataFrame, files: tuple[str, str], id_col: str, text_col: str, schema: str, rows) -> DataFrame:
    """rows(codec, values): a row of results for each value."""
    kinds = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[k]) for n, k in (x.split(" ") for x in schema.split(", "))])
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _open(*files)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = list(rows(codec, part.column(1).to_pylist()))
                columns = list(zip(*made, strict=True)) if made else [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True))], [id_col, *kinds.names])

    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, {schema}")


def encode(df: DataFrame, files: tuple[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) of every text."""

    def rows(codec: Codec, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        for parts in codec.encode_many(texts):
            ids = np.array(" ".join(parts).split(), np.int32)
            yield len(ids), ids

    return _map(df, files, id_col, text_col, "n_tokens long, ids array<int>", rows)


def decode(df: DataFrame, files: tuple[str, str], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of encoded rows; null ids decode to the empty text."""
    return _map(df, files, id_col, ids_col, "text string", lambda codec, lists: ((codec.decode(ids or []),) for ids in lists))


def digests(df: DataFrame, files: tuple[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded, in one pass."""
    return _map(df, files, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda codec, texts: map(codec.digests, codec.encode_many(texts)))
