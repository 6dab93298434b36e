"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import AWKWARD
from vellum.llm import collocations as C

SMALL = str.maketrans(C.UPPER, C.LOWER)


def slow(rows, least, first=C.FIRST):
    """rows: (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(SMALL)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    out = []
    for lang in n:
        found = {g: a for (of, g), a in f.items() if of == lang and len(g) > 1 and a >= least}
        kept = []
        for g, a in found.items():
            if any(len(h) > len(g) and b * 100 >= a * 100 and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in found.items()):
                continue
            cuts = [(1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def made(df, **kw):
    return sorted(map(tuple, C.collocations(df, **kw).collect()))


@pytest.mark.parametrize("least, first", [(2, 2000), (5, 7), (1, 50)])
def test_phrases_are_those_of_plain_counting(spark, monkeypatch, least, first):
    monkeypatch.setattr(C, "FOLD", 500)
    rnd = random.Random(least)
    vocabulary = ["the", "of", "New", "York", "É", "漢", "x1", "é", "a"]
    rows = [("".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",;"]) for _ in range(rnd.randrange(40))), rnd.choice(["en", "fr", None, "und", ""])) for _ in range(300)]
    rows += [("new york of the", "en")] * 200
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    assert made(df, least=least, first=first) == slow(rows, least, first)


def test_awkward_rows(awkward, nothing):
    assert made(awkward, least=2) == slow([(t, lang) for _, t, lang, *_ in AWKWARD], 2)
    assert made(nothing) == []


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_007
    counts = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 1), ("en", "b", 1, big + 5)], "lang string, gram string, size int, n long")
    totals = spark.createDataFrame([("en", 10 * big + 3)], "lang string, n long")
    row = C.scored(counts, totals).first()
    assert row.score == 1000 * big * (10 * big + 3) // ((big + 1) * (big + 5))


def test_the_filter_never_wrongly_says_no():
    words = pa.array([f"w{i}" for i in range(2000)])
    hashes = C._hashes(words)
    lang = C._hashes(pa.array(["en"]))[0]
    one, two = C._bits(C._pair(np.full(1999, lang), hashes[:-1], hashes[1:]))
    bits = np.zeros(1 << C.FILTER_BITS, np.uint8)
    bits[one] = bits[two] = 1
    allowed = np.packbits(bits, bitorder="little")
    text = pa.array([" ".join(words.to_pylist())])
    assert C.Stretch(pa.array(["en"]), text, np.array([1]))._good(allowed)[:-1].all()
    back = pa.array([" ".join(reversed(words.to_pylist()))])
    assert C.Stretch(pa.array(["en"]), back, np.array([1]))._good(allowed).mean() < 0.01
