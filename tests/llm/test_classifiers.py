"""Language identification, quality classification and quality rules."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from tests.llm.conftest import AWKWARD
from vellum.llm import language_id, mil_quality, queries, quality_rules


def slow_tables(texts):
    """What follows each context of up to three bytes, and how often."""
    counts = {}
    for t in texts:
        s = bytes(3) + t.encode()
        for i in range(3, len(s)):
            for order in range(4):
                seen = counts.setdefault(s[i - order : i], {})
                seen[s[i]] = seen.get(s[i], 0) + 1
    return counts


def slow_bits(counts, text):
    s, total = bytes(3) + text.encode(), 0.0
    for i in range(3, len(s)):
        scale, p = 1.0, 0.0
        for order in (3, 2, 1, 0):
            if seen := counts.get(s[i - order : i]):
                size = sum(seen.values()) + len(seen)
                if s[i] in seen:
                    p = scale * seen[s[i]] / size
                    break
                scale *= len(seen) / size
        total -= math.log2(p or scale / 256)
    return total


def slow_length(model_grams, text):
    """A text's code length by PPM, method C, from the counts of one language, in bits."""
    counts = {}
    for gram, n in zip(*model_grams, strict=True):
        g = [int(gram) // language_id.SIZE**k % language_id.SIZE for k in (3, 2, 1, 0)]
        for order in range(4):
            key = tuple(g[3 - order : 3])
            counts.setdefault(key, {})
            counts[key][g[3]] = counts[key].get(g[3], 0) + int(n)
    symbols = [0, 0, 0, *text.encode()]
    total = 0.0
    for i in range(3, len(symbols)):
        p, scale = None, 1.0
        for order in (3, 2, 1, 0):
            seen = counts.get(tuple(symbols[i - order : i]))
            if not seen:
                continue
            size, kinds = sum(seen.values()), len(seen)
            if symbols[i] in seen:
                p = scale * seen[symbols[i]] / (size + kinds)
                break
            scale *= kinds / (size + kinds)
        total -= math.log2(p if p else scale / language_id.SIZE)
    return total


def grams_of(texts):
    rows = []
    for t in texts:
        b = bytes(3) + t.encode()
        rows.append(np.array([int.from_bytes(b[i : i + 4], "big") for i in range(len(b) - 3)], np.int64))
    return np.unique(np.concatenate(rows), return_counts=True)


def test_code_lengths_match_the_definition():
    grams = [grams_of(["the cat sat on the mat", "a the an"]), grams_of(["der hund und die katze", "über öl"])]
    model = language_id.build(["de", "en"], grams, least=1)
    texts = ["The cat über 12!", "xyz 漢", "a"]
    found = model.lengths(texts) / language_id.UNIT
    for i, t in enumerate(texts):
        for k in range(2):
            assert abs(found[i, k] - slow_length(grams[k], t)) < 2e-6 * len(t.encode())


def test_a_rare_language_keeps_its_contexts_beside_a_common_one():
    rnd = np.random.default_rng(4)
    common = grams_of(["".join(chr(97 + c) for c in rnd.integers(0, 26, 400_000))])
    grams = [common, grams_of(["wyn hâf ŵyl fach y dŵr", "mae'r hâf yn wyn"])]
    model = language_id.build(["common", "rare"], grams)
    text = "mae'r ŵyl fach yn wyn; xyz 12"
    found = model.lengths([text])[0] / language_id.UNIT
    for k in range(2):
        assert abs(found[k] - slow_length(grams[k], text)) < 2e-6 * len(text.encode())


def test_long_texts_and_batches_agree_with_single_ones(monkeypatch):
    monkeypatch.setattr(language_id, "STRIP", 64)
    model = language_id.build(["de", "en"], [grams_of(["der hund und die katze"]), grams_of(["the cat sat on the mat"])], least=1)
    texts = ["the dog " * 40, "a", "und die " * 30, "", "é"]
    assert (model.lengths(texts) == np.concatenate([model.lengths([t]) for t in texts])).all()


def test_languages_of_the_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op9_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_on_awkward_rows(awkward, nothing):
    model = language_id.train(awkward, held_out=None)
    rows = {r.doc_id: r for r in language_id.classify(awkward, model).collect()}
    assert rows[2].lang_pred == rows[3].lang_pred == rows[4].lang_pred == "und" and rows[2].score == 0
    assert rows[8].lang_pred == "de" and rows[1].lang_pred in ("de", "en")
    kept = language_id.keep(awkward, model, most_bits=1000)
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD) - 3
    empty = language_id.train(nothing)
    assert language_id.classify(nothing, empty).collect() == []
    assert {r.lang_pred for r in language_id.classify(awkward, empty).collect()} == {"und"}


def test_predictions_match_the_definition_with_production_parameters(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    learned = [r for r in rows if r.lang is not None and r.text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
    names = sorted({r.lang for r in learned})
    tables = [slow_tables([r.text for r in learned if r.lang == n]) for n in names]
    found = {r.doc_id: r for r in queries.op9_language_id(spark, sf).collect()}
    assert len(found) == len(rows)
    for r in rows:
        if len(r.text or "") > 3000:
            continue
        bits = [slow_bits(t, r.text or "") for t in tables]
        expected = names[bits.index(min(bits))] if language_id.has_letter(r.text) else "und"
        assert found[r.doc_id].lang_pred == expected
        if expected != "und":
            assert abs(found[r.doc_id].score - 1 / sum(2 ** -min(b - min(bits), 1000) for b in bits)) < 1e-3


def test_texts_that_no_language_explains_go(spark):
    rnd = np.random.default_rng(2)
    prose = "the cat sat on the mat and the dog lay by the door of the old house in the sun"
    rows = [(i, " ".join(rnd.permutation(prose.split())), "en") for i in range(40)] + [(98, "漢字仮名交じり文の例" * 9, None), (99, "".join(chr(c) for c in rnd.integers(33, 0x2000, 400)), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, held_out=None)
    assert sorted(r.doc_id for r in language_id.keep(df, model).collect()) == list(range(40))
    assert language_id.keep(df, model, most_bits=1000).count() == 42


def test_every_language_is_learned(spark):
    letters = [chr(0x4E00 + 80 * i) for i in range(70)]
    rows = [(4 * i + k, (c + " " + c * 2 + " ") * 9, f"l{i:02}") for i, c in enumerate(letters) for k in range(1 + (i < 35))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, held_out=None)
    assert model.languages == [f"l{i:02}" for i in range(70)]
    found = language_id.classify(df, model).join(df, "doc_id").collect()
    assert len(found) == len(rows) and all(r.lang_pred == r.lang for r in found)


def test_passages_match_slow_counts():
    text = "Alpha beta. BETA!! 12 ### " * 40 + "\n" + "ünï code " * 30
    rows = mil_quality.encode(text)
    words = text.split()
    assert rows.shape == (-(-len(words) // mil_quality.PASSAGE), mil_quality.FEATURES)
    first = words[: mil_quality.PASSAGE]
    size = sum(len(w.encode()) for w in first)
    assert abs(rows[0, 0] - sum(c.islower() for w in first for c in w) / size) < 1e-6
    assert abs(rows[0, 11] - (1 - len(set(first)) / len(first))) < 1e-6
    assert abs(rows[0, 9] - sum("#" in w for w in first) / len(first)) < 1e-6
    assert abs(rows[0, 12] - 1) < 0.1  # nearly all repeats
    assert mil_quality.encode(None).shape == (1, mil_quality.FEATURES)


def slow_hash(word):
    total = sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(word)) % (1 << 64)
    return (total ^ total >> 29) * 0x9E3779B97F4A7C15 % (1 << 64)


def slow_encode(text):
    """The 32 features of each passage, word by word, from their definition."""
    data = (text or "").encode()
    spans = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    words = [data[a:b] for a, b in spans]
    if not words:
        return [[0.0] * 32]
    trigrams = Counter(zip(words, words[1:], words[2:], strict=False))
    kinds = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:?'\"-()", "shout": b"!"}
    kind = lambda b: "high" if b >= 0x80 else next((k for k, v in kinds.items() if b in v), "symbol")
    out = []
    for at in range(0, len(words), 64):
        part, ends = words[at : at + 64], spans[at : at + 64]
        n, size = len(part), sum(map(len, part))
        seen = [Counter(map(kind, w)) for w in part]
        total = Counter()
        for c in seen:
            total.update(c)
        shares = [total[k] / size for k in ("lower", "upper", "digit", "stop", "shout", "symbol", "high")]
        again = sum(trigrams[tuple(words[i : i + 3])] > 1 for i in range(at, at + n) if i + 2 < len(words))
        shapes = [
            size / n / 10, sum(not (c["lower"] + c["upper"] + c["high"]) for c in seen) / n, sum(c["symbol"] > 0 for c in seen) / n, sum(c["upper"] > 1 and not c["lower"] for c in seen) / n,
            1 - len(set(part)) / n, again / n, sum(len(w) <= 3 for w in part) / n, data[ends[0][0] : ends[-1][1]].count(b"\n") / n, n / 64,
        ]
        signs = [sum(slow_hash(w) >> (63 - b) & 1 for w in part) / n * 2 - 1 for b in range(16)]
        out.append([*shares, *shapes, *signs])
    return out


def slow_score(model, text):
    """The attention model passage by passage, in plain loops."""
    w = {k: v.tolist() for k, v in model.weights.items()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    times = lambda v, m: [sum(a * row[j] for a, row in zip(v, m, strict=True)) for j in range(len(m[0]))]
    hidden, energy = [], []
    for row in slow_encode(text):
        x = [(a - b) / c for a, b, c in zip(row, model.mean.tolist(), model.scale.tolist(), strict=True)]
        h = [math.tanh(a + b) for a, b in zip(times(x, w["W"]), w["b"], strict=True)]
        gate = [math.tanh(a) * sigmoid(b) for a, b in zip(times(h, w["V"]), times(h, w["U"]), strict=True)]
        hidden.append(h)
        energy.append(sum(a * b for a, b in zip(gate, w["w"], strict=True)))
    weights = [math.exp(e - max(energy)) for e in energy]
    z = [sum(a * h[j] for a, h in zip(weights, hidden, strict=True)) / sum(weights) for j in range(len(hidden[0]))]
    return sigmoid(sum(a * b for a, b in zip(z, w["c"], strict=True)) + w["d"])


def test_every_feature_matches_its_definition(monkeypatch):
    texts = [None, "", " \n", "one", "x" * 300, "Alpha beta. BETA!! 12 ###\n" * 90 + "ünï code " * 30, "a b c\t" * 500 + " " * 400 + "LONG" * 200 + " end\n\n", " ".join(f"w{i % 7}" for i in range(64 * 3))]
    whole = [mil_quality.encode(t) for t in texts]
    for t, rows in zip(texts, whole, strict=True):
        assert np.allclose(rows, slow_encode(t), atol=1e-5)
    for strip in (64, 333, 1000):  # in strips as at once
        monkeypatch.setattr(mil_quality, "STRIP", strip)
        assert all(np.allclose(mil_quality.encode(t), rows, atol=1e-6) for t, rows in zip(texts, whole, strict=True))


def test_scores_match_a_slow_forward_pass_over_the_whole_table(spark, sf):
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = mil_quality.train(documents, labels)
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = queries.op3_mil_quality(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert abs(r.score - slow_score(model, texts[r.doc_id])) < 1e-4


def test_the_gradient_is_that_of_the_loss():
    rnd = np.random.default_rng(0)
    x, starts, y = rnd.normal(size=(9, 5)), np.array([0, 4, 6]), np.array([1.0, 0.0, 1.0])
    w = {"W": rnd.normal(size=(5, 4)), "b": rnd.normal(size=4), "V": rnd.normal(size=(4, 3)), "U": rnd.normal(size=(4, 3)), "w": rnd.normal(size=3), "c": rnd.normal(size=4), "d": np.array(0.2)}

    def loss(v):
        p = mil_quality.forward(v, x, starts)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    f = mil_quality.forward(w, x, starts)
    grad = mil_quality.backward(w, x, starts, f, f["p"] - y)
    for k in w:
        at = (0,) * w[k].ndim
        up, down = {**w, k: w[k].copy()}, {**w, k: w[k].copy()}
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - grad[k][at]) < 1e-5, k


def test_quality_of_the_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op3_mil_quality(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_quality_on_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (8, 1), (None, 1), (6, None)], "doc_id long, quality int")
    model = mil_quality.train(awkward, labels, held_out=(1, 1))
    assert model.weights is not None
    assert mil_quality.classify(awkward, model).count() == len(AWKWARD)
    alone = mil_quality.train(awkward, labels.where("quality = 1"), held_out=(1, 1))
    assert {r.score for r in mil_quality.classify(awkward, alone).collect()} == {1.0}
    none = mil_quality.train(nothing, labels)
    assert mil_quality.classify(nothing, none).collect() == [] and none.share == 0.5


def test_training_reads_every_passage_of_a_row(spark, monkeypatch):
    rows = [(i, "word " * 64 * (60 + i)) for i in range(6)]
    documents, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    read = []
    monkeypatch.setattr(mil_quality, "fit", lambda bags, y: read.append(sorted(len(b) for b in bags)))
    mil_quality.train(documents, labels, held_out=(1, 1))
    mil_quality.train(documents, labels, held_out=(1, 1), sample_passages=100)
    assert read[0] == [60, 61, 62, 63, 64, 65]
    assert len(read[1]) == 2 and set(read[1]) <= set(read[0])  # whole rows, until there are enough


def slow_rules(text):
    text = text or ""
    for c in "\t\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.replace("\n", " ").split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in (i, i + 1, i + 2)}
    return words, len(covered)


def slow_base(text):
    words, repeated = slow_rules(text)
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    base = (len(words), sum(map(len, words)), sum((text or "").count(c) for c in quality_rules.SYMBOLS), len(lines) - len(set(lines)), repeated)
    return (*base, base[0] < 50 or 100 * repeated > 50 * base[0])


def test_quality_rules_match_slow_counts(spark, awkward, nothing):
    rows = quality_rules.judge(awkward).collect()
    assert sorted(((r.doc_id, *tuple(r)[1:7]) for r in rows), key=str) == sorted(((a[0], *slow_base(a[1])) for a in AWKWARD), key=str)
    assert not any(r.kept for r in rows if r.base_failed)
    kept = quality_rules.keep(awkward)
    assert kept.columns == awkward.columns
    assert quality_rules.judge(nothing).collect() == [] and quality_rules.keep(nothing).collect() == []


def test_quality_rules_on_whole_tables(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op8_quality_rules(spark, sf).collect()
    assert len(rows) == len(texts) and all(tuple(r)[1:7] == slow_base(texts[r.doc_id]) for r in rows)


def test_estimation_finds_the_good_pattern():
    n = 3
    pattern = lambda *votes: sum((v + 1) * 3 ** (n - 1 - i) for i, v in enumerate(votes))
    counts = {pattern(1, 1, 1): 900, pattern(-1, -1, 1): 60, pattern(-1, -1, -1): 30, pattern(1, 1, -1): 10}
    found = quality_rules.estimate(counts, n)
    assert found[pattern(1, 1, 1)] > 0.9 and found[pattern(-1, -1, 1)] < 0.1 and found[pattern(1, 1, -1)] > 0.5
    assert quality_rules.estimate({}, n) == {}


def slow_posteriors(patterns, rounds=60):
    """EM over whole texts, one by one: patterns, a list of votes for each text."""
    n, good, right = len(patterns), 0.9, [[0.97, 0.5] for _ in patterns[0]] if patterns else []
    odds = []
    for _ in range(rounds):
        odds = []
        for votes in patterns:
            a, b = good, 1 - good
            for v, (g, j) in zip(votes, right, strict=True):
                if v:
                    a, b = a * (g if v > 0 else 1 - g), b * (1 - j if v > 0 else j)
            odds.append(a / (a + b))
        good = min(0.99, max(0.5, (sum(odds) + 9) / (n + 10)))
        for i in range(len(right)):
            voted = [(p, v[i]) for p, v in zip(odds, patterns, strict=True) if v[i]]
            g = min(0.995, (sum(p for p, v in voted if v > 0) + 9.7) / (sum(p for p, _ in voted) + 10))
            j = min(0.995, (sum(1 - p for p, v in voted if v < 0) + 5) / (sum(1 - p for p, _ in voted) + 10))
            right[i] = [max(0.7, g), max(1 - max(0.7, g), j)]
    return odds


def test_verdicts_match_a_slow_estimation_over_the_whole_table(spark, sf):
    from pyspark.sql import functions as F

    documents = spark.read.parquet(f"{sf}/documents.parquet")
    names = list(quality_rules.rules())
    signals = quality_rules.with_signals(documents, F.col("doc_id"), "text").select("row", quality_rules.failed().alias("failed"), *(v.alias(n) for n, v in quality_rules.rules().items())).collect()
    judged = [r for r in signals if not r.failed]
    found = dict(zip([r.row for r in judged], slow_posteriors([[r[n] for n in names] for r in judged]), strict=True))
    rows = queries.op8_quality_rules(spark, sf).collect()
    assert len(rows) == len(signals)
    for r in rows:
        assert r.kept == (r.doc_id in found and found[r.doc_id] >= quality_rules.KEEP_FROM)
        if r.doc_id in found:
            assert abs(r.posterior - found[r.doc_id]) < 1e-6


def test_good_texts_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op8_quality_rules(spark, sf).join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) / len(rows) >= 0.97
