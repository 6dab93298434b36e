"""SimHash classes against brute force."""

import random

import numpy as np
import xxhash

from vellum.llm import simhash


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(rows):
    prints = [slow_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= simhash.RADIUS:
                parent[root(i)] = root(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(root(i), []).append(rows[i][0])
    return sorted((rows[i][0], f"{prints[i]:016x}", min(x for x in members[root(i)] if x is not None)) for i in range(len(rows)))


def corpus():
    rnd, rows = random.Random(3), []
    for i in range(60):
        words = [rnd.choice("alpha beta GAMMA délta epsilon zeta eta theta 漢字 iota kappa".split()) for _ in range(rnd.randint(0, 300))]
        for _ in range(rnd.randint(1, 4)):
            rows.append((len(rows), rnd.choice(" \n\t").join(words)))
            if words:
                words[rnd.randrange(len(words))] = f"w{rnd.randint(0, 9)}"
    return [*rows, (900, None), (901, ""), (902, " \n"), (903, "Three words\x1chere"), (3, rows[3][1]), (904, "long " * 50_000)]


def test_fingerprints_match_the_definition():
    for _, text in corpus():
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_stars_join_all_links_within_the_radius():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = np.concatenate([base ^ (np.uint64(1) << rnd.integers(0, 64, 300, dtype=np.uint64)) for _ in range(9)])
    every = np.unique(np.concatenate([base, near]))
    member, hub = simhash.stars(every, None)
    assert len(member) == len(every) - 300 and len(set(hub.tolist())) == 300
    member, hub = simhash.stars(every[::2], every[1::2])
    assert all(int(np.uint64(a)) >= 0 for a in member.view(np.uint64)) and len(member)


def test_classes_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "'x' as component", "null as id").repartition(5)
    assert sorted(map(tuple, simhash.classes(df).collect())) == slow_classes(rows)


def test_tiles_of_a_hot_key_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_ROWS", 7)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.classes(df).collect())) == slow_classes(rows)


def test_dedup_keeps_the_smallest_of_each_class(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as row", "2 as n")
    kept = simhash.dedup(df)
    assert kept.columns == ["doc_id", "text", "row", "n"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in slow_classes(rows)})


def test_dedup_keeps_a_row_of_every_class_whatever_its_id(spark):
    rnd = random.Random(8)
    one, two, three, four, five = (" ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(120)) for _ in range(5))
    shape = "doc_id long, text string, lang string, tags map<string,string>"
    kept = lambda rows: sorted((str(r.doc_id), r.text) for r in simhash.dedup(spark.createDataFrame([(*r, None, {"a": "b"}) for r in rows], shape)).collect())
    # classes of null ids alone, a null id beside a document, an id with two texts, one of them a copy, and equal rows
    rows = [(None, one), (None, one), (None, two), (1, three), (None, three), (2, four), (2, five), (3, five), (2, three)]
    assert kept(rows) == sorted([("None", one), ("None", two), ("1", three), ("2", four), ("2", five)])
    # a single class of null ids must not let other rows without an id through
    assert kept([(None, one), (1, two), (None, two)]) == sorted([("None", one), ("1", two)])


def test_null_columns_do_not_make_rows_equal(spark):
    df = spark.createDataFrame([(1, "one text", None), (1, None, "one text")], "doc_id long, text string, lang string")
    assert sorted(map(str, simhash.dedup(df).collect())) == sorted(map(str, df.collect()))


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.classes(df).collect() == [] and simhash.dedup(df).collect() == []


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1002), (1002, 1001)]
    found = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(1, 201)}, 1001: 1000, 1002: 1000}
