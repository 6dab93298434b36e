"""License scans, search, archives, chats, mixing and the pipeline."""

import gzip
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import AWKWARD
from vellum.llm import bm25, chat, language_id, licenses, mixing, queries, simhash, warc
from vellum.llm.language_id import has_letter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# ---- licenses ----


def test_markup_and_automata_agree_with_regular_expressions():
    markup = "[this (work|code) is] licensed {0,2} under [the [old]] x license [v|version] 2 [0]"
    tree = licenses.parse(markup)
    automaton, pattern = licenses.Automaton(tree), re.compile(licenses.pattern(tree))
    cases = ["licensed under x license 2", "this work is licensed a b under the old x license version 2 0 more", "this is licensed under x license 2", "licensed a b c under x license 2", "licensed under the x license v 2 0 0", "licensed under x license"]
    for case in cases:
        words = case.encode().split()
        end = automaton.longest(words, 0)
        m = pattern.match(case + " ")
        assert (end >= 0) == bool(m), case
        assert not m or end >= m[0].count(" "), case
    assert licenses.anchor(tree).strip() in b" ".join(cases[0].encode().split())
    with pytest.raises(ValueError):
        licenses.parse("[open")


def test_license_spans_and_labels():
    n, base, found = licenses.Scanner().scan("Notice: This work is licensed under the GNU General Public License, version 3. MIT License mit-license. Released under the MIT License.")
    assert base == [("gpl", 8), ("mit", 13), ("mit", 15), ("mit", 20)] and n == 22
    assert found == [("mit-notice", 17, 22), ("gpl-3.0", 1, 13)]


def written(words, rnd):
    """Words as a text that has them: capitals and punctuation between."""
    return " ".join((w.upper() if rnd.random() < 0.2 else w) + rnd.choice(["", "", "", ",", ".", " --"]) for w in words.split())


def test_a_label_of_a_text_needs_the_whole_text_and_sql_agrees(spark, tmp_path):
    rnd = random.Random(5)
    L = licenses
    mit = f"copyright c 2020 jane doe {L.MIT_GRANT} {L.MIT_NOTICE} {L.MIT_KEEP} {L.MIT_WARRANTY}"
    bsd = f"{L.BSD_GRANT} 1 {L.BSD_SOURCE} 2 {L.BSD_BINARY}"
    end = f"this software is provided by the regents {L.BSD_IMPLIED} the copyright holder or contributors {L.BSD_LIABLE}"
    third = f"3 neither the name of jane doe nor the names of its contributors {L.BSD_NAMES}"
    gnu = lambda name: f"foobar {L.GNU_FREE} {name} as published by the free software foundation either version 3 of the license or at your option any later version this program {L.GNU_HOPE} {name} for more details"
    whole = {
        "mit-text": mit, "bsd-2-clause": f"{bsd} {end}", "bsd-3-clause": f"{bsd} {third} {end}", "isc-text": f"permission to use copy modify and or {L.ISC_TEXT}", "zlib-text": L.ZLIB_TEXT,
        "unlicense": L.UNLICENSE_TEXT, "apache-2.0,apache-2.0-header": f"licensed under the apache license version 2 0 {L.APACHE_USE} http {L.APACHE_REST}",
        "gpl-header": gnu("general public license"), "lgpl-header": gnu("lesser general public license"), "agpl-header": gnu("affero general public license"),
        "mpl-2.0-header": f"{L.MPL_TEXT} https mozilla org mpl 2 0", "cc-by-nc-4.0": "released under a creative commons attribution non commercial 4 0 license", "cc-by-4.0": "available under cc by 4 0",
        "gpl-2.0": "this is distributed under the terms of the gnu general public license version 2 or later", "gpl-3.0": "software licensed under the general public license v 3 0", "mit-notice": "code is released under the mit license",
    }
    rows, expected = [], {}
    for label, text in whole.items():
        expected[len(rows)] = label
        rows.append((len(rows), "Before. " + written(text, rnd) + " After."))
        if label.count("-") and not label.endswith("notice") and "4.0" not in label and not label.startswith(("gpl-2", "gpl-3", "apache")):
            expected[len(rows)] = ""
            words = text.split()
            rows.append((len(rows), "Before. " + written(" ".join(words[: len(words) // 4] + ["missing"] + words[len(words) // 4 + 1 :]), rnd)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in licenses.summary(licenses.scan(df)).collect()}
    base = set(licenses.BASE.values())
    assert {i: ",".join(x for x in r.labels.split(",") if x not in base) for i, r in got.items()} == expected
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    made = con.execute(licenses.oracle_sql())
    names = [d[0] for d in made.description]
    assert sorted(made.fetchall()) == sorted(tuple(r[n] for n in names) for r in got.values())


def test_licenses_on_awkward_rows(awkward, nothing):
    rows = licenses.summary(licenses.scan(awkward)).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in rows) == sorted((str(a[0]), len(WORD.findall(plain(a[1])))) for a in AWKWARD)
    assert all(r.first_word is None and r.labels == "" and r.score == 0 for r in rows if not r.n_base)
    assert licenses.summary(licenses.scan(nothing)).collect() == []


# ---- search ----


def slow_search(rows, asked, k=10):
    docs = [(i, Counter(WORD.findall(plain(t)))) for i, t in rows]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for q, text in asked:
        scores = []
        for i, c in docs:
            dl = sum(c.values())
            s = sum(round(1e6 * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * dl / (total / n)))) for t in set(WORD.findall(plain(text))) if t in c)
            if s:
                scores.append((-s, i is not None, i, s))
        out += [(q, rank, i, s / 1e6) for rank, (_, _, i, s) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_search_matches_brute_force_in_small_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(bm25, "QUERIES_AT_ONCE", 7)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    asked = docs.where("doc_id % 10 = 0")
    got = found(bm25.search(bm25.build_index(docs.repartition(3)), bm25.query_terms(asked), 5))
    assert got == slow_search(rows, [r for r in rows if r[0] % 10 == 0], 5)


def test_a_shard_prunes_without_loss():
    import numpy as np

    rnd = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rnd.zipf(1.3, rnd.integers(0, 80)) % 500) for _ in range(700)]
    shard = bm25._Shard()
    for i, t in enumerate(texts):
        shard.add(i, t)
    row = shard.row().to_pylist()[0]
    numbers = {t: i for i, t in enumerate(shard.numbers)}
    df = np.zeros(len(numbers))
    for t in texts:
        for w in set(bm25.terms_of(t)) - {b""}:
            df[numbers[w]] += 1
    idf = np.log(1 + (700 - df + 0.5) / (df + 0.5))
    s = bm25.Searcher(row, numbers, idf, row["n_words"] / 700)
    for q in range(0, 700, 13):
        terms = np.array(sorted({numbers[w] for w in bm25.terms_of(texts[q]) if w}), np.int64)
        scores, ids, _ = s.best([terms], 10, [bm25.NOTHING])[0]
        expected = slow_search(list(enumerate(texts)), [(q, texts[q])])
        assert sorted(((q, r, int(i), int(x) / 1e6) for r, (i, x) in enumerate(zip(ids, scores, strict=True), 1)), key=str) == expected


def test_frequent_terms_are_read_for_few_rows(monkeypatch):
    import numpy as np

    rnd = np.random.default_rng(5)
    texts = [" ".join([f"w{x}" for x in rnd.zipf(1.3, 60) % 2000] + [f"r{i % 100}x{j}" for j in range(8)]) for i in range(4000)]
    shard = bm25._Shard()
    for i, t in enumerate(texts):
        shard.add(i, t)
    row = shard.row().to_pylist()[0]
    numbers = {t: i for i, t in enumerate(shard.numbers)}
    df = np.zeros(len(numbers))
    for t in texts:
        for w in set(bm25.terms_of(t)):
            df[numbers[w]] += 1
    s = bm25.Searcher(row, numbers, np.log(1 + (4000 - df + 0.5) / (df + 0.5)), row["n_words"] / 4000)
    left, held = [], bm25.Searcher._left
    monkeypatch.setattr(bm25.Searcher, "_left", lambda *given: left.append(held(*given)) or left[-1])
    for q in range(0, 4000, 800):
        terms = np.array(sorted({numbers[w] for w in bm25.terms_of(texts[q])}), np.int64)
        left.clear()
        scores, ids, _ = s.best([terms], 10, [bm25.NOTHING])[0]
        expected = slow_search(list(enumerate(texts)), [(q, texts[q])])
        assert sorted(((q, r, int(i), int(x) / 1e6) for r, (i, x) in enumerate(zip(ids, scores, strict=True), 1)), key=str) == expected
        assert 10 <= len(left[-1]) < 4000 / bm25.FEW


def test_search_on_awkward_rows(spark, awkward, nothing):
    rows = [(a[0], a[1]) for a in AWKWARD]
    got = found(bm25.search(bm25.build_index(awkward), bm25.query_terms(awkward.where("doc_id in (2, 3, 5, 8)"))))
    assert got == slow_search(rows, [r for r in rows if r[0] in (2, 3, 5, 8)])
    assert bm25.search(bm25.build_index(nothing), bm25.query_terms(awkward)).collect() == []
    tied = [(None, "alpha beta"), (-(1 << 63), "alpha beta"), (None, "alpha beta"), (7, "alpha beta")]
    df = spark.createDataFrame(tied, "doc_id long, text string")
    assert found(bm25.search(bm25.build_index(df), bm25.query_terms(df.where("doc_id = 7")))) == slow_search(tied, [tied[3]])
    assert bm25.search(bm25.build_index(awkward), bm25.query_terms(nothing)).collect() == []


# ---- archives ----

PAGES = [
    (1, "http://a/1", "é" * 90_000),
    (2, "http://a/b c\r\nX: y", "<p>" + "x" * 200),
    (3, None, "<p>" + "x" * 200),
    (3, None, "<p>" + "x" * 200),
    (0, "u", "<p>" + "x" * 200),
    (4, "u", None),
    (5, "u", ""),
    (6, "u", "short"),
    (7, "u", "short"),
    (None, "u", "<p>" + "x" * 200),
    (8, "u", "WARC/1.1\r\n\r\n0\r\n\r\n" * 40),
]


def test_archives_round_trip(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as id", "2 as digest").repartition(3)
    read = warc.archive(spark, df, str(tmp_path / "a"))
    rows = read.collect()
    assert len(rows) == len(PAGES)
    held = defaultdict(list)
    for i, _, html in PAGES:
        held[i].append((html or "").encode())
    for r in rows:
        if r.record_type == "response":
            assert bytes(r.payload) in held[r.id] and hashlib.sha256(r.payload).hexdigest() == r.digest
    assert warc.unresolved(read).isEmpty() and read.where("record_type = 'revisit'").count() == 4
    assert len({r.record_id for r in rows}) == len(rows)
    kinds = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.summary(read).collect())
    assert kinds == sorted(
        (str(i), len((h or "").encode()), "revisit" if len(h or "") == 203 and i != 0 else "response", 0 if len(h or "") == 203 and i != 0 else None) for i, _, h in PAGES
    )


def test_archives_are_genuine_and_segmented(spark, tmp_path):
    df = spark.createDataFrame(PAGES[:2], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "a"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "a").glob("part-*"))
    records = list(warc.parse(data))
    assert data.count(b"WARC/1.1\r\nWARC-Type") == len(records)
    assert records[0][0][b"warc-type"] == b"warcinfo"
    assert b"http://a/b%20c%0D%0AX:%20y" in {f.get(b"warc-target-uri") for f, _ in records}
    parts = [(f, bytes(b)) for f, b in records if b"warc-segment-number" in f]
    assert [int(f[b"warc-segment-number"]) for f, _ in parts] == list(range(1, len(parts) + 1)) and len(parts) > 5
    assert int(parts[-1][0][b"warc-segment-total-length"]) == sum(len(b) for _, b in parts)
    assert warc.decode_body(b"".join(b for _, b in parts)) == PAGES[0][2].encode()


def test_each_record_can_be_read_from_its_offset(spark, tmp_path):
    rows = [(i, f"http://a/{i}", f"<p>{i}" + "x" * 40_000) for i in range(5)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "a"), records_per_file=7)
    files = sorted((tmp_path / "a").glob("part-*"))
    assert len(files) > 1
    for path in files:
        data = path.read_bytes()
        starts = [m.start() for m in re.finditer(rb"\x1f\x8b\x08", data)]
        first = next(warc.members(data[starts[-1] :]))
        assert first.startswith(b"WARC/1.1") and first.endswith(b"\r\n\r\n")
        assert all(len(list(warc.parse(m))) == 1 for m in warc.members(data))
        assert next(warc.parse(data))[0][b"warc-type"] == b"warcinfo"


def test_a_wrong_payload_fails_the_read(spark, tmp_path):
    warc.write_archives(spark.createDataFrame(PAGES[1:2], "page_id long, url string, html string"), str(tmp_path / "a"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "a").glob("part-*"))
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "part-0").write_bytes(data.replace(b"xxx", b"xyx", 1))
    with pytest.raises(Exception, match="digest is wrong"):
        warc.read_records(spark.read.format("binaryFile").load(str(tmp_path / "b"))).collect()


def test_a_lost_segment_fails_the_read(spark, tmp_path):
    df = spark.createDataFrame(PAGES[:1], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "a"))
    path = next((tmp_path / "a").glob("part-*"))
    data = gzip.decompress(path.read_bytes())
    at = [m.start() for m in re.finditer(rb"WARC/1\.1\r\nWARC-Type: continuation", data)]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "part-0").write_bytes(data[: at[1]] + data[at[2] :])
    with pytest.raises(Exception, match="missing, repeated or torn"):
        warc.read_records(spark.read.format("binaryFile").load(str(tmp_path / "b"))).collect()


def test_no_pages(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.summary(warc.archive(spark, df, str(tmp_path / "a"))).collect() == []


# ---- chats ----


def test_events_fold_into_final_messages(spark):
    log = spark.createDataFrame(
        [
            (1, 1, "message", "user", "hi"), (1, 2, "message", "assistant", "bad "), (1, 3, "delta", None, "start"), (1, 4, "regenerate", None, None), (1, 5, "delta", None, "good "), (1, 6, "delta", None, "end"),
            (1, 7, "message", "user", "typo"), (1, 8, "edit", None, "fixed"), (1, 9, "delta", None, "!"), (2, 1, "delta", None, "early"), (2, 2, "message", None, None),
        ],
        "conv_id long, seq int, kind string, role string, text string",
    )
    rows = [(r.conv_id, r.role, r.text) for r in chat.messages(log).orderBy("conv_id", "message").collect()]
    assert rows == [(1, "user", "hi"), (1, "assistant", "good end"), (1, "user", "fixed!"), (2, "", "early"), (2, "", "")]


def test_any_text_comes_back(spark):
    tricky = ["", "\\", "\\l", "\\b<", "<turn>", "</turn>\\", "<loss>a<text>b", "\\\\b\\l<", "a\nb", "😀<"]
    rows = [(1, i, "assistant" if i % 2 else "us<er\\", t) for i, t in enumerate(tricky)] + [(2, None, None, None), (2, 1, "assistant", "x"), (2, 1, "assistant", "x"), (None, 1, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "'z' as seq", "'z' as kind")
    rendered = chat.render(chat.messages(chat.events_of_turns(df)))
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in rendered.select("conv_id", chat.read_back(rendered["formatted"]).alias("turns")).collect()}
    assert back[1] == [(r or "", t) for _, _, r, t in rows[: len(tricky)]]
    assert back[2] == [("", ""), ("assistant", "x"), ("assistant", "x")] and back[None] == [("user", "y")]
    digests = {r.conv_id: r for r in chat.digests(rendered).collect()}
    loss = "".join(tricky[1::2])
    assert digests[1].loss_chars == len(loss) and digests[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and digests[1].n_turns == len(tricky)


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat.digests(chat.render(chat.messages(chat.events_of_turns(df)))).collect() == []


# ---- mixing ----


def slow_targets(sizes):
    """sizes by source, in order: pour the budget out by weight again and again."""
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), 1.5 * sum(sizes)
    while left > 1e-9 and open_:
        share = left / sum(weights[i] for i in open_)
        left = 0.0
        for i in sorted(open_):
            target[i] += share * weights[i]
            if target[i] >= 2 * sizes[i]:
                left += target[i] - 2 * sizes[i]
                target[i] = 2.0 * sizes[i]
                open_.discard(i)
    return target


def test_mix_meets_its_targets(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op10_source_mix(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    sizes = [sum(r["size"] for r in by[s]) for s in sorted(by)]
    for s, t in zip(sorted(by), slow_targets(sizes), strict=True):
        assert abs(by[s][0].target - t) < 1e-6 * max(t, 1)
        taken, largest = sum(r.taken for r in by[s]), max(r["size"] for r in by[s])
        assert abs(taken - t) <= largest
        assert all(0 <= r.taken <= 2 * r["size"] for r in by[s])


def test_mix_on_awkward_rows(awkward, nothing):
    rows = mixing.plan_mix(awkward).collect()
    assert len(rows) == len(AWKWARD) and {r["size"] for r in rows if r.doc_id in (2, 3, 4)} == {0}
    mixed = mixing.apply_mix(awkward)
    assert mixed.columns == awkward.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: sum(r.copies for r in rows if r.doc_id == i) for i in {r.doc_id for r in rows}}) - Counter()
    assert mixing.plan_mix(nothing).collect() == [] and mixing.apply_mix(nothing).collect() == []


@pytest.mark.parametrize("ids", [None, 7])
@pytest.mark.parametrize("text", ["{} some words of its own", "some words of all"])
def test_mix_meets_its_targets_where_ids_are_null_or_repeat(spark, tmp_path, ids, text):
    rows = [(ids, text.format(i), None, s, 1) for s in ("a", "b", "c") for i in range(1000)] + [(ids, None, None, "a", 0)] * 50 + [(ids, "", None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    made = mixing.plan_mix(df)
    taken = {round(r.target, 3): r.taken for r in made.groupBy("target").agg(F.sum("taken").alias("taken")).collect()}
    assert all(abs(target - n) <= 5 for target, n in taken.items()) and len(taken) == 4
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert found(made.select("doc_id", "size", "taken", "copies")) == sorted(con.execute(f"SELECT doc_id, size, taken, copies FROM ({mixing.ORACLE_SQL})").fetchall(), key=str)
    mixed = mixing.apply_mix(df).groupBy("source", "text").count()
    assert {(r.source, r.n) for r in mixed.where("text != ''").groupBy("source").agg(F.sum("count").alias("n")).collect()} == {("a", 2000), ("b", 1667), ("c", 833)}


def test_one_way_with_few_and_with_many_sources(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    few = found(mixing.plan_mix(df))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert found(mixing.plan_mix(df)) == few


# ---- pipeline ----


def test_stages_obey_their_contract(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    stages = corpus_pipeline.STAGES
    by_language = stages[0][1](spark, docs, "")
    model = language_id.train(docs)
    explained = {r.doc_id for r in docs.collect() if has_letter(r.text) and model.predict([r.text])[0][2] <= language_id.MOST_BITS}
    assert by_language.columns == columns and {r.doc_id for r in by_language.collect()} == explained
    by_rules = stages[1][1](spark, by_language, "")
    assert by_rules.columns == columns and by_rules.count() <= by_language.count()
    rows = by_rules.collect()
    apart = stages[2][1](spark, spark.createDataFrame(rows, docs.schema), "")
    prints = [simhash.fingerprint(r.text) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= simhash.RADIUS:
                parent[root(i)] = root(j)
    classes = defaultdict(list)
    for i, r in enumerate(rows):
        classes[root(i)].append(r.doc_id)
    assert sorted(r.doc_id for r in apart.collect()) == sorted(map(min, classes.values()))
    mixed = stages[3][1](spark, apart, "")
    assert mixed.columns == columns
    counts = Counter(r.doc_id for r in mixed.collect())
    planned = {r.doc_id: r.copies for r in mixing.plan_mix(apart).collect()}
    assert counts == Counter({k: v for k, v in planned.items() if v})
    encoded = stages[4][1](spark, mixed, "")
    assert Counter(r.doc_id for r in encoded.collect()) == counts


def test_the_pipeline_runs_whole(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "n_tokens", "ids"]


def test_the_pipeline_on_awkward_and_no_rows(spark, awkward, nothing):
    for docs in (awkward, nothing):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
        docs.collect()
