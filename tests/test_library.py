"""Operators that the catalogue's queries do not reach: files, storage, streams, options and edge cases."""

import io
import os
import subprocess
import sys
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import genres as G
from vellum.functions import metadata as M
from vellum.functions import names as N
from vellum.functions import text as T
from vellum.functions import vocab
from vellum.operators import authors as A
from vellum.operators import genres as GO
from vellum.operators import index as I
from vellum.operators import ingest as ING
from vellum.operators import series as SE
from vellum.operators import signature as S
from vellum.operators.graph import components
from vellum.operators.number import numbered
from vellum.operators.skew import salted_join
from vellum.sources import readers, sinks
from vellum.streaming import incremental

REPO = Path(__file__).resolve().parent.parent


def value(spark, given, made, kind="string"):
    return spark.createDataFrame([(given,)], f"v {kind}").select(made(F.col("v")).alias("o")).first()["o"]


# ---- text ----


@pytest.mark.parametrize(
    ("given", "made", "expected"),
    [
        ("a  b　\u0085 c ", T.collapse, "a b c"),
        ("2° chance", T.norm_key, "2 chance"),
        ("2º chance", T.norm_key, "2 chance"),
        ("1ª Edição — Vol. 2", T.norm_key, "1 edicao vol 2"),
        ("O LIMIAR DO INFERNo", lambda c: T.is_shouty(c).cast("string"), "false"),
        ("EUA hoje", lambda c: T.is_shouty(c).cast("string"), "false"),
        ("a/b\\c:d*e?f\"g<h>i|j\x01k", T.sanitize, "abcdefghijk"),
        ("ção" * 60, lambda c: T.left_bytes(c, 9), "çãoçã"),
        (" Ações - Vol._", T.safe_dir, "Acoes - Vol"),
        ("x\nlast \n\n", T.last_line, "last"),
        ("", T.last_line, "erro desconhecido"),
        ("1, 2,,1 ", lambda c: F.array_join(T.id_list(c), "|"), "1|2"),
        ("literatura civil", G.title_case, "Literatura CIVIL"),
        ("suspense e mistério", lambda c: F.array_join(G.parts(F.array(c)), "|"), "suspense|"),
        ("A Comedia Humana - Vol. 3", lambda c: N.parse_filename(c)["series"], ""),
        ("2.50", lambda c: T.format_index(c.cast("double")), "2.5"),
        ("7", lambda c: T.format_index(c.cast("double")), "07"),
    ],
)
def test_text(spark, given, made, expected):
    assert value(spark, given, made) == expected


def test_tokens_drop_letters_without_splitting(spark):
    assert value(spark, "Straße naïve 漢字x áb—c", lambda c: F.array_join(T.tokens(c), " ")) == "strae naive x a b c"


def test_lists(spark):
    rows = spark.createDataFrame([(["b", "A "], ["a", "c", ""])], "x array<string>, y array<string>")
    assert rows.select(T.union_sorted(F.col("x"), F.col("y"))).first()[0] == ["A", "b", "c"]
    assert rows.select(T.same_set(F.col("x"), F.array_sort(F.reverse("x")))).first()[0]


def test_unknown_target():
    with pytest.raises(ValueError, match="unknown target"):
        N.target("nowhere")
    assert N.target("Kavita") is N.TARGETS["kavita"][0]


# ---- signatures ----


def slow_fnv(data):
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h


def test_fnv_vectors():
    data = np.frombuffer(b"hello", np.uint8)
    assert int(S.fnv1a(data, np.array([0, 1, 5]), np.array([5, 3, 5]))[0]) == 0xA430D84680AABD0B
    assert [int(x) for x in S.fnv1a(data, np.array([0, 1, 5]), np.array([5, 3, 5]))] == [slow_fnv(b"hello"), slow_fnv(b"el"), slow_fnv(b"")]


def test_sampled_fnv_matches_slow(spark):
    words = [f"word{i * i % 97}" for i in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:57])), (3, " ".join(words[:58])), (4, None)]
    found = {r.id: r for r in S.sampled_fnv(spark.createDataFrame(rows, "doc_id long, text string"), sample=4).collect()}
    hashes = {slow_fnv((" ".join(words[i : i + 8]) + " ").encode()) for i in range(293)}
    assert [x % (1 << 64) for x in found[1].sig] == sorted(h for h in hashes if h % 4 == 0)
    assert found[2].sig is None and found[2].n_words == 57 and found[3].sig is not None and found[4].n_words == 0


def test_self_join_loses_no_pair(spark):
    rnd = np.random.default_rng(5)
    common = list(range(1000, 1030))  # a passage that all share
    base = [sorted({*rnd.integers(0, 400, 40).tolist(), *common}) for _ in range(12)]
    sets = [s for b in base for s in (b, b[:-1], b[2:], [*b, 9999 + len(b)])]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id long, sig array<bigint>")
    for threshold in (0.5, 0.85):
        expected = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) >= threshold}
        assert {(r.a, r.b) for r in S.self_join(df, threshold).collect()} == expected
        crossed = {(r.a, r.b) for r in S.cross_join(df, df, threshold).collect()}
        assert crossed == expected | {(b, a) for a, b in expected} | {(i, i) for i in range(len(sets))}


def test_links_connect_what_all_pairs_connect(spark):
    rnd = np.random.default_rng(6)
    sets = []
    for b in range(8):
        base = sorted({*rnd.integers(1000 * b, 1000 * b + 900, 60).tolist()})
        sets += [sorted({*base, *rnd.integers(10**6, 10**7, rnd.integers(0, 9)).tolist()}) for _ in range(10)]
        chain = [base[i : i + 40] + [9000 + 100 * b + i] for i in range(0, 12, 2)]
        sets += chain
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id long, sig array<bigint>")
    for threshold in (0.6, 0.85):
        every, some = S.self_join(df, threshold).select("a", "b"), S.linked(df, threshold)
        assert {tuple(r) for r in some.collect()} <= {tuple(r) for r in every.collect()}
        assert sorted(map(tuple, components(some).collect())) == sorted(map(tuple, components(every).collect()))


def test_a_large_cluster_of_near_copies_makes_few_links(spark):
    base, n = list(range(200)), 3000
    df = spark.range(0, n).select("id", F.concat(F.array(*map(F.lit, base)).cast("array<bigint>"), F.array(F.col("id") + 10_000, F.col("id") + 20_000)).alias("sig"))
    links = S.linked(df)
    assert links.count() == n - 1 and {r.root for r in components(links).collect()} == {0}


def test_jaccard_bounds(spark):
    rows = spark.createDataFrame([([1, 2], [2, 3]), ([1], [1]), ([], [1]), (None, [1])], "a array<bigint>, b array<bigint>")
    assert [r[0] for r in rows.select(S.jaccard(F.col("a"), F.col("b"))).collect()] == [1 / 3, 1.0, 0.0, 0.0]


def test_components_of_no_edges(spark):
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


# ---- index ----

ENTRY = {"words": 1, "sig": None, "title": "", "author": "", "series": "", "tags": []}


def entries(spark, rows):
    return spark.createDataFrame([(p, s, m, 1, None, "", "", "", []) for p, s, m in rows], I.ENTRY)


def test_index_build_saves_and_loads(spark, tmp_path):
    scan = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 3, 3)], "path string, size long, mod_time long")
    seen = []

    def compute(rows):
        seen.append(sorted(r.path for r in rows.collect()))
        return entries(spark, [tuple(r) for r in rows.collect()])

    index, counts = I.build(scan, None, compute)
    assert tuple(counts.first()) == (3, 3, 0)
    path = str(tmp_path / "index")
    I.save(index, path)
    again = spark.createDataFrame([("a", 1, 1), ("b", 2, 9), ("d", 4, 4)], "path string, size long, mod_time long")
    new, counts = I.build(again, I.load(spark, path), compute)
    assert tuple(counts.first()) == (3, 2, 1) and seen[-1] == ["b", "d"]
    assert sorted((r.path, r.mod_time) for r in new.collect()) == [("a", 1), ("b", 9), ("d", 4)]
    spark.range(1).selectExpr("1 as version").write.mode("overwrite").json(f"{path}/manifest")
    assert I.load(spark, path).count() == 0 and I.load(spark, str(tmp_path / "none")).count() == 0


def test_an_index_saves_over_itself_and_a_torn_save_leaves_it(spark, tmp_path):
    path = str(tmp_path / "index")
    I.save(entries(spark, [("a", 1, 1), ("b", 2, 2)]), path, "root")
    I.save(I.load(spark, path).where("path = 'a'"), path)
    assert [r.path for r in I.load(spark, path).collect()] == ["a"]
    with pytest.raises(Exception, match="boom"):
        I.save(I.load(spark, path).withColumn("title", F.raise_error(F.lit("boom")).cast("string")), path)
    assert [r.path for r in I.load(spark, path).collect()] == ["a"]
    for _ in range(3):
        I.save(I.load(spark, path), path)
    assert sum(p.name.startswith("entries-") for p in (tmp_path / "index").iterdir()) <= 3  # the last two, and the torn one


def test_streaming_epochs_are_merged_and_repeat_without_effect(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "MERGE_AFTER", 3)
    path, computed = str(tmp_path / "index"), []

    def compute(rows):
        held = [tuple(r) for r in rows.collect()]
        computed.append(len(held))
        return entries(spark, held)

    for epoch in range(9):
        rows = spark.createDataFrame([("same", 1, 1), ("grows", epoch, epoch), (f"new{epoch}", 1, 1)], "path string, size long, mod_time long")
        for _ in range(2):
            incremental.upsert(rows, path, compute, epoch)
    assert computed == [3] + [2] * 8
    assert sorted((r.path, r.size) for r in incremental.current(spark, path).collect()) == sorted([("same", 1), ("grows", 8), *((f"new{i}", 1) for i in range(9))])
    held = {p.name for p in (tmp_path / "index").glob("*/bucket=*")}
    assert len(held) >= 9 and all(len(list((tmp_path / "index").glob(f"*/{b}"))) <= 8 for b in held)
    assert len(list((tmp_path / "index").glob("counts-*"))) <= 8


def test_streaming_index(spark, tmp_path):
    source = tmp_path / "scans"
    schema = "path string, size long, mod_time long"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        incremental.start(stream, str(tmp_path / "index"), str(tmp_path / "cp"), lambda r: entries(spark, [tuple(x) for x in r.collect()])).awaitTermination()

    arrive([("a", 1, 1), ("a", 2, 2), ("b", 1, 1)])
    arrive([("b", 5, 5), ("c", 1, 1)])
    assert sorted((r.path, r.size) for r in incremental.current(spark, str(tmp_path / "index")).collect()) == [("a", 2), ("b", 5), ("c", 1)]


def test_an_epoch_reads_the_buckets_that_it_touches_alone(spark, tmp_path, monkeypatch):
    path, read = str(tmp_path / "index"), []
    compute = lambda rows: entries(spark, [tuple(r) for r in rows.select("path", "size", "mod_time").collect()])
    scan = lambda rows: spark.createDataFrame(rows, "path string, size long, mod_time long, deleted boolean")
    incremental.upsert(scan([(f"p{i}", 1, 1, None) for i in range(200)]), path, compute, 0)
    rows = incremental._rows
    monkeypatch.setattr(incremental, "_rows", lambda s, p, state, buckets: (read.append(buckets), rows(s, p, state, buckets))[1])
    incremental.upsert(scan([("p7", 2, 2, None), ("p8", 1, 3, True), ("p9", 1, 1, None), ("p8", 1, 2, None), ("none", 1, 1, True)]), path, compute, 1)
    assert len(read) == 1 and 1 <= len(read[0]) <= 4
    held = {r.path: r.size for r in incremental.current(spark, path).collect()}
    assert len(held) == 199 and "p8" not in held and held["p7"] == 2
    incremental.upsert(incremental.vanish(spark, path, spark.createDataFrame([("p1",), ("p7",)], "path string")), path, compute, 2)
    incremental.upsert(scan([("p8", 5, 9, False)]), path, compute, 3, merge_after=1)
    assert sorted((r.path, r.size) for r in incremental.current(spark, path).collect()) == [("p1", 1), ("p7", 2), ("p8", 5)]
    counted = {r.genre: r.freq for r in I.genre_frequencies(incremental.current(spark, path)).collect()}
    assert {r.genre: r.freq for r in incremental.genre_frequencies(spark, path).collect()} == counted


# ---- files ----


def epub(path, opf, pages):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("content.OPF", opf)
        for name, html in pages.items():
            z.writestr(name, html)
    path.write_bytes(buffer.getvalue())


def test_library_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "_duplicatas").mkdir()
    epub(tmp_path / "sub" / "A b+c.EPUB", "<dc:title>T</dc:title>", {"b.xhtml": "<p>two</p>", "a.html": "<b>one</b>", "x.css": "no"})
    (tmp_path / "broken.epub").write_bytes(b"not a zip")
    (tmp_path / ".hidden.epub").write_bytes(b"")
    (tmp_path / "m.mobi").write_bytes(b"123")
    (tmp_path / "_duplicatas" / "q.epub").write_bytes(b"x")
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    assert names(readers.library(spark, str(tmp_path))) == ["A b+c.EPUB", "broken.epub", "q.epub"]
    got = readers.inputs(spark, str(tmp_path))
    assert names(got) == ["A b+c.EPUB", "broken.epub", "m.mobi"]
    assert {(r.stem, r.ext, r["size"]) for r in got.collect() if r.ext == ".mobi"} == {("m", ".mobi", 3)}
    books = {r.path.rsplit("/", 1)[1].replace("%20", " "): r for r in readers.epub_contents(spark, str(tmp_path)).collect()}
    assert books["A b+c.EPUB"].text.split() == ["one", "two"] and "<dc:title>" in books["A b+c.EPUB"].opf
    assert books["broken.epub"].text is None


def test_folders_and_files_with_underscores_at_any_depth(spark, tmp_path):
    for folder in ("_a", "x/y/_b/z/_c", "x/.hidden/_d", "x/y/w"):
        (tmp_path / folder).mkdir(parents=True)
        epub(tmp_path / folder / "book.epub", "", {})
        epub(tmp_path / folder / "_under.EPUB", "", {})
    found = sorted(r.path.split(str(tmp_path) + "/")[1] for r in readers.library(spark, str(tmp_path)).collect())
    assert found == sorted(f"{d}/{n}" for d in ("_a", "x/y/_b/z/_c", "x/y/w") for n in ("book.epub", "_under.EPUB"))
    read = sorted(r.path.split(str(tmp_path) + "/")[1] for r in readers.epub_contents(spark, str(tmp_path)).where("opf = ''").collect())
    assert read == found


def test_torn_archives_do_not_fail_the_read(spark, tmp_path):
    rnd = np.random.default_rng(0)
    for i in range(12):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("content.opf", "<dc:title>T</dc:title>" * 500)
            z.writestr("a.html", "".join(map(chr, rnd.integers(97, 123, 3000))))
        data = bytearray(buffer.getvalue())
        if i:
            at = 30 + 40 * i
            data[at : at + 60] = rnd.bytes(60)
        (tmp_path / f"{i:02}.epub").write_bytes(data if i % 4 != 3 else data[: len(data) // 2])
    rows = sorted((r.path, r.opf is not None) for r in readers.epub_contents(spark, str(tmp_path)).collect())
    assert len(rows) == 12 and rows[0][1] and not all(ok for _, ok in rows)


def test_lists_from_files(spark, tmp_path):
    (tmp_path / "c.tsv").write_text('id\tbooks\tname\n1\t2\t"A" b\tc\n')
    (tmp_path / "n.txt").write_text(" Ana \nANA\n\nRui\n")
    (tmp_path / "v.tsv").write_text("Foo\tBar\nbaz\t\n")
    (tmp_path / "t.tsv").write_text("p\tX, x\n")
    assert [tuple(r) for r in readers.catalog(spark, str(tmp_path / "c.tsv")).collect()] == [("1", 2, '"A" b\tc')]
    assert sorted(r.name for r in readers.names(spark, str(tmp_path / "n.txt")).collect()) == ["ana", "rui"]
    assert [tuple(r) for r in readers.tags(spark, str(tmp_path / "t.tsv")).collect()] == [("p", ["X"])]
    table = vocab.load(spark, str(tmp_path / "v.tsv"))
    assert table == {"foo": "Bar", "baz": ""}
    assert value(spark, "FOO", lambda c: F.array_join(G.clean_en(F.array(c, F.lit("Baz")), table), "|")) == "Bar"


def test_sinks(spark, tmp_path):
    found = A.groups(A.resolve(spark.createDataFrame([(1, "1", 2, "ANA LIMA"), (2, "2", 1, "Ana Lima")], "ord long, id string, books int, name string")))
    sinks.write_sql(A.merge_sql(found), str(tmp_path / "sql"))
    lines = [r.sql for r in sinks.read_sql(spark, str(tmp_path / "sql")).orderBy("part", "line").collect()]
    assert lines[0] == "START TRANSACTION;" and lines[-1] == "COMMIT;"
    assert lines[1] == "UPDATE book_metadata_author_mapping SET author_id = 2 WHERE author_id IN (1);" and lines[3] == "DELETE FROM author WHERE id IN (1);"
    sinks.write_log(sinks.series_log(spark.createDataFrame([("S\t", "p\nq")], "name string, path string")), str(tmp_path / "log"))
    assert "".join(p.read_text() for p in (tmp_path / "log").glob("part-*")) == "S \tp q\n"
    planned = spark.createDataFrame([("move", "a", "d/x.epub"), ("move", "b", "d/x.epub"), ("move", "c", "y.epub")], "action string, src string, dst string")
    assert sorted((r.src, r.dst) for r in sinks.unique_paths(planned).collect()) == [("a", "d/x.epub"), ("b", "d/x (1).epub"), ("c", "y.epub")]


def test_a_script_is_written_in_ordered_parts_and_a_torn_write_leaves_the_old_one(spark, tmp_path):
    path = str(tmp_path / "sql")
    rows = spark.range(0, 3000).repartition(6).select(F.lit(1).alias("step"), F.format_string("%06d", "id").alias("ord"), F.format_string("S%06d;", "id").alias("sql"))
    read = lambda: [r.sql for r in sinks.read_sql(spark, path).orderBy("part", "line").collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_sql(rows, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert read() == ["START TRANSACTION;", *(f"S{i:06};" for i in range(3000)), "COMMIT;"]
    assert len(list((tmp_path / "sql").glob("script-*/part-*"))) > 1
    with pytest.raises(Exception, match="torn"):
        sinks.write_sql(rows.withColumn("sql", F.when(F.col("ord") == "000007", F.raise_error(F.lit("torn"))).otherwise(F.col("sql"))), path)
    assert len(read()) == 3002
    for n in (10, 20):
        sinks.write_sql(rows.limit(n), path)
    assert len(read()) == 22


def test_a_book_is_read_by_ranges(spark, tmp_path):
    rnd = np.random.default_rng(2)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("image.jpg", rnd.bytes(3_000_000))
        z.writestr("content.opf", "<dc:title>T</dc:title>")
        z.writestr("a.html", "<p>" + "word " * 20_000 + "</p>")
    (tmp_path / "x.epub").write_bytes(buffer.getvalue())
    (tmp_path / "y.epub").write_bytes(b"no archive")
    one = lambda **kw: {r.path[-6:]: r for r in readers.epub_contents(spark, str(tmp_path), **kw).collect()}["x.epub"]
    small, whole = one(text=False), one()
    assert small.opf == whole.opf == "<dc:title>T</dc:title>" and small.text is None and len(whole.text.split()) == 20_000
    assert small.bytes_read < 80_000 < 100_000 < whole.bytes_read < 300_000


def test_a_walk_leaves_files_with_the_executors(spark, tmp_path, monkeypatch):
    for i in range(30):
        (tmp_path / f"d{i % 5}" / f"e{i}").mkdir(parents=True)
        (tmp_path / f"d{i % 5}" / f"e{i}" / "é b+%20.epub").write_bytes(b"x" * i)
    seen = []
    collect = type(spark.range(0)).collect
    monkeypatch.setattr(type(spark.range(0)), "collect", lambda self: (seen.append(self.columns), collect(self))[1])
    found = readers.library(spark, str(tmp_path))
    assert seen == []
    monkeypatch.undo()
    rows = found.collect()
    assert sorted(r["size"] for r in rows) == list(range(30)) and all(r.path.startswith("file:///") and r.path.endswith("/é b+%20.epub") for r in rows)
    assert all(r.mod_time > 1_600_000_000 for r in rows)
    (tmp_path / "none").mkdir()
    assert readers.library(spark, str(tmp_path / "none")).collect() == []


def test_rows_are_numbered_in_order_over_all_partitions(spark):
    rows = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(7)
    found = sorted((r.k, r.number) for r in numbered(rows, "k").collect())
    assert [n for _, n in found] == list(range(5000))
    assert numbered(rows.where("k < 0"), "k").collect() == []


def test_salted_joins_are_plain_joins(spark):
    rows = spark.range(0, 400).select((F.col("id") % 5).alias("k"), "id")
    single = spark.createDataFrame([(0, "a"), (3, "b"), (9, "c")], "k long, v string")
    for how in ("inner", "left"):
        assert sorted(map(str, salted_join(rows, single, ["k"], ["id"], how).collect())) == sorted(map(str, rows.join(single, "k", how).select("k", "id", "v").collect()))


# ---- authors, series, genres ----


def groups_of(spark, names, **options):
    rows = [(i, str(i), 1, n) for i, n in enumerate(names, 1)]
    return A.groups(A.resolve(spark.createDataFrame(rows, "ord long, id string, books int, name string"), **options)).collect()


def test_typos_depend_on_input_order_unless_symmetric(spark):
    assert len(groups_of(spark, ["Tom Perrota", "Tom Perrotta"], min_len=10)) == 1
    assert groups_of(spark, ["Tom Perrotta", "Tom Perrota"], min_len=10) == []
    assert len(groups_of(spark, ["Tom Perrotta", "Tom Perrota"], min_len=10, symmetric=True)) == 1
    assert groups_of(spark, ["Marco Borges", "Márcio Borges"], min_len=10, skip=["2"]) == []
    assert groups_of(spark, ["Tom Perrota", "Tom Perrotta"], typos=False) == []


def test_typo_blocking_matches_all_pairs(spark):
    rnd = np.random.default_rng(2)
    names = ["".join(rnd.choice(list("abc "), rnd.integers(11, 25))) for _ in range(150)]
    names += [n[:3] + "x" + n[4:] for n in names[:40]] + [n[:-2] for n in names[:20]] + [n[:2] + "zz" + n[4:] for n in names[:30]]
    rows = A.keys(spark.createDataFrame([(i, str(i), 1, n) for i, n in enumerate(names)], "ord long, id string, books int, name string"))
    held = rows.select("ord", "canon")
    a, b = held.toDF("a", "ka"), held.toDF("b", "kb")
    limit = F.when(F.length("ka") >= 20, 2).otherwise(1)
    near = (F.col("b") > F.col("a")) & (F.length("ka") >= 12) & (F.length("kb") - F.length("ka")).isin(0, 1) & (F.col("ka") != F.col("kb"))
    expected = a.crossJoin(b).where(near & (F.levenshtein("ka", "kb") <= limit))
    assert {tuple(r) for r in A.typo_pairs(rows).collect()} == {(r.a, r.b) for r in expected.collect()}


@pytest.mark.parametrize("hot", [0, 3])
def test_hot_segments_lose_no_pair(spark, hot):
    rnd = np.random.default_rng(5)
    names = [f"customer {rnd.integers(0, 3000):05d}" for _ in range(60)] + [f"a very common beginning {rnd.integers(0, 3000):04d}" for _ in range(40)]
    names += [n[:4] + n[5:] for n in names[::7]] + [n[:2] + n[3] + n[2] + n[4:] for n in names[::9]] + names[:5]
    rows = A.keys(spark.createDataFrame([(i, str(i), 1, n) for i, n in enumerate(names)], "ord long, id string, books int, name string"))
    keys = {r.canon for r in rows.collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    expected = {(a, b) for a in keys for b in keys if a != b and len(a) >= 12 and len(b) - len(a) in (0, 1) and edits(a, b) <= (2 if len(a) >= 20 else 1)}
    found = [tuple(r) for r in A.near_keys(rows, hot=hot).collect()]
    assert len(found) == len(set(found)) and set(found) == expected and any(len(a) < len(b) for a, b in expected)


def test_excluded_and_declared_series(spark):
    books = spark.createDataFrame([(f"p{i}", f"O Livro de Sharpe {i}", "B C") for i in range(3)], "path string, title string, author string")
    assert SE.detect(books).count() == 3 and SE.detect(books, exclude=["sharpe"]).count() == 0 and SE.detect(books, minimum=4).count() == 0
    assert tuple(SE.candidates(SE.detect(books)).first()) == ("b c", "Sharpe", 3, 3)


def test_genre_plan_without_people(spark):
    planned = GO.plan(spark.createDataFrame([(1, 2, "Agatha Christie")], "id long, books int, name string"))
    assert tuple(planned.select("target", "reason").first()) == ("", "raro (<3)")
    assert {r.reason: r.n for r in GO.plan_reasons(planned).collect()} == {"raro (<3)": 1}
    assert [r.sql.split(" ")[0] for r in GO.plan_sql(planned).orderBy("step").collect()] == ["DELETE"]


# ---- ingest ----


def test_ingest_outcomes(spark):
    words = [[f"{k}{i}" for i in range(100)] for k in "abc"]
    docs = spark.createDataFrame([("a", " ".join(words[0])), ("b", " ".join(words[1])), ("new", " ".join(words[2])), ("bad", "few")], "doc_id string, text string")
    sigs = S.signatures(docs)
    empty = F.lit("")
    meta = F.struct(
        empty.alias("title"), empty.alias("author"), empty.alias("author_sort"), F.when(F.col("id") == "a", "Saga").otherwise("").alias("series"), F.lit(0.0).alias("series_index"),
        F.array(F.lit("Romance"), F.lit("Numismática")).alias("tags"), empty.alias("isbn"), empty.alias("publisher"), F.lit(False).alias("has_desc"),
    )
    inputs = sigs.select(F.concat(F.lit("in/"), "id").alias("path"), F.concat(F.lit("Titulo "), "id", F.lit(" - Ana Lima")).alias("stem"), F.lit(".epub").alias("ext"), F.col("n_words").alias("words"), F.lit(10).cast("long").alias("size"), "sig", meta.alias("meta"))
    index = sigs.where("id in ('a', 'b')").select(F.concat("id", F.lit(".epub")).alias("path"), F.col("n_words").alias("words"), F.lit(20).cast("long").alias("size"), "sig", F.lit("").alias("series"), F.array(F.lit("Romance")).alias("tags"))
    answers = spark.createDataFrame([("in/new", "Title : T\nTags : War\nPublisher : P")], "path string, raw string")
    got = {r.path: r for r in ING.plan(inputs, index, answers=answers).collect()}
    assert {k: (r.status, r.action) for k, r in got.items()} == {"in/a": ("SUBSTITUI", "replace"), "in/b": ("DUPLICATA", "skip"), "in/new": ("NOVO", "move"), "in/bad": ("ERRO", "none")}
    assert got["in/a"].dest == "a.epub" and got["in/a"].why == "o novo tem série no metadado"
    new = got["in/new"]
    assert new.dest == "Titulo new/Titulo new - Ana Lima.epub" and new.enrich_args == ["--publisher", "P"]
    assert new.meta_args[-2:] == ["--tags", "Romance"] and new.genre_note == "gêneros: Romance (descartados: Numismática)"
    assert tuple(ING.summary(ING.plan(inputs, index)).first()) == (4, 1, 1, 1, 1)
    assert {r.action for r in ING.plan(inputs, index, on_duplicate="quarantine").collect()} == {"quarantine", "move", "none"}
    assert new.enrich_note == "completa: tags, publisher" or new.enrich_note == "completa: publisher"
    checked = {(r.path, r.exists) for r in ING.check(inputs.select("path", "sig"), index).collect()}
    assert checked == {("in/a", True), ("in/b", True), ("in/new", False), ("in/bad", False)}
    assert [tuple(r) for r in sinks.failures(ING.plan(inputs, index)).collect()] == [("in/bad", "não foi possível ler o texto do arquivo")]
    with pytest.raises(ValueError):
        ING.plan(inputs, index, on_duplicate="maybe")


def test_needs_work(spark):
    rows = spark.createDataFrame([("Titulo/Titulo - Ana Lima.epub", "Titulo - Ana Lima", "Titulo", "Ana Lima", "Lima, Ana"), ("x.epub", "Titulo - Ana Lima", "Titulo", "Ana Lima", "")], "path string, stem string, t string, a string, s string")
    meta = F.struct(
        F.col("t").alias("title"), F.col("a").alias("author"), F.col("s").alias("author_sort"), F.lit("").alias("series"), F.lit(0.0).alias("series_index"), F.array(F.lit("X")).alias("tags"),
        F.lit("1").alias("isbn"), F.lit("P").alias("publisher"), F.lit(True).alias("has_desc"),
    )
    books = rows.withColumn("meta", meta)
    assert [r.path for r in ING.needs_work(books).collect()] == ["x.epub"]
    assert [r.path for r in ING.needs_work(books, relayout=True).collect()] == ["x.epub"]
    assert ING.needs_work(books, enrich=True).count() == 0
    assert ING.series_inputs(books).count() == 2 and ING.genres_of(books).first().tags == []


def test_answers_fill_gaps_only(spark):
    raw = "Title : T\nTags : War\nIdentifiers : isbn:1234567890\nPublisher : P\nComments : c"
    rows = spark.createDataFrame([(raw,)], "raw string").select(M.parse_answer(F.col("raw")).alias("a"))
    meta = F.struct(F.array(F.lit("X")).alias("tags"), F.lit("").alias("isbn"), F.lit("Own").alias("publisher"), F.lit(False).alias("has_desc"))
    assert rows.select(M.gap_args(F.col("a"), meta)).first()[0] == ["--isbn", "1234567890", "--comments", "c"]


# ---- the entry ----


@pytest.mark.parametrize(("llm", "pipeline"), [(False, False), (False, True), (True, False)])
def test_the_entry_stands_without_the_training_data_part(tmp_path, llm, pipeline):
    """Without vellum/llm, the pipeline or both the entry still imports, and has every other query."""
    if llm and not (REPO / "vellum" / "llm").exists() or pipeline and not (REPO / "corpus_pipeline.py").exists():
        pytest.skip("not here")
    code = (
        "import sys, shutil, pathlib; repo, to, leave, names = pathlib.Path(sys.argv[1]), pathlib.Path(sys.argv[2]), eval(sys.argv[3]), eval(sys.argv[4]);"
        "shutil.copytree(repo / 'vellum', to / 'vellum', ignore=lambda d, n: [*leave, '__pycache__']); [shutil.copy(repo / n, to) for n in names];"
        "sys.path.insert(0, str(to)); import __spark_entry__ as e; q = e.queries(); assert 'doc_near_dups' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q);"
        "print(sum(n.startswith('op') and n[2].isdigit() for n in q))"
    )
    names = ["__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])]
    done = subprocess.run([sys.executable, "-c", code, str(REPO), str(tmp_path), repr([] if llm else ["llm"]), repr(names)], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == ("13" if llm else "0")


def test_nothing_else_imports_the_training_data_part():
    for path in (REPO / "vellum").rglob("*.py"):
        if "llm" not in path.parts:
            assert "vellum.llm" not in path.read_text(), path
