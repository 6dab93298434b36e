"""What moves: long columns stay where they lie, and numbers stand for paths."""

import re

import numpy as np
from pyspark.sql import functions as F

from vellum.functions import metadata as M
from vellum.functions import text as T
from vellum.operators import authors as A
from vellum.operators import ingest as ING
from vellum.operators import signature as S
from vellum.plans import composed


def books(spark, sets, first):
    meta = composed.book_meta(F.lit("T"), F.lit("A"), F.lit(""), F.lit(0.0))
    rows = spark.createDataFrame([(first + i, s) for i, s in enumerate(sets)], "number long, sig array<bigint>")
    return rows.select("number", F.format_string("p%03d.epub", "number").alias("path"), F.lit("T - A").alias("stem"), F.lit(".epub").alias("ext"), F.lit(100).alias("words"), F.lit(10).alias("size"), "sig", meta.alias("meta"))


def test_a_plan_moves_no_signatures_and_numbers_match_as_paths_do(spark):
    sets = [[*range(b, b + 100), *extra] for b in (0, 1000, 2000) for extra in ([], [7000 + b], [8000 + b, 8001 + b])] + [None, []]
    inputs, index = books(spark, sets, 0), books(spark, sets[:2], 500).select("number", "path", "words", "size", "sig", F.lit("").alias("series"), F.array(F.lit("x")).alias("tags"))
    by_path = ING.matches(inputs.drop("number"), index.drop("number"), dedupe_within_batch=True)
    by_number = ING.matches(inputs, index, dedupe_within_batch=True)
    found = sorted(map(tuple, by_number.collect()))
    assert found == sorted(map(tuple, by_path.collect())) and [(p, d) for p, d, _ in found] == [(f"p{a:03}.epub", f"p{b:03}.epub") for a, b in ((0, 500), (1, 501), (2, 500), (4, 3), (5, 3), (7, 6), (8, 6))]
    planned = ING.plan(inputs, index, dedupe_within_batch=True, best=by_number)
    assert not re.search(r"Project \[[^\n]*(?<!size\()\bsig#", planned._jdf.queryExecution().optimizedPlan().toString())


def test_signatures_keep_columns_without_a_join(spark):
    made = S.signatures(spark.createDataFrame([(1, "a b", "x"), (1, None, "y")], "doc_id long, text string, source string"), keep=("source",))
    assert sorted(map(tuple, made.collect())) == [(1, 0, None, "y"), (1, 2, None, "x")] and "Join" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_rests_of_keys_move_in_blocks(spark):
    keys = ["abcdefghijkl", "abcdefghijkx", "abcdefghijklm", "ção ção ção ção çãos", "ção ção ção ção çã", "aaaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaaa", "zyxwvutsrqponmlkjihgfedc"]
    rows = A.keys(spark.createDataFrame([(i, str(i), 1, k) for i, k in enumerate(keys)], "ord long, id string, books int, name string"))
    held = A._held(rows)
    met = A._met(held)
    at = {r.canon: r["at"] for r in held.collect()}
    lonely = {at[rows.where(f"ord = {i}").first().canon] for i in (7,)}
    assert not lonely & {r.mark >> 3 for r in met.collect()} and {r.mark >> 3 for r in met.collect()} >= {at["abcdefghijkl"], at["abcdefghijkx"], at["abcdefghijklm"]}
    wide = max(len(x) for x in A.rests(np.array([[ord(c) for c in keys[7]]], np.uint32))[1][0])
    assert wide == 24 * 23 // 2 and A._met(held.limit(0)).collect() == []
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and A.CHUNK * 8 <= 1 << 16


def test_a_rest_has_one_hash_whichever_key_it_is_of():
    code = lambda s: np.array([[ord(c) for c in s]], np.uint32)
    for key in ("maria bapcedhuhnwnkrk", "maria bapcedhuh"):
        made = {side: set(h.ravel().tolist()) for h, side in A.rests(code(key))}
        longer = {side: set(h.ravel().tolist()) for h, side in A.rests(code(key + "x"))}
        assert made[A.SHORTER] & longer[A.LONGER if len(key) < 20 else A.LONGER + A.EQUAL]


def test_shelved_books_are_of_one_read(spark):
    made = composed._shelved(spark, "/root/testdata/sf0.001")
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString() and made.columns == ["path", "stem", "meta"]


def test_a_package_document_is_put_together_once(spark):
    from html.entities import html5

    xml = F.concat(F.lit("<dc:title>"), F.col("t"), F.lit("</dc:title><dc:publisher>"), F.col("t"), F.lit("</dc:publisher>"))
    df = spark.createDataFrame([(" &eacute;&#233; &notit; &zz; &amp&lt; a",), (None,), ("&NotEqualTilde;",)], "t string").select(M.opf(xml).alias("m"))
    assert [(r.m.title, r.m.publisher) for r in df.collect()] == [("éé ¬it; &zz; &< a",) * 2, (None,) * 2, (html5["NotEqualTilde;"],) * 2]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(<dc:title>") == 1
    held = spark.range(1).select(T.tables(html5, M.INITIALS).alias("m")).first().m
    assert {k: v for x in held.values() for k, v in x.items()} == html5 and len(held) + max(map(len, held.values())) < len(html5) / 4
