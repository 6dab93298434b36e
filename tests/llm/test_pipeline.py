"""Every stage of the pipeline, and all of it, against expected rows made without it."""

from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import AWKWARD, DOCUMENTS
from vellum.llm import language_id, mixing, quality_rules, queries, simhash
from vellum.llm.language_id import has_letter

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]
LIBRARY = Tokenizer.from_file(queries.tokenizer_path())


def table(rows):
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(NAMES, kinds, strict=True))})


def by_sql(rows, sql):
    """A query of DuckDB over these rows as `documents`."""
    con = duckdb.connect()
    con.register("documents", table(rows))
    made = con.execute(sql)
    return [dict(zip([d[0] for d in made.description], r, strict=True)) for r in made.fetchall()]


def explained(rows, model):
    return [r for r in rows if r[1] and has_letter(r[1]) and model.predict([r[1]])[0][2] <= language_id.MOST_BITS]


def kept_by_rules(rows):
    """Rows are told apart by a number in place of their id, which the rules do not look at."""
    numbered = [(i, *r[1:]) for i, r in enumerate(rows)]
    kept = {r["doc_id"] for r in by_sql(numbered, quality_rules.oracle_sql()) if r["kept"]}
    return [r for i, r in enumerate(rows) if i in kept]


def one_of_each_class(rows):
    prints = [simhash.fingerprint(r[1]) for r in rows]
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
        classes[root(i)].append(r)
    return [min(held, key=lambda r: (r[0] is None, r[0] or 0)) for held in classes.values()]


def mixed(rows):
    """Of rows without equal ones, as near-duplicates leave them; an id may repeat, so copies go by id and size."""
    copies = Counter()
    for r in by_sql(rows, mixing.ORACLE_SQL):
        copies[r["doc_id"], r["size"], r["copies"]] += 1
    out = []
    for r in rows:
        size = len([w for w in (r[1] or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w])
        times = next(n for (i, s, n), left in copies.items() if i == r[0] and s == size and left)
        copies[r[0], size, times] -= 1
        out += [r] * times
    return out


def tokens(rows):
    return Counter((r[0], tuple(LIBRARY.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)


def odd_rows(spark):
    """Whole documents, and beside them awkward ones: without an id, with one that repeats, equal, and tied in everything but their text."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(NAMES).collect()]
    some = sorted((r for r in rows if 300 < len(r[1] or "") < 3000), key=lambda r: r[0])[:12]
    shifted = [(r[0], " ".join(reversed(r[1].split(" "))), *r[2:]) for r in some]
    more = [(None, *r[1:]) for r in shifted[:4]] + [(7, *r[1:]) for r in shifted[4:8]] + [shifted[8]] * 5 + [(None, None, None, None, None)] * 3
    return [*rows, *more, *AWKWARD]


@pytest.mark.parametrize("odd", [False, True])
def test_every_stage_and_the_whole_give_the_expected_rows(spark, tmp_path, odd):
    rows = odd_rows(spark) if odd else [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(NAMES).collect()]
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = language_id.train(docs)
    for (name, stage), expect in zip(corpus_pipeline.STAGES[:4], (lambda r: explained(r, model), kept_by_rules, one_of_each_class, mixed), strict=True):
        docs = stage(spark, docs, "")
        assert docs.columns == NAMES
        rows = expect(rows)
        assert rows and Counter((r.doc_id, r.text) for r in docs.collect()) == Counter((r[0], r[1]) for r in rows), name
        docs = spark.createDataFrame(rows, DOCUMENTS)
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_tokens", "ids"]
    made = found.collect()
    assert all(r.n_tokens == len(r.ids) for r in made)
    assert Counter((r.doc_id, tuple(r.ids)) for r in made) == tokens(rows)


def test_no_rows_give_none_and_extra_columns_travel(spark, awkward, nothing):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.collect() == []
    docs = awkward.where("doc_id IN (1, 8) OR doc_id IS NULL").withColumn("extra", F.col("doc_id") * 2)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, "")
        assert "extra" in docs.columns
    assert all(r.extra == (None if r.doc_id is None else 2 * r.doc_id) for r in docs.collect())
