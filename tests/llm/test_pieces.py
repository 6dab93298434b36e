"""SentencePiece against its library."""

import hashlib
import tempfile

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import AWKWARD
from vellum.llm import pieces, queries

PATH = queries.piece_model_path()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
with tempfile.NamedTemporaryFile(suffix=".pieces", delete=False) as compiled:
    compiled.write(pieces.Pieces.compile(PATH))
VOCABULARY = pieces.Pieces(compiled.name)
CODEC = pieces.Codec(VOCABULARY, LIBRARY)


def library(text):
    return LIBRARY.encode(text or "", add_bos=False, add_eos=True)


def expected(text):
    ids = library(text)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids))


@given(st.text(max_size=80) | st.text(alphabet="  \n\t▁aeinthé漢😀́<0x4s>/", max_size=60))
@settings(max_examples=500, deadline=None)
def test_any_text_encodes_as_the_library_does(text):
    ids = library(text)
    assert CODEC.encode(text) == ids
    assert CODEC.decode(ids) == LIBRARY.decode(ids)
    assert CODEC.digests(CODEC.encode_parts(text)) == expected(text)
    heap = [i for words in VOCABULARY.segments(text) for w in words for i in VOCABULARY._bytes(VOCABULARY._agenda(w), np.zeros(0, int))[0].tolist()] if text.isascii() and "\n" not in text and "\t" not in text else None
    if heap is not None and all(i < pieces.BARE for i in heap):
        assert heap == ids[:-1]


@given(st.lists(st.integers(0, 31999) | st.integers(0, 265), max_size=12))
@settings(max_examples=500, deadline=None)
def test_any_ids_decode_as_the_library_decodes(ids):
    assert CODEC.decode(ids) == LIBRARY.decode(ids)


def test_a_long_word_takes_the_heap_to_the_same_ids():
    for text in ("unbelievable" * 40, "▁" * 200 + "x", " " * 1000, "é漢" * 100 + "\n" + "ab" * 90, "the the  the   " * 5000):
        assert CODEC.encode(text) == library(text)


def test_long_texts_go_in_parts(monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK", 50)
    text = "It's 12 o'clock,  isn't it?\n\n " * 40 + "é́\n" * 40 + "x" * 200 + "   "
    assert CODEC.digests(CODEC.encode_parts(text)) == expected(text)
    short = ["a b", None, "", " <s>x", "c d e "]
    assert list(map(CODEC.digests, CODEC.encode_many([*short, text, *short]))) == list(map(expected, [*short, text, *short]))


def test_a_full_memo_is_emptied():
    codec = pieces.Codec(VOCABULARY, None, memo=500)
    for text in ("one two three four", "five six seven eight", "one nine two ten eleven twelve thirteen"):
        assert codec.digests(codec.encode_parts(text)) == expected(text)


def test_a_difference_from_the_library_raises():
    class Other:
        def encode(self, texts, num_threads):
            return [[1] for _ in texts]

    with pytest.raises(RuntimeError, match="differ"):
        pieces.Codec(VOCABULARY, Other()).encode("one two")


def test_query_on_awkward_rows(spark, awkward, nothing):
    files = pieces.prepare(spark, PATH)
    rows = sorted(map(tuple, pieces.digests(awkward, files).collect()), key=str)
    assert rows == sorted(((i, *expected(t)) for i, t, *_ in AWKWARD), key=str)
    back = pieces.decode(pieces.encode(awkward.where("doc_id in (1, 3, 7)"), files), files).collect()
    texts = {a[0]: a[1] for a in AWKWARD}
    assert len(back) == 4 and all(r.text == LIBRARY.decode(library(texts[r.doc_id])) for r in back)
    assert pieces.digests(nothing, files).collect() == []


def test_query_on_whole_tables(spark, sf):
    rows = queries.op12_sentencepiece_codec(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts) and all(tuple(r)[1:] == expected(texts[r.doc_id]) for r in rows)
