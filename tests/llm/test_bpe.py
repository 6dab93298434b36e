"""BPE against the tokenizers library."""

import hashlib
import tempfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import AWKWARD
from vellum.llm import bpe, queries

PATH = queries.tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)
with tempfile.NamedTemporaryFile(suffix=".bpe", delete=False) as compiled:
    compiled.write(bpe.Vocabulary.compile(PATH))
VOCABULARY = bpe.Vocabulary(compiled.name)
CODEC = bpe.Codec(VOCABULARY, None)


def expected(text):
    made = LIBRARY.encode(text or "", add_special_tokens=False)
    decoded = LIBRARY.decode(made.ids, skip_special_tokens=False)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(made.ids), sha(" ".join(map(str, made.ids))), sha(decoded)


@given(st.text(max_size=80) | st.text(alphabet="aAé'strevmld 1²$#<|endoftx>\ńΣςİǅẞK", max_size=60))
@settings(max_examples=400, deadline=None)
def test_any_text_encodes_as_the_library_does(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert CODEC.encode(text) == ids
    assert CODEC.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)
    assert CODEC.digests(CODEC.encode_parts(text)) == expected(text)


def test_long_texts_go_in_parts(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 50)
    monkeypatch.setattr(bpe.chunks, "__defaults__", (50,))
    text = "It's 12 o'clock, isn't it? " * 40 + "é́ " * 40
    assert CODEC.digests(CODEC.encode_parts(text)) == expected(text)
    short = ["a b", None, "", "<|endoftext|>x", "c d e"]
    assert list(map(CODEC.digests, CODEC.encode_many([*short, text, *short]))) == list(map(expected, [*short, text, *short]))


@pytest.mark.parametrize("mark", [chr(c) for c in (*range(0x1C, 0x21), 0x85, 0xA0, 0x180E, 0x200B, 0x2028, 0x3000, 0xFEFF)])
def test_a_cut_falls_on_the_tokenizers_white_space_alone(mark):
    text = "a" * (bpe.CHUNK - 1) + f"!{mark}!" * 3 + " end"
    assert CODEC.digests(CODEC.encode_parts(text)) == expected(text)


def test_merging_together_is_merging_alone():
    words = [w for w in "a aa aaa the therefore unbelievable ### é漢字 x".split()] + ["ab" * 200, "!" * 64, "!" * 65]
    assert VOCABULARY.merge_many([w.encode() for w in words]) == [VOCABULARY.merge(w) for w in words] == [LIBRARY.encode(w, add_special_tokens=False).ids for w in words]
    assert VOCABULARY.merge_many([]) == []


def test_every_pair_stands_in_one_of_its_two_places():
    rnd = np.random.default_rng(1)
    keys = rnd.integers(0, 1 << 40, 5000).tolist()
    held, numbers = bpe.Vocabulary.table(keys)
    assert sorted((int(k), int(n)) for k, n in zip(held, numbers, strict=True) if k >= 0) == sorted(zip(keys, range(5000), strict=True))
    assert bpe.Vocabulary.table([])[0].max() == -1


def test_the_lexicon_is_minimal_and_ranks_its_words(tmp_path):
    words = sorted(w.encode() for w in ("walking", "talking", "walked", "talked", "walk", "talk", "é", "a"))
    path = tmp_path / "x.lex"
    path.write_bytes(bpe.Lexicon.compile((w, [i]) for i, w in enumerate(words)))
    lexicon = bpe.Lexicon(str(path))
    assert lexicon.ranks(words).tolist() == list(range(len(words)))
    assert lexicon.ranks([b"wal", b"walkings", b"", b"zz"]).tolist() == [-1] * 4
    assert lexicon.states < sum(map(len, words)) // 2  # suffixes are shared
    ids, sizes = lexicon.flat(np.arange(len(words))[::-1])
    assert ids.tolist() == list(range(len(words)))[::-1] and sizes.tolist() == [1] * len(words)


def test_an_empty_lexicon(tmp_path):
    path = tmp_path / "x.lex"
    path.write_bytes(bpe.Lexicon.compile([]))
    assert bpe.Lexicon(str(path)).ranks([b"a", b""]).tolist() == [-1, -1]


def test_a_full_memo_is_emptied():
    codec = bpe.Codec(VOCABULARY, None, memo=500)
    for text in ("one two three four", "five six seven eight", "one nine two ten eleven twelve thirteen"):
        assert codec.digests(codec.encode_parts(text)) == expected(text)


def test_query_on_awkward_rows(spark, awkward, nothing):
    files = bpe.build_lexicon(awkward, PATH)
    rows = sorted(map(tuple, bpe.digests(awkward, files).collect()), key=str)
    assert rows == sorted(((i, *expected(t)) for i, t, *_ in AWKWARD), key=str)
    encoded = bpe.encode(awkward.where("doc_id in (1, 3, 7)"), files)
    back = bpe.decode(encoded, files).collect()
    assert len(back) == 4 and all(r.text == LIBRARY.decode(LIBRARY.encode(dict((a[0], a[1]) for a in AWKWARD)[r.doc_id], add_special_tokens=False).ids, skip_special_tokens=False) for r in back)
    assert bpe.digests(nothing, bpe.build_lexicon(nothing, PATH)).collect() == []


@pytest.mark.parametrize("scale", ["sf0.001"])
def test_query_on_whole_tables(spark, scale):
    rows = queries.op1_bpe_codec(spark, f"/root/testdata/{scale}").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"/root/testdata/{scale}/documents.parquet").collect()}
    assert len(rows) == len(texts) and all(tuple(r)[1:] == expected(texts[r.doc_id]) for r in rows)
