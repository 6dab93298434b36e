import pytest

#: Rows that every operator on documents has to bear: nulls anywhere, empty, blank, very long, repeated, tied.
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog, and then it rests under the old tree for a while.", "en", "src0", 90),
    (1, "The quick brown fox jumps over the lazy dog, and then it rests under the old tree for a while.", "en", "src0", 90),
    (2, None, None, None, None),
    (3, "", "en", None, 0),
    (4, " \n\t ", None, "src1", 3),
    (None, "No id has this text, but it is a text like any other with a few words in it.", "en", "src0", 1),
    (5, "word " * 120_000, "en", "src2", 600_000),
    (6, "x" * 300_000, None, "src2", 300_000),
    (7, "Ünïcödé 漢字 😀 ǅ <|endoftext|> Σίσυφος\u0000end", "de", "src1", 1),
    (8, "Der Hund und die Katze sind nicht im Haus, und das ist gut so für den Mann mit dem Hut.", "de", "src1", 1),
]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """The rows above with extra columns whose names operators use inside."""
    df = spark.createDataFrame(AWKWARD, DOCUMENTS)
    names = ("id", "fp", "row", "size", "h", "words", "label", "copies", "kept", "pattern", "n", "target", "e", "of")
    return df.selectExpr("*", *(f"'x' as `{n}`" for n in names)).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"
