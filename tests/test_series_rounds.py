"""Series found in rounds against the sequential choice."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from vellum.operators import series as SE


def slow(rows, minimum):
    """rows: (author_key, path, title, title_key, term, word, n, display); one author after another, one term after another."""
    out = []
    by_author = defaultdict(list)
    for r in rows:
        by_author[r.author_key].append(r)
    for author, held in by_author.items():
        taken = set()
        for n, term in sorted({(-r.n, r.term) for r in held}):
            own = [r for r in held if r.term == term]
            free = [r for r in own if r.path not in taken]
            if len(free) >= minimum and all(r.title_key != term for r in free):
                taken |= {r.path for r in own}
                out += [(author, r.display, -n, r.path) for r in free]
    return sorted(out)


def test_rounds_choose_what_one_author_after_another_would(spark):
    rnd = random.Random(4)
    words = ["Merlin", "Avalon", "Camelot", "Dragon", "Excalibur", "Lancelot", "Morgana", "Viviane", "Arthur", "Galahad"]
    rows = []
    for i in range(400):
        title = " ".join(["Of", *rnd.sample(words, rnd.randrange(1, 5))]) if rnd.random() < 0.95 else rnd.choice(words) + " Merlin"
        rows.append((f"p{i:04}", title, rnd.choice(["A Lima", "B Reis", "B Reis", "C Sá"])))
    rows += [("x1", "Merlin", "A Lima"), ("x2", "O Graal", ""), ("x3", None, "A Lima"), ("x4", "Of Merlin", None)]
    books = spark.createDataFrame(rows, "path string, title string, author string")
    for minimum in (2, 3, 8):
        found = SE.terms(books)
        held = found.join(SE.term_counts(found, minimum), ["author_key", "term"]).collect()
        expected = slow(held, minimum)
        assert expected and sorted((r.author_key, r.name, r.score, r.path) for r in SE.detect(books, minimum).collect()) == expected
    assert SE.detect(books.limit(0)).collect() == []


def test_one_author_of_many_titles_is_spread(spark):
    books = spark.range(0, 3000).select(F.format_string("p%05d", "id").alias("path"), F.concat(F.lit("Of Merlin and "), F.element_at(F.array(*map(F.lit, ("Avalon", "Camelot", "Dragon"))), (F.col("id") % 3 + 1).cast("int")), F.lit(" at Dawn")).alias("title"), F.lit("A Lima").alias("author"))
    made = SE.detect(books)
    assert {r.name: r.n for r in made.groupBy("name").agg(F.count("*").alias("n")).collect()} == {"Dawn": 3000}
    assert "InPandas" not in made._jdf.queryExecution().executedPlan().toString()
