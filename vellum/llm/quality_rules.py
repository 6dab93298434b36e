"""Quality rules under weak supervision.

Each rule looks at a few counts of a text and votes good (1), bad (-1) or abstains (0). Rules are of
unequal worth, and none is right always: expectation-maximisation over how often each pattern of votes
occurs estimates, without labels, how accurate each rule is on good and on bad texts and how common
good ones are. A text is kept where the posterior probability that it is good reaches the threshold,
and the contract's base rules did not fail it.

There are 3 to the number of rules patterns at most, whatever the input: that bounded table of counts is all
that reaches the driver, and the posteriors go back as a broadcast of as many rows. Texts stay in the
JVM throughout.

Defined results: null, empty and blank texts have no words, fail the base rules and are not kept; a very
long text is one row's array of words in one task, and counts like any other; repeated rows, and rows that
share an id or have none, get a verdict each, by their text alone; ties (a posterior of just the threshold)
are kept; an empty table gives an empty result; any other columns are carried by `keep` and ignored by `judge`.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm import texts
from vellum.session import cut

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
REPEAT_PERCENT = 50
KEEP_FROM = 0.5
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÈÉÊËÎÏÔÙÛÑÁÍÓÚ"
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts", "n_plain", "n_common")
#: Function words of the languages that the rules know; prose has them whatever its subject.
COMMON = ("the of and to in is it that for was with as be on by at this are an or der die das und ist den des zu ein eine mit von im nicht"
          " le la les de et un une des du en est que pour dans el los las y que del se por con una").split()  # fmt: skip


def repeat_words(words: Column) -> Column:
    """Words that stand in a 3-word window which the text has twice or more; a word counts once.

    Windows are compared by 64 bits of hash of their words' hashes, so two that differ pass for one in a text of
    n words with a probability of about n squared over 2 to the 65th.
    """

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return texts.bind(placed, lambda s: F.size(F.array_distinct(F.flatten(F.transform(
            F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))),
            lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))))

    def of(w: Column) -> Column:
        windows = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return texts.bind(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    return texts.bind(F.transform(words, lambda w: F.xxhash64(w)), of).cast("long")


def signals(text: Column) -> Column:
    """The counts that the rules look at, as one struct: the text is split once, and rid of its plain characters once."""
    text = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.rlike(x, F.lit(r"^\p{L}+[,.;:!?]?$")))).cast("long").alias("n_plain"),
            F.size(F.filter(w, lambda x: x.isin(*sorted(set(COMMON))))).cast("long").alias("n_common"),
        )

    def of_marks(m: Column) -> Column:
        return F.struct(texts.count_of(m, SYMBOLS).alias("n_symbols"), texts.count_of(m, UPPER).alias("n_upper"), texts.count_of(m, "!").alias("n_shouts"))

    def of_lines(x: Column) -> Column:
        return F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(x).cast("long").alias("n_lines"))

    lines = F.filter(F.split(text, "\n"), lambda x: texts.trimmed(x) != "")
    marks = F.regexp_replace(text, f"[^{SYMBOLS}!{UPPER}]+", "")
    made = {"w": texts.bind(texts.words(text), of_words), "m": texts.bind(marks, of_marks), "l": texts.bind(lines, of_lines)}
    return F.struct(*(c.alias(n) for n, c in made.items()))


def with_signals(df: DataFrame, row: Column, text_col: str) -> DataFrame:
    """(row, the signals) of every row."""
    places = {"n_words": "w", "word_chars": "w", "n_symbols": "m", "n_dup_lines": "l", "n_repeat_words": "w", "n_lines": "l", "n_upper": "m", "n_shouts": "m", "n_plain": "w", "n_common": "w"}
    held = df.select(row.alias("row"), signals(F.col(text_col)).alias("s"))
    return held.select("row", *(F.col(f"s.{places[n]}.{n}").alias(n) for n in SIGNALS))


def _share(part: str, of: str) -> Column:
    return F.when(F.col(of) > 0, F.col(part) / F.col(of))


def _below(value: Column, good: float, bad: float) -> Column:
    return F.when(value < good, 1).when(value > bad, -1).otherwise(0)


def rules() -> dict[str, Column]:
    """Each rule's vote from the signals."""
    length = _share("word_chars", "n_words")
    return {
        "plain_words": _below(1 - _share("n_plain", "n_words"), 0.15, 0.4),
        "common_words": _below(1 - _share("n_common", "n_words"), 0.9, 0.96),
        "symbols": _below(_share("n_symbols", "n_words"), 0.02, 0.1),
        "word_length": F.when(length.between(3, 9), 1).when((length < 2.5) | (length > 12), -1).otherwise(0),
        "repeats": _below(_share("n_repeat_words", "n_words"), 0.15, 0.4),
        "lines": _below(_share("n_dup_lines", "n_lines"), 0.1, 0.3),
        "capitals": _below(_share("n_upper", "word_chars"), 0.1, 0.3),
        "shouts": _below(_share("n_shouts", "n_words"), 0.05, 0.2),
    }


def failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def pattern() -> Column:
    """The votes as one number in base 3."""
    made = F.lit(0)
    for vote in rules().values():
        made = made * 3 + vote + 1
    return made.cast("int")


def votes_of(number: int, n_rules: int) -> list[int]:
    return [number // 3 ** (n_rules - 1 - i) % 3 - 1 for i in range(n_rules)]


def estimate(counts: dict[int, int], n_rules: int, rounds: int = 60) -> dict[int, float]:
    """The posterior that a text is good, by pattern.

    Each rule has two accuracies: how often it votes good on good texts, and bad on bad ones, where it
    votes. They start at 0.97 and 0.5; pseudo-counts keep them from 1; and a bad vote never counts for
    a text (the second is no less than one minus the first), so good cannot come to mean bad.
    """
    votes = {p: votes_of(p, n_rules) for p in counts}
    good, accuracy = 0.9, [(0.97, 0.5)] * n_rules
    posterior: dict[int, float] = {}
    for _ in range(rounds):
        for p, v in votes.items():
            odds = log(good) - log(1 - good)
            for x, (a, b) in zip(v, accuracy, strict=True):
                odds += (log(a) - log(1 - b)) if x > 0 else (log(1 - a) - log(b)) if x < 0 else 0
            posterior[p] = 1 / (1 + exp(-max(-500.0, min(500.0, odds))))
        total = sum(counts.values())
        good = min(0.99, max(0.5, (sum(n * posterior[p] for p, n in counts.items()) + 9) / (total + 10)))
        for i in range(n_rules):
            share = []
            for side, prior in ((1, 0.97), (-1, 0.5)):
                weight = {p: n * (posterior[p] if side > 0 else 1 - posterior[p]) for p, n in counts.items() if votes[p][i]}
                right = sum(w for p, w in weight.items() if votes[p][i] == side)
                share.append(min(0.995, (right + 10 * prior) / (sum(weight.values()) + 10)))
            accuracy[i] = (max(0.7, share[0]), max(1 - max(0.7, share[0]), share[1]))
    return posterior


def _posteriors(df: DataFrame) -> DataFrame:
    """(pattern, posterior) from rows with signals; base failures take no part."""
    counts = {r["p"]: r["n"] for r in df.where(~failed()).groupBy(pattern().alias("p")).agg(F.count("*").alias("n")).collect()}
    found = estimate(counts, len(rules()))
    return df.sparkSession.createDataFrame(sorted(found.items()), "of_pattern int, posterior double")


def _judged(rows: DataFrame) -> DataFrame:
    """rows: a struct `row` and the signals; adds posterior, base_failed and kept."""
    posteriors = _posteriors(rows)
    joined = rows.withColumn("pattern", pattern()).join(F.broadcast(posteriors), F.col("pattern") == F.col("of_pattern"), "left")
    return joined.withColumn("base_failed", failed()).withColumn("kept", ~F.col("base_failed") & (F.coalesce("posterior", F.lit(0.0)) >= KEEP_FROM))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the base counts, base_failed, kept, posterior) of every row."""
    rows = cut(with_signals(df, F.col(id_col), text_col))
    return _judged(rows).select(F.col("row").alias(id_col), *SIGNALS[:5], "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def keep(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that are kept, with the columns they came with."""
    return _judged(cut(with_signals(df, F.struct("*"), text_col))).where("kept").select("row.*")


def oracle_sql(rounds: int = 60) -> str:
    """The same rows by relational means: words and windows as rows, the votes as columns, and the estimation as a recursion over its parameters."""
    n = range(1, 9)
    spread = lambda form, joint=", ": joint.join(form.format(i=i) for i in n)
    odds = "ln(good) - ln(1 - good) + " + spread("CASE v{i} WHEN 1 THEN ln(a{i}) - ln(1 - b{i}) WHEN -1 THEN ln(1 - a{i}) - ln(b{i}) ELSE 0 END", " + ")
    posterior = f"1 / (1 + exp(-greatest(-500.0, least(500.0, {odds}))))"
    good = "greatest(0.7, least(0.995, (coalesce(sum(n * p) FILTER (WHERE v{i} = 1), 0) + 9.7) / (coalesce(sum(n * p) FILTER (WHERE v{i} <> 0), 0) + 10)))"
    bad = "greatest(1 - " + good + ", least(0.995, (coalesce(sum(n * (1 - p)) FILTER (WHERE v{i} = -1), 0) + 5) / (coalesce(sum(n * (1 - p)) FILTER (WHERE v{i} <> 0), 0) + 10)))"
    below = lambda part, of, low, high: f"CASE WHEN {of} > 0 AND {part} < {low} THEN 1 WHEN {of} > 0 AND {part} > {high} THEN -1 ELSE 0 END"
    share = lambda part, of, low, high: below(f"{part} / CAST({of} AS DOUBLE)", of, low, high)
    length = "word_chars / CAST(n_words AS DOUBLE)"
    votes = [
        below("1 - n_plain / CAST(n_words AS DOUBLE)", "n_words", 0.15, 0.4), below("1 - n_common / CAST(n_words AS DOUBLE)", "n_words", 0.9, 0.96), share("n_symbols", "n_words", 0.02, 0.1),
        f"CASE WHEN n_words > 0 AND {length} BETWEEN 3 AND 9 THEN 1 WHEN n_words > 0 AND ({length} < 2.5 OR {length} > 12) THEN -1 ELSE 0 END",
        share("n_repeat_words", "n_words", 0.15, 0.4), share("n_dup_lines", "n_lines", 0.1, 0.3), share("n_upper", "word_chars", 0.1, 0.3), share("n_shouts", "n_words", 0.05, 0.2),
    ]
    counted = lambda letters: f"length(t) - length(regexp_replace(t, '[{letters}]', '', 'g'))"
    common = ", ".join(f"'{w}'" for w in COMMON)
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
o AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
h AS (SELECT r, i, x, lead(x, 1) OVER (PARTITION BY r ORDER BY i) AS y, lead(x, 2) OVER (PARTITION BY r ORDER BY i) AS z FROM o),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, x, y, z) AS times FROM h WHERE z IS NOT NULL),
q AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS place FROM g WHERE times > 1) GROUP BY r),
s AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST({counted(SYMBOLS)} AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(q.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, {counted(UPPER)} AS n_upper, {counted('!')} AS n_shouts,
  len(list_filter(w, lambda x: regexp_matches(x, '^\\pL+[,.;:!?]?$'))) AS n_plain, len(list_filter(w, lambda x: x IN ({common}))) AS n_common FROM d LEFT JOIN q USING (r)),
v AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed, {', '.join(f'{x} AS v{i}' for i, x in zip(n, votes, strict=True))} FROM s),
c AS (SELECT {spread('v{i}')}, CAST(count(*) AS DOUBLE) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
em AS (
  SELECT 1 AS k, CAST(0.9 AS DOUBLE) AS good, {spread('CAST(0.97 AS DOUBLE) AS a{i}, CAST(0.5 AS DOUBLE) AS b{i}')}
  UNION ALL
  SELECT k + 1, least(0.99, greatest(0.5, (sum(n * p) + 9) / (sum(n) + 10))), {', '.join(good.format(i=i) + ', ' + bad.format(i=i) for i in n)}
  FROM (SELECT em.*, c.*, {posterior} AS p FROM em, c WHERE k < {rounds}) GROUP BY k),
f AS (SELECT c.*, {posterior} AS p FROM em, c WHERE k = {rounds})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(f.p, 0) >= {KEEP_FROM} AS kept, round(f.p, 6) AS posterior
FROM v LEFT JOIN f USING ({spread('v{i}')})
"""
