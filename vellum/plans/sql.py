"""SQL for DuckDB that says the same as the Column expressions, in pieces."""

from __future__ import annotations

from vellum.functions import genres as G
from vellum.functions import text as T
from vellum.functions import vocab

WS = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def quote(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


def deaccent(s: str) -> str:
    return f"translate({s}, '{T.ACCENTED}', '{T.FOLDED}')"


def collapse(s: str) -> str:
    return f"trim(regexp_replace({s}, '[{WS}]+', ' ', 'g'), ' ')"


def norm_key(s: str) -> str:
    return collapse(f"regexp_replace({deaccent(f'lower({s})')}, '[^a-z0-9{WS}]', '', 'g')")


def tokens(s: str) -> str:
    spaced = f"regexp_replace({deaccent(f'lower({s})')}, '[^\\p{{L}}\\p{{Nd}}]', ' ', 'g')"
    return f"list_filter(string_split(regexp_replace({spaced}, '[^a-z0-9 ]', '', 'g'), ' '), lambda x: x <> '')"


#: (doc_id, w), then the distinct shingles of texts with enough words: (doc_id, s).
WORDS = f"w AS (SELECT doc_id, {tokens('text')} AS w FROM documents)"
SHINGLES = WORDS + """,
x AS (SELECT doc_id, len(w) AS n, CASE WHEN len(w) >= 58 THEN list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ') || ' ')) END AS s FROM w)"""
#: Distinct signatures by their smallest id, their shingles, and all pairs that share one.
CLASSES = SHINGLES + """,
k AS (SELECT doc_id, s, md5(array_to_string(list_sort(s), '|')) AS k FROM x WHERE len(s) > 0),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS rep FROM k),
r AS (SELECT k.doc_id AS id, s, len(s) AS n FROM k JOIN c USING (doc_id) WHERE rep = doc_id),
e AS (SELECT id, n, unnest(s) AS h FROM r),
f AS (SELECT * FROM e WHERE h IN (SELECT h FROM e GROUP BY h HAVING count(*) > 1)),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM f a JOIN f b ON a.h = b.h AND a.id < b.id GROUP BY ALL)"""
PAIRS = CLASSES + """,
j AS (SELECT a, b, shared, CAST(shared AS DOUBLE) / (na + nb - shared) AS similarity FROM p WHERE CAST(shared AS DOUBLE) / (na + nb - shared) >= 0.85)"""
#: Every library row that is similar to a query row (id divisible by 100), itself left out.
MATCHES = SHINGLES + """,
y AS (SELECT doc_id AS id, s, len(s) AS n FROM x WHERE len(s) > 0),
e AS (SELECT id, n, unnest(s) AS h FROM y),
q AS (SELECT * FROM e WHERE id % 100 = 0),
p AS (SELECT q.id AS a, e.id AS b, count(*) AS shared, any_value(q.n) AS na, any_value(e.n) AS nb FROM q JOIN e ON q.h = e.h AND q.id <> e.id GROUP BY ALL),
j AS (SELECT a, b, CAST(shared AS DOUBLE) / (na + nb - shared) AS similarity FROM p WHERE CAST(shared AS DOUBLE) / (na + nb - shared) >= 0.85),
t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS rank FROM j)"""

#: Tags of the `part` table: type, brand and the words of the name.
TAGS = "list_concat([p_type, p_brand], string_split(p_name, ' '))"


def clean_pt(tags: str) -> str:
    """Usable labels of a list in canonical Portuguese, without repeats, sorted."""
    re2 = lambda p: p.replace("(?iu)", "(?i)").replace(T.START, r"\b").replace(T.END, r"\b").replace(r"\A", "^").replace(r"\z", "$").replace("'", "''")
    words = ", ".join(quote(x) for x in [*vocab.EMPTY_LABELS, *vocab.PEOPLE])
    table = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in vocab.CANON_PT.items()) + "}"
    small = ", ".join(map(quote, vocab.SMALL))
    parts = f"flatten(list_transform({tags}, lambda t: regexp_split_to_array(t, '{re2(G.SPLIT)}')))"
    edges = "[.,;:\\-–—\"''()\\[\\]]+"
    strip = f"list_transform({parts}, lambda p: {collapse(f'''regexp_replace(trim(p), '^{edges}|{edges}$', '', 'g')''')})"
    usable = (
        f"length(p) BETWEEN 3 AND 45 AND lower(p) NOT IN ({words}) AND NOT regexp_matches(p, '{re2(G.CODE)}') AND NOT regexp_matches(p, '{re2(G.SITE)}') "
        f"AND NOT regexp_matches(p, '{re2(G.LANGUAGE)}') AND regexp_matches(p, '\\p{{L}}{{3}}') AND length(regexp_replace(p, '[\\p{{L}}\\p{{Nd}}{WS}''-]', '', 'g')) * 3 <= length(p) "
        f"AND len(string_split(p, ' ')) <= 4"
    )
    word = f"CASE WHEN i > 1 AND w IN ({small}) THEN w WHEN regexp_matches(w, '^[ivxlcdm]{{1,6}}$') AND w NOT IN ('i', 'c', 'd', 'm', 'l') THEN upper(w) ELSE upper(w[1]) || w[2:] END"
    titled = f"array_to_string(list_transform(string_split({collapse('lower(p)')}, ' '), lambda w, i: {word}), ' ')"
    made = f"list_filter(list_transform(list_filter({strip}, lambda p: {usable}), lambda p: coalesce({table}[lower(p)], {titled})), lambda c: c <> '')"
    return f"list_sort(list_distinct({made}))"  # no two of these differ in case alone
