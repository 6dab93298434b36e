"""Text normalisation as Column expressions.

Every function takes and returns Columns. Regular expressions spell out Unicode case folding and ASCII
word boundaries, because those are the semantics that the operators promise whatever the engine.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accented letters that are folded, and what they fold to.
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñ"
FOLDED = "aaaaaeeeeiiiiooooouuuucn"

#: Unicode white space, as the inside of a character class.
WS = r"\t\n\x0B\f\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: ASCII word boundaries, for the start and the end of a word.
START, END = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"


def bind(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def table(values: dict[str, str]) -> Column:
    """A constant map, as one literal however many entries it has."""
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def tables(values: dict[str, str], initials: int) -> Column:
    """The same in maps by the first letters of the keys."""
    made: dict[str, dict[str, str]] = {}
    for k, v in values.items():
        made.setdefault(k[:initials], {})[k] = v
    return F.from_json(F.lit(json.dumps(made)), "map<string,map<string,string>>")


def listed(values) -> Column:
    """A constant list, as one literal."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def strip(s: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(s, rf"\A[{WS}]+|[{WS}]+\z", "")


def collapse(s: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(s, rf"[{WS}]+", " "))


def deaccent(s: Column) -> Column:
    """Lower-case accents folded."""
    return F.translate(s, ACCENTED, FOLDED)


def deaccent_any_case(s: Column) -> Column:
    return F.translate(s, ACCENTED + ACCENTED.upper(), FOLDED + FOLDED.upper())


def norm_key(s: Column) -> Column:
    """A comparison key: lower case, accents folded, only a-z, 0-9 and single spaces; other characters vanish."""
    return collapse(F.regexp_replace(deaccent(F.lower(s)), rf"[^a-z0-9{WS}]", ""))


def tokens(s: Column) -> Column:
    """Words of a-z and 0-9. Letters that do not fold vanish without ending a word; anything else ends it."""
    def words(low: Column) -> Column:
        # ASCII has no letters that fold or vanish, so one pass is enough for it; of other texts, for their ASCII words
        whole = F.split(F.regexp_replace(low, "[^a-z0-9]+", " "), " ")
        spaced = F.split(F.regexp_replace(deaccent(low), r"[^a-z0-9\p{L}\p{Nd}]+", " "), " ")
        kept = F.transform(spaced, lambda w: F.when(_ascii(w), w).otherwise(F.regexp_replace(w, "[^a-z0-9]", "")))
        return F.filter(F.when(_ascii(low), whole).otherwise(kept), lambda w: w != "")

    return bind(F.lower(s), words)


def _ascii(s: Column) -> Column:
    return F.octet_length(s) == F.length(s)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", " ")


def upper_first(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))


def is_shouty(s: Column) -> Column:
    """At least eight letters, 95 % of them capitals."""
    letters, capitals = F.regexp_count(s, F.lit(r"\p{L}")), F.regexp_count(s, F.lit(r"\p{Lu}"))
    return (letters >= 8) & (capitals / F.greatest(letters, F.lit(1)) >= 0.95)


def is_roman(word: Column) -> Column:
    """A lower-case word that reads as a numeral; the listed ones are words."""
    return F.rlike(word, F.lit(r"\A[ivxlcdm]{1,6}\z")) & ~word.isin("i", "mi", "di", "li", "ci")


# Words that stay in lower case inside a Portuguese title.
SMALL_PT = (
    "a as o os um uma uns umas de da do das dos e em na no nas nos num numa por para pra com sem sob sobre ao aos à às que se ou nem "
    "pelo pela até entre contra desde após ante the of and"
).split()
# Abbreviations that stay in upper case.
ACRONYMS = "eua urss brasil onu otan cia fbi kgb url html css sql php xml api ia ai tv dna hiv aids ufo nasa jfk usa uk mpb oab stf pt psdb".split()


def title_case_pt(s: Column) -> Column:
    """A shouted title in mixed case: acronyms and numerals in capitals, function words small inside a segment."""
    gap = r"[^\p{L}\p{N}']+"

    def of(words: Column) -> Column:
        seps = F.regexp_extract_all(s, F.lit(f"({gap})"), F.lit(1))
        places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) != "")
        first, last = F.get(places, F.lit(0)), F.get(places, F.size(places) - 1)

        def word(w: Column, i: Column) -> Column:
            low = F.lower(w)
            before = F.coalesce(F.get(seps, i - 1), F.lit(""))
            opens = (i == first) | F.rlike(before, F.lit(r"[-–—:.?!;()\[\]/]"))
            cased = (
                F.when(low.isin(*ACRONYMS) | is_roman(low), F.upper(w))
                .when(~opens & (i != last) & low.isin(*SMALL_PT), low)
                .otherwise(upper_first(low))
            )
            return F.concat(F.when(w == "", w).otherwise(cased), F.coalesce(F.get(seps, i), F.lit("")))

        return F.array_join(F.transform(words, word), "")

    return F.when(F.rlike(s, F.lit(r"[\p{L}\p{N}']")), bind(F.split(s, gap, -1), of)).otherwise(s)


def restore_colon(s: Column) -> Column:
    """`_` before white space, after a letter, number or closing mark, is a colon that file systems refuse."""
    return F.regexp_replace(s, r"""(\p{L}|\p{N}|["')\]])_(\s)""", "$1:$2")


def author_file_as(name: Column) -> Column:
    """`First Last` as `Last, First`; names of several people, of one word, or with a comma stay."""
    def turned(c: Column) -> Column:
        stays = (c == "") | F.contains(c, F.lit(",")) | F.rlike(F.lower(c), F.lit("( e | & |;| and )")) | ~F.contains(c, F.lit(" "))
        return F.when(stays, c).otherwise(F.regexp_replace(c, r"(?iu)\A(.+?) ((?:(?:de|da|do|dos|das|van|von|del|la) )*\S+)\z", "$2, $1"))

    return bind(collapse(name), turned)


def looks_like_author(s: Column) -> Column:
    low = F.lower(s)
    return (s != "") & (F.octet_length(s) <= 45) & ~F.rlike(s, F.lit("[0-9]")) & ~F.rlike(low, F.lit(r"\A(vol|volume|parte|livro|tomo|ed\.|edicao)( |\z)"))


def clean(s: Column) -> Column:
    """Collapsed, without spaces, dashes, underscores, stops and commas at the ends."""
    return F.regexp_replace(collapse(s), r"\A[ \-–_.,]+|[ \-–_.,]+\z", "")


def format_index(number: Column) -> Column:
    """Whole volume numbers in two digits, others as short decimals."""
    whole = number == F.floor(number)
    return F.when(whole, F.format_string("%02d", number.cast("long"))).otherwise(number.cast("string"))


def left_bytes(s: Column, n: int) -> Column:
    """At most n bytes of UTF-8, cut at a character."""
    def held(s: Column) -> Column:
        width = F.transform(F.split(F.substring(s, 1, n), ""), lambda c: F.octet_length(c))
        count = lambda a, w: F.struct((a["bytes"] + w).alias("bytes"), (a["fit"] + F.when(a["bytes"] + w <= n, 1).otherwise(0)).alias("fit"))
        fits = F.aggregate(width, F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("fit")), count, lambda a: a["fit"])
        return F.when(F.octet_length(s) <= n, s).when(F.octet_length(s) == F.length(s), F.substring(s, 1, n)).otherwise(F.substring(s, F.lit(1), fits))

    return bind(s, held)


def sanitize(s: Column) -> Column:
    """A file name: no reserved or control characters, at most 200 bytes."""
    held = collapse(F.regexp_replace(s, r'[/\\:*?"<>|\x00-\x1f]', ""))
    return bind(held, lambda h: F.when(F.octet_length(h) > 200, strip(left_bytes(h, 200))).otherwise(h))


def safe_dir(s: Column) -> Column:
    """A folder name: sanitised without accents, no ` .-_` at the ends, at most 120 bytes."""
    held = F.regexp_replace(sanitize(deaccent_any_case(s)), r"\A[ .\-_]+|[ .\-_]+\z", "")
    return bind(held, lambda h: F.when(F.octet_length(h) > 120, F.regexp_replace(left_bytes(h, 120), r"\A[ .\-_]+|[ .\-_]+\z", "")).otherwise(h))


def human_size(n: Column) -> Column:
    return F.when(n > (1 << 20), F.format_string("%.1f MB", F.bround(n / float(1 << 20), 1))).when(n > (1 << 10), F.format_string("%d KB", F.bround(n / 1024.0, 0).cast("long"))).otherwise(F.format_string("%d B", n.cast("long")))


def truncate(s: Column, n: int) -> Column:
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("…"))).otherwise(s)


def quote_sql(s: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'"))


def last_line(s: Column) -> Column:
    found = strip(F.element_at(F.split(F.rtrim(s, F.lit("\n")), "\n"), -1))
    return F.when(found == "", F.lit("erro desconhecido")).otherwise(found)


def id_list(s: Column) -> Column:
    """A comma-separated list as distinct trimmed ids."""
    return F.array_distinct(F.filter(F.transform(F.split(s, ","), strip), lambda x: x != ""))


def first_by_lower(values: Column) -> Column:
    """Without later spellings that differ in case alone; order kept."""
    return bind(F.transform(values, F.lower), lambda low: F.filter(values, lambda _, i: F.array_position(low, F.get(low, i)) == i + 1))


def union_sorted(a: Column, b: Column) -> Column:
    """Both lists trimmed, the first spelling of each value, sorted."""
    return F.array_sort(first_by_lower(F.filter(F.transform(F.concat(a, b), strip), lambda x: x != "")))


def same_set(a: Column, b: Column) -> Column:
    """Equal as multisets."""
    return F.array_sort(a) == F.array_sort(b)
