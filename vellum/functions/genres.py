"""Genre labels: splitting, usability and canonical forms, as Column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions import vocab

LONGEST = 45

# The patterns of labels.
SPLIT = rf"\s*[;/|]\s*|\s+>\s+|\s+&\s+|\s+e\s+(?:mist[ée]rio|suspense|aventura|fantasia|romance){T.END}"
CODE = r"\A(?:[A-Z]{3}\d{6}|[\d.\s-]+)\z"
SITE = (
    rf"(?iu){T.START}[a-z0-9-]+\.(?:com|net|org|club|br|info|xyz|io){T.END}|exilado|epubr|le ?livros|lelivros|libgen|z-?lib|semeadores|kingofmaine|iosbooks|"
    r"cr[ée]dito ao site|digitalizado por|revisado por|tradu[çc][ãa]o de"
)
LANGUAGE = (
    r"(?iu)\A(portuguese|english|spanish|french|german|italian|russian|japanese|chinese|latin|greek|idioma|l[íi]ngua)\z|\Aforeign lang[0-9A-Za-z_]*|"
    rf"{T.START}language (materials?|study|arts)\z"
)
CENTURY = r"(?iu)\A\d{1,2}(?:st|nd|rd|th)\s+century\z|\As[ée]culo\s+[ivxl\d]+\z"
HEADING = (
    r"(?iu)\((?:fictitious|imaginary|legendary|mythical)\s+[0-9A-Za-z_]+\)?|\((?:calif|ga|n\.y|tex|fla|ill|mass|pa|ohio|mich|wash|colo|ariz|ore|conn)\.?\)?\z|"
    rf"{T.START}fictitious character{T.END}"
)
FRANCHISE = (
    rf"(?iu)\A(harry potter|percy jackson|star trek|star wars|warcraft|harlequin{T.END}.*|jane austen|sherlock holmes|discworld|middle-earth|doctor who|marvel|"
    r"dc comics|dune|game of thrones|twilight|hunger games)\z"
)


def usable(label: Column) -> Column:
    """Whether a trimmed text can be a label: of fit length, a real word, not a code, site, language or phrase."""
    low, length = F.lower(label), F.length(label)
    symbols = F.length(F.regexp_replace(label, rf"[\p{{L}}\p{{Nd}}{T.WS}'-]", ""))
    return (
        length.between(3, LONGEST)
        & ~F.array_contains(T.listed([*vocab.EMPTY_LABELS, *vocab.PEOPLE]), low)
        & ~F.rlike(label, F.lit(CODE))
        & ~F.rlike(label, F.lit(SITE))
        & ~F.rlike(label, F.lit(LANGUAGE))
        & F.rlike(label, F.lit(r"\p{L}{3}"))
        & (symbols * 3 <= length)
        & (F.size(F.split(label, " ")) <= 4)
    )


def title_case(label: Column) -> Column:
    """First letters in capitals but for small words after the first; numerals in capitals."""

    def word(w: Column, i: Column) -> Column:
        numeral = F.rlike(w, F.lit(r"\A[ivxlcdm]{1,6}\z")) & ~w.isin("i", "c", "d", "m", "l")
        return F.when((i > 0) & w.isin(*vocab.SMALL), w).when(numeral, F.upper(w)).otherwise(T.upper_first(w))

    return F.array_join(F.transform(F.split(T.collapse(F.lower(label)), " "), word), " ")


def lookup(key: Column, vocabulary: dict[str, str]) -> Column:
    """The canonical form of a key, null if it has none: a constant map of the vocabulary, which is a table of a few hundred labels."""
    return F.try_element_at(T.table(vocabulary), key) if vocabulary else F.lit(None).cast("string")


def canonical_pt(label: Column, vocabulary: dict[str, str] | None = None) -> Column:
    return F.coalesce(lookup(F.lower(T.strip(label)), vocab.CANON_PT if vocabulary is None else vocabulary), title_case(label))


def canonical_en(label: Column, vocabulary: dict[str, str] | None = None) -> Column:
    """struct<value, known>: the canonical form, empty to discard, and whether the label is known at all."""
    table = vocab.CANON_EN if vocabulary is None else vocabulary
    key = F.lower(T.strip(label))
    plain = F.lower(T.deaccent_any_case(key))
    held = F.coalesce(lookup(key, table), lookup(plain, table))
    patterns = F.rlike(label, F.lit(HEADING)) | F.rlike(T.strip(label), F.lit(FRANCHISE)) | F.rlike(key, F.lit(CENTURY))
    discard = patterns | F.array_contains(T.listed(vocab.PLACES), key) | F.array_contains(T.listed(vocab.PLACES), plain)
    return F.struct(F.coalesce(held, F.when(discard, F.lit("")), title_case(label)).alias("value"), (held.isNotNull() | discard).alias("known"))


def parts(tags: Column) -> Column:
    """The labels of a list: hierarchies opened, punctuation trimmed."""
    split = F.flatten(F.transform(tags, lambda t: F.split(t, SPLIT, -1)))
    edges = "[.,;:\\-–—\"'()\\[\\]]+"
    return F.transform(split, lambda p: T.collapse(F.regexp_replace(T.strip(p), rf"\A{edges}|{edges}\z", "")))


def usable_forms(tags: Column, vocabulary: dict[str, str] | None = None) -> Column:
    """Usable labels in canonical Portuguese, in the order that they came in, repeats among them."""
    return _forms(tags, lambda p: canonical_pt(p, vocabulary))


def _forms(tags: Column, canonical) -> Column:
    return F.filter(F.transform(F.filter(parts(tags), usable), canonical), lambda c: c != "")


def merged(forms: Column) -> Column:
    """The first of each form by its lower case, sorted."""
    return F.array_sort(T.first_by_lower(forms))


def _clean(tags: Column, canonical) -> Column:
    return merged(_forms(tags, canonical))


def clean_pt(tags: Column, vocabulary: dict[str, str] | None = None) -> Column:
    """Usable labels in canonical Portuguese, without repeats, sorted."""
    return _clean(tags, lambda p: canonical_pt(p, vocabulary))


def clean_en(tags: Column, vocabulary: dict[str, str] | None = None) -> Column:
    return _clean(tags, lambda p: canonical_en(p, vocabulary)["value"])


def is_canonical(label: Column, vocabulary: dict[str, str] | None = None) -> Column:
    table = vocab.CANON_PT if vocabulary is None else vocabulary
    return F.array_contains(T.listed(sorted({v.lower() for v in table.values() if v})), F.lower(label))


def translate_tags(tags: Column, table: dict[str, str] | None = None) -> Column:
    """Known labels translated, whole or by their first known part; the rest as they came; first of each kept."""
    table = vocab.TAGS_PT if table is None else table

    def one(t: Column) -> Column:
        key = F.lower(T.strip(t))
        inner = F.filter(F.transform(F.split(key, "/"), lambda p: lookup(T.strip(p), table)), lambda v: v.isNotNull())
        return F.coalesce(lookup(key, table), F.get(inner, F.lit(0)), T.strip(t))

    return T.first_by_lower(F.filter(F.transform(tags, one), lambda v: v != ""))


def admit(labels: Column, frequent: Column, minimum: int, vocabulary: dict[str, str] | None = None) -> Column:
    """struct<accepted, refused>: cleaned labels that are frequent (an array) or canonical, and the others."""
    ok = lambda g: F.lit(minimum <= 1) | F.array_contains(frequent, g) | is_canonical(g, vocabulary)
    return T.bind(clean_pt(labels, vocabulary), lambda c: F.struct(F.filter(c, ok).alias("accepted"), F.filter(c, lambda g: ~ok(g)).alias("refused")))

