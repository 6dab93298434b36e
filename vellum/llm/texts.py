"""Column expressions that several operators share; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: space and the controls from tab to carriage return.
SPACES = " \t\n\x0b\f\r"
BREAK = r"[\x20\x09-\x0D]+"


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))


def words(text: Column) -> Column:
    """The words of a text; none for a null, empty or blank one."""
    core = trimmed(text)
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, BREAK))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def count_of(text: Column, characters: str) -> Column:
    """How many of these characters a text has."""
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def bind(value: Column, use) -> Column:
    """use(value), with the value computed once however often the expression needs it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
