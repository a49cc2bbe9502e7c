"""Text expressions as Column builders; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word with letters, digits, underscore and apostrophes, in any script.
WORD = r"(?U)\b[\w']+\b"
SEPARATOR = "--- DREAM TEXT ---"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case ASCII words without outer apostrophes, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z']+"), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.btrim(F.lower(x), F.lit("'"))), lambda x: x != "")


def compact(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def preview(text: Column, most: int = 300) -> Column:
    c = compact(text)
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most)), F.lit("..."))).otherwise(c)


def word_preview(text: Column, most: int = 25) -> Column:
    w = F.split(compact(text), " ")
    return F.when(F.size(w) > most, F.concat(F.array_join(F.slice(w, 1, most), " "), F.lit("..."))).otherwise(F.array_join(w, " "))


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n[TRUNCATED]"))).otherwise(text)


def after_separator(document: Column, separator: str = SEPARATOR) -> Column:
    """Text after the first separator, the whole document if there is none."""
    at = F.instr(document, separator)
    rest = F.substring(document, at + len(separator), F.length(document))
    return F.btrim(F.when(at > 0, rest).otherwise(document), F.lit(" \t\r\n"))


def clean_phrase(text: Column) -> Column:
    return F.btrim(compact(text), F.lit(" \"'"))


def slug(name: Column, default: str = "character") -> Column:
    s = F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def identity(name: Column) -> Column:
    """Case-folded name: lower case, German sz as ss."""
    return F.replace(F.lower(compact(name)), F.lit("ß"), F.lit("ss"))


def safe_name(value: Column) -> Column:
    return F.regexp_replace(value, "[^A-Za-z0-9._-]", "_")


def comma_tags(value: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def ordered_distinct(items: Column, fold: bool = True) -> Column:
    """Items with white space collapsed, without empty ones, each once (by case if ``fold``), in order of appearance."""
    clean = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), compact), lambda x: x.isNotNull() & (x != ""))
    if fold:
        return F.array_distinct(F.transform(clean, F.lower))
    keys = F.transform(clean, F.lower)
    return F.filter(clean, lambda x, i: F.array_position(keys, F.element_at(keys, i + 1)) == i + 1)


def markdown_cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def contains_passage(text: Column, passage: str) -> Column:
    return F.contains(text, F.lit(passage))


def excerpt(text: Column, most: int = 300) -> Column:
    """Compact text of at most ``most`` characters, safe inside HTML."""
    c = F.substring(compact(text), 1, most)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
