"""Names of firms and people as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Legal forms as words at the end of a normalised name.
LEGAL_FORMS = [
    "corporation", "incorporated", "company", "limited", "corp", "inc", "llc", "ltd", "s a", "s l", "s p a", "sa", "sl",
    "spa", "gmbh", "plc", "pty", "pte", "bv", "nv", "b v", "n v", "ag", "ab", "oy",
]

# Forms of address before a person's name.
HONORIFICS = r"(?i)^(?:(?:mr|mrs|ms|miss|herr|frau|dr|prof|dipl[.-]*ing)\.?\s+)+"


def unmarked(text: str | None) -> str | None:
    """Folded case without marks."""
    return None if text is None else "".join(c for c in unicodedata.normalize("NFKD", text).casefold() if unicodedata.category(c) not in ("Mn", "Mc", "Me"))


_unmarked = F.pandas_udf(lambda s: s.map(unmarked), T.StringType())


def _folded(text: Column) -> Column:
    """unmarked as a column: plain ASCII stays on the JVM, as only decomposition has no function there."""
    ascii_ = text.rlike(r"^\p{ASCII}*$")
    return F.when(ascii_, F.lower(text)).otherwise(_unmarked(F.when(~ascii_, text)))


def _worded(folded: Column) -> Column:
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def normalised_name(name: Column) -> Column:
    """Words of letters and figures in folded case, marks dropped, one space between; null stays null."""
    return _worded(_folded(name))


def without_legal_forms(words: Column) -> Column:
    """A normalised name without the legal forms at its end, all of them; empty where nothing else is in it."""
    return F.trim(F.regexp_replace(F.concat(F.lit(" "), words), "(?: (?:" + "|".join(LEGAL_FORMS) + "))+$", ""))


def name_aliases(name: Column) -> Column:
    """The full form, what stands in brackets if it has four letters, and the name without brackets and legal forms.

    In this order, each once, none empty; a name without words gives an empty array, null gives null.
    """
    folded = _folded(name)
    inner = F.filter(F.transform(F.regexp_extract_all(folded, F.lit(r"\(([^()]*)\)"), F.lit(1)), _worded), lambda a: F.length(F.replace(a, F.lit(" "), F.lit(""))) >= 4)
    base = without_legal_forms(_worded(F.regexp_replace(folded, r"\([^()]*\)", " ")))
    return F.array_distinct(F.filter(F.concat(F.array(_worded(folded)), inner, F.array(base)), lambda a: a != ""))


def without_honorifics(name: Column) -> Column:
    return F.regexp_replace(F.trim(F.replace(name, F.lit('"'), F.lit(" "))), HONORIFICS, "")


def without_initials(name: Column) -> Column:
    """The name from its first word of two letters on, for looking a person up; the whole name where it has none."""
    full = without_honorifics(name)
    words = F.split(F.regexp_replace(full, r"(?<=\b\p{L})\.\s*", ". "), r"\s+")
    later = F.filter(F.transform(words, lambda w, i: F.when(w.rlike(r"\p{L}[\p{L}\p{N}]"), i)), lambda i: i.isNotNull())
    return F.when(F.size(later) > 0, F.array_join(F.slice(words, F.get(later, 0) + 1, F.size(words)), " ")).otherwise(full)


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whether a normalised phrase stands in a normalised text at word bounds."""
    return (phrase != "") & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def slug(name: Column, most: int = 60) -> Column:
    """A name for files: small letters and figures joined by hyphens, or a hash where none is left."""
    short = F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)
    short = F.regexp_replace(short, "-+$", "")
    return F.when(short != "", short).otherwise(F.concat(F.lit("company-"), F.substring(F.sha2(name, 256), 1, 10)))


def name_from_title(title: Column) -> Column:
    """A person's name at the head of a hit's title: two to six words of letters, each with a capital; else empty."""
    words = F.split(normalised_name(F.trim(F.substring_index(F.substring_index(title, " - ", 1), " | ", 1))), " ")
    good = F.size(words).between(2, 6) & F.forall(words, lambda w: w.rlike(r"^\p{L}+$"))
    return F.coalesce(F.when(good, F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 200))), " ")), F.lit(""))
