"""Contact values as columns: e-mail addresses, telephone numbers, profile addresses, and nested fields of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import profile_key

#: Java patterns: an address that stands free of letters and signs of an address, and an at-sign spelt in brackets.
EMAIL = r"(?<![\w.+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})(?![\w-])"
BRACKETED_AT = r"(?i)(?<=\w)\s*[(\[]\s*at\s*[)\]]\s*(?=\w)"
INTERNATIONAL = r"(?<![\d.,/-])((?:\+|00)\s?\d[\d ()./-]{6,20}\d)(?!\d)"

#: A number behind the word fax, at the end of its line or of the line before.
FAXED = r"(?i)\b(?:tele|mobile )?(?:fax|facsimile|t[ée]l[ée]copie)\b[ \t]*[:：-]?\s*[+\d][\d ()./-]{6,20}\d"
#: A number behind the name of the chat service.
CHAT_LABEL = r"(?i)\bwhatsapp\b[^\d+\n]{0,12}((?:\+|00)\s?\d[\d ()./-]{6,20}\d)"


def decoded_at(text: Column) -> Column:
    """(at) and [at] between parts of an address as @; the plain word 'at' stays."""
    return F.regexp_replace(text, BRACKETED_AT, "@")


def emails(text: Column) -> Column:
    """Distinct addresses in order of first appearance, in small letters.

    An address that only repeats another behind a stuck 'mailto' or 'to' is left out. Null gives an empty array.
    """
    found = F.array_distinct(F.transform(F.regexp_extract_all(decoded_at(F.coalesce(text, F.lit(""))), F.lit(EMAIL), F.lit(1)), F.lower))
    stuck = lambda e: (F.startswith(e, F.lit("mailto")) & F.array_contains(found, F.substring(e, 7, 999))) | (F.startswith(e, F.lit("to")) & F.array_contains(found, F.substring(e, 3, 999)))
    return F.filter(found, lambda e: ~stuck(e))


def phone_digits(value: Column) -> Column:
    """Figures only, without an international 00."""
    return F.regexp_replace(F.regexp_replace(value, r"\D", ""), "^00", "")


def e164(value: Column) -> Column:
    """+ and 8 to 15 figures of a number written with + or 00 in front, a trunk (0) dropped; null for any other."""
    text = F.replace(F.trim(value), F.lit("(0)"), F.lit(""))
    number = phone_digits(text)
    explicit = text.rlike(r"^(\+|00)")
    return F.when(explicit & F.length(number).between(8, 15) & ~F.startswith(number, F.lit("0")), F.concat(F.lit("+"), number))


def phones(text: Column) -> Column:
    """Distinct numbers with an explicit country code, those behind the word fax left out."""
    # the word before a number decides, so a fax number is taken out of the text first
    spoken = F.regexp_replace(F.coalesce(text, F.lit("")), FAXED, " ")
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(spoken, F.lit(INTERNATIONAL), F.lit(1)), e164), lambda x: x.isNotNull()))


def canonical(channel: Column, value: Column, domain: str = "linkedin.com") -> Column:
    """The form in which two values of a channel are compared.

    Numbers are compared by their figures, as no numbering plan is at hand that would complete national ones.
    """
    v = F.trim(value)
    return F.when(channel == "linkedin", F.coalesce(F.nullif(profile_key(v, domain), F.lit("")), v)).when(channel == "email", F.lower(v)).when(channel == "phone", phone_digits(v)).otherwise(v)


def flattened(value: Column) -> Column:
    """All text values of a field that holds a bare value, a JSON list, a JSON object or nothing; keys left out."""
    v = F.trim(value)
    nested = F.filter(F.regexp_extract_all(v, F.lit(r'("(?:[^"\\]|\\.)*"\s*:?)'), F.lit(1)), lambda x: ~F.endswith(x, F.lit(":")))
    bare = F.filter(F.array(v), lambda x: x != "")
    values = F.when(v.rlike(r"^[\[{]"), F.transform(nested, lambda x: F.substring(F.rtrim(x), 2, 100000))).otherwise(bare)
    return F.coalesce(F.filter(F.transform(values, lambda x: F.when(v.rlike(r"^[\[{]"), F.regexp_replace(x, '"$', "")).otherwise(x)), lambda x: x != ""), F.array().cast("array<string>"))


def labelled_chats(text: Column) -> Column:
    """Distinct numbers in international form that stand behind the chat service's name."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CHAT_LABEL), F.lit(1)), e164), lambda x: x.isNotNull()))
