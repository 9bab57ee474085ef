"""What a profile's address or a hit's title says about a person; country labels; address patterns of firms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import path

# Parts of a profile address that are no names, and small words inside names.
GENERIC = [
    "admin", "buyer", "company", "contact", "director", "employee", "employees", "engineer", "manager", "member", "members", "official", "people",
    "person", "profile", "procurement", "purchasing", "quality", "search", "sales", "sourcing", "technical", "unknown", "user",
]
PARTICLES = ["da", "de", "del", "den", "der", "di", "do", "dos", "du", "la", "le", "van", "von"]

# Labels of countries in other words than their two letters.
REGIONS = {
    "japan": "JP", "日本": "JP", "vietnam": "VN", "越南": "VN", "korea": "KR", "south korea": "KR", "韩国": "KR", "韓國": "KR", "russia": "RU",
    "russian federation": "RU", "俄罗斯": "RU", "spain": "ES", "西班牙": "ES", "thailand": "TH", "泰国": "TH",
}

PATTERNS = ("first.last", "first", "flast", "f.last", "first_last", "firstlast")


def _slug_words(url: Column) -> Column:
    parts = F.filter(F.split(F.lower(path(url)), "/"), lambda p: p != "")
    words = F.filter(F.split(F.get(parts, 1), "[-_]+"), lambda w: w != "")
    return F.when((F.size(parts) == 2) & (F.get(parts, 0) == "in"), words)


def stable_id(url: Column) -> Column:
    """The last part of a person's profile address if it has a figure; empty otherwise."""
    last = F.element_at(_slug_words(url), -1)
    return F.when(last.rlike(r"\d"), last).otherwise("")


def name_from_profile(url: Column) -> Column:
    """A name of two to six words spelt in a profile address; empty where the address holds none."""
    words = _slug_words(url)
    named = F.when(F.element_at(words, -1).rlike(r"\d"), F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - 1))).otherwise(words)
    good = F.forall(named, lambda w: w.rlike(r"^\p{L}{2,}$") & ~w.isin(GENERIC))
    spelt = F.transform(named, lambda w, i: F.when((i > 0) & w.isin(PARTICLES), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100))))
    return F.coalesce(F.when((F.size(words) >= 2) & F.size(named).between(2, 6) & good, F.array_join(spelt, " ")), F.lit(""))


def region(country: Column) -> Column:
    """Two capital letters of a country's label; null for a label that isn't known."""
    label = F.trim(F.regexp_replace(country, r"\s+", " "))
    known = F.create_map(*[F.lit(x) for pair in REGIONS.items() for x in pair])
    return F.when(label.rlike("^[A-Za-z]{2}$"), F.upper(label)).otherwise(F.try_element_at(known, F.lower(label)))


def pattern_of(local: Column, first: Column, last: Column) -> Column:
    """How an address' local part is made of a first and a last name; empty for any other way."""
    initial = F.substring(first, 1, 1)
    return (
        F.when(local == F.concat(first, F.lit("."), last), "first.last")
        .when(local == first, "first")
        .when(local == F.concat(initial, last), "flast")
        .when(local == F.concat(initial, F.lit("."), last), "f.last")
        .when(local == F.concat(first, F.lit("_"), last), "first_last")
        .when(local == F.concat(first, last), "firstlast")
        .otherwise("")
    )


def shape_of(local: Column) -> Column:
    """How an address' local part looks: 'f.last', 'first.last' or 'first_last'; empty for any other look."""
    plain = F.regexp_replace(local, r"\+.*$", "")
    return F.when(plain.rlike(r"^[a-z]\.[a-z]{2,}$"), "f.last").when(plain.rlike(r"^[a-z]{2,}\.[a-z]{2,}$"), "first.last").when(plain.rlike(r"^[a-z]{2,}_[a-z]{2,}$"), "first_last").otherwise("")


def rendered(pattern: Column, first: Column, last: Column) -> Column:
    initial = F.substring(first, 1, 1)
    return (
        F.when(pattern == "first.last", F.concat(first, F.lit("."), last))
        .when(pattern == "first", first)
        .when(pattern == "flast", F.concat(initial, last))
        .when(pattern == "f.last", F.concat(initial, F.lit("."), last))
        .when(pattern == "first_last", F.concat(first, F.lit("_"), last))
        .when(pattern == "firstlast", F.concat(first, last))
    )


# Search engines asked everywhere, and the one asked besides in some regions.
EVERYWHERE = "google cse"
LOCAL_ENGINES = {"BY": "yandex", "CN": "baidu", "KG": "yandex", "KR": "naver", "KZ": "yandex", "RU": "yandex", "UZ": "yandex"}


def engines_of(region_: Column) -> Column:
    """The engines of a region with one of its own; an empty array for any other region and for null."""
    own = F.try_element_at(F.create_map(*[F.lit(x) for pair in LOCAL_ENGINES.items() for x in pair]), F.upper(F.trim(region_)))
    return F.when(own.isNotNull(), F.array(F.lit(EVERYWHERE), own)).otherwise(F.array().cast("array<string>"))


def listed(value: Column) -> Column:
    """Names of a list with commas between, trimmed, none empty."""
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")
