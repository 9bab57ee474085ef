"""Contact signals in texts, with their source and order; sections, headings and links of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contacts import emails, labelled_chats, phones
from ..functions.urls import profile_key, source_key

SECTION = r"\n\s*\n|\n(?=[ \t]*#{1,6}\s)|\n(?=[ \t]*\*\*[^*\n]+\*\*[ \t]*(?:\n|$))"
MARKDOWN_LINK = r"(?<!!)\[([^\[\]\n]*)\]\(([^)\s]+)\)"
ASSET = r"(?i)\.(png|jpe?g|gif|svg|webp|ico|css|js|woff2?)$"


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_no, section): parts of a text between blank lines, headings and bold lines; blank ones left out.

    Null and blank texts have none.
    """
    each = df.select(F.col(key), F.posexplode(F.split(F.col(text), SECTION)).alias("section_no", "section"))
    return each.where(F.trim("section") != "")


def signals(df: DataFrame, key: str, url: str, text: str, domain: str = "linkedin.com") -> DataFrame:
    """(key, source_url, channel, value, ord): every distinct contact value of a text in order of its appearance.

    Channels: email, linkedin, whatsapp, phone. A whatsapp link or label counts as a phone too. Null texts have no signals.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    links = F.regexp_extract_all(body, F.lit(r"(?i)(https?://(?:[a-z]{2,3}\.)?" + domain.replace(".", r"\.") + r"/in/[\w%./?=&-]+)"), F.lit(1))
    profiles = F.array_distinct(F.transform(links, lambda x: profile_key(F.regexp_replace(x, r"[.,;:)\]}]+$", ""), domain)))
    chats = F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(r"(?i)https?://(?:wa\.me/|api\.whatsapp\.com/send\?phone=)\+?(\d[\d -]{5,18})"), F.lit(1)), lambda x: F.concat(F.lit("+"), F.regexp_replace(x, r"\D", ""))))
    chats = F.array_union(chats, labelled_chats(body))
    per = {"email": emails(body), "linkedin": profiles, "whatsapp": chats, "phone": F.array_union(chats, phones(body))}

    def tagged(channel: str, values: Column) -> Column:
        return F.transform(values, lambda x, i: F.struct(F.lit(channel).alias("channel"), x.alias("value"), i.alias("ord")))

    items = F.concat(*[tagged(c, v) for c, v in per.items()])
    each = df.select(F.col(key), source_key(F.col(url)).alias("source_url"), F.explode(items).alias("s"))
    return each.select(key, "source_url", "s.channel", "s.value", "s.ord").where("value <> ''")


def conflicts(df: DataFrame, url: str, column: str) -> DataFrame:
    """(channel, value): values that a page shows under one label and links to another."""
    each = df.select(F.explode(column).alias("c")).select("c.channel", F.explode("c.values").alias("value"))
    return each.select("channel", F.when(F.col("channel") == "email", F.lower(F.trim("value"))).otherwise(F.trim("value")).alias("value")).distinct()


def page_links(df: DataFrame, key: str, text: str, links: str | None = None) -> DataFrame:
    """(key, label, href) of structured and markdown links, web addresses only, files of a page's make-up left out."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"((?<!!)\[[^\[\]\n]*\]\([^)\s]+\))"), F.lit(1))
    written = F.transform(found, lambda x: F.struct(F.regexp_extract(x, MARKDOWN_LINK, 2).alias("href"), F.regexp_extract(x, MARKDOWN_LINK, 1).alias("label")))
    all_: Column = written
    if links:
        all_ = F.concat(F.transform(F.coalesce(F.col(links), F.array().cast("array<struct<href:string,text:string>>")), lambda x: F.struct(x["href"].alias("href"), F.coalesce(x["text"], F.lit("")).alias("label"))), written)
    each = df.select(F.col(key), F.explode(all_).alias("l")).select(key, "l.label", "l.href")
    return each.where(F.col("href").rlike("(?i)^https?://") & ~F.regexp_replace("href", "[?#].*$", "").rlike(ASSET)).distinct()


def bound_sections(found: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """(key, channel, value, section_no): the sections of its text in which each value stands."""
    from .claims import holds_value

    return found.join(parts, key).where(holds_value(F.col("channel"), F.col("value"), F.col("section"))).select(key, "channel", "value", "section_no").distinct()
