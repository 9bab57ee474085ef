"""URL columns. Every function is null-safe and stays on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Second-level labels under a country's domain that belong to the public suffix.
SECOND_LEVEL = ("ac", "co", "com", "gov", "net", "org")

# Terms of pages that confirm a form or hold terms of use, of contact pages, and of other official pages.
FORM_TERMS = ("privacy", "cookie", "terms-and-conditions", "thank-you", "thankyou", "submitted", "confirmation")
CONTACT_TERMS = (
    "brochure", "company-profile", "contact", "directory", "leadership", "management", "manual", "paia", "people",
    "popi", "profile", "staff", "supplier", "team", "kontakt", "ansprechpartner", "geschaeftsfuehr", "geschäftsführ",
    "einkauf", "vertrieb", "impressum", "standorte", "contato", "equipe", "contatti", "contacter", "einkaufs",
    "purchasing", "procurement", "yhteystiedot", "联系我们", "联系方式", "采购", "контакты",
)
OFFICIAL_TERMS = ("publication", "interview", "media-centre", "media-center", "press", "events", "about", "company", "news", "noticias", "quem-somos", "sobre")


def host(url: Column) -> Column:
    """Host in lower case without a leading www.; empty where the address has none or is malformed."""
    part = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@\[\]]+)(?::\d*)?(?:[/?#]|$)", 1)
    return F.regexp_replace(part, r"^www\.", "")


def has_user(url: Column) -> Column:
    return F.lower(F.trim(url)).rlike(r"^[a-z][a-z0-9+.-]*://[^/?#]*@")


def path(url: Column) -> Column:
    """Decoded path without query, fragment and closing slash."""
    raw = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(F.coalesce(F.try_url_decode(raw), raw), "/+$", "")


def site_key(url: Column) -> Column:
    """The last two labels of the host, three under a country's second-level domain."""
    parts = F.split(host(url), r"\.")
    n = F.size(parts)
    country = (F.length(F.element_at(parts, -1)) == 2) & (n >= 3) & F.get(parts, n - 2).isin(*SECOND_LEVEL)
    keep = F.when(country, 3).otherwise(2)
    return F.when(n < 2, host(url)).otherwise(F.array_join(F.slice(parts, F.greatest(F.lit(1), n - keep + 1), keep), "."))


def same_site(a: Column, b: Column) -> Column:
    return (site_key(a) != "") & (site_key(a) == site_key(b))


def page_key(url: Column) -> Column:
    """An address without fragment and closing slash: the identity of a page among hits."""
    return F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "/+$", "")


def source_key(url: Column) -> Column:
    """An address without closing slash but with its fragment: the identity of a piece of evidence."""
    return F.regexp_replace(F.trim(url), "/+$", "")


def profile_key(url: Column, domain: str = "linkedin.com") -> Column:
    """The canonical form of a profile, company or school address of `domain`; empty for any other address."""
    h = host(url)
    parts = F.filter(F.split(F.lower(path(url)), "/"), lambda p: p != "")
    head = F.when((F.size(parts) >= 2) & F.element_at(parts, 1).isin("in", "company", "school"), F.slice(parts, 1, 2)).otherwise(parts)
    return F.when((h == domain) | h.endswith("." + domain), F.concat(F.lit(f"https://www.{domain}/"), F.array_join(head, "/"))).otherwise(F.when(url.isNotNull(), ""))


def hit_key(url: Column, domain: str = "linkedin.com") -> Column:
    """What makes two hits the same: the profile they lead to, or else the page."""
    return F.coalesce(F.nullif(profile_key(url, domain), F.lit("")), page_key(url))


def link_priority(url: Column, text: Column) -> Column:
    """0 contact page, 1 other official page, 2 any other, 3 form confirmation or terms of use."""
    value = F.lower(F.concat_ws(" ", path(url), text))
    holds = lambda terms: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(value, t))
    return F.when(holds(FORM_TERMS), 3).when(holds(CONTACT_TERMS), 0).when(holds(OFFICIAL_TERMS), 1).otherwise(2)


def in_scope(website: Column, url: Column) -> Column:
    """Same host; below the website's own path where that is one firm's page on a group's site."""
    own, other = path(website), path(url)
    subtree = own.rlike(r"(?i)/(companies|empresas|subsidiaries)/[^/]+")
    inside = (other == own) | F.startswith(other, F.concat(own, F.lit("/")))
    return (host(website) != "") & (host(website) == host(url)) & (~subtree | inside)


def official_scope(website: Column, url: Column) -> Column:
    """The website's host or one under it, below the website's own path; an index page stands for its folder."""
    root = F.regexp_replace(path(website), r"(?i)/index\.(html?|php|aspx?)$", "")
    own, other = host(website), host(url)
    hosted = (own != "") & ((other == own) | F.endswith(other, F.concat(F.lit("."), own)))
    below = (root == "") | (path(url) == root) | F.startswith(path(url), F.concat(root, F.lit("/")))
    return F.coalesce(hosted & below, F.lit(False))


def on_domain(url: Column, domain: str) -> Column:
    """The host is the domain or lies under it."""
    return F.coalesce((host(url) == domain) | host(url).endswith("." + domain), F.lit(False))


def profile_kind(url: Column, domain: str = "linkedin.com") -> Column:
    """'person' or 'company' for an address of such a profile, else 'pdf' for a file's address, else empty."""
    first = F.get(F.filter(F.split(F.lower(path(url)), "/"), lambda p: p != ""), 0)
    social = on_domain(url, domain)
    return F.when(social & (first == "in"), "person").when(social & (first == "company"), "company").when(F.lower(path(url)).endswith(".pdf"), "pdf").otherwise("")


def distinctive(words: Column, url: Column, whole: bool = True) -> Column:
    """Whether a word of three letters or more stands in the address (or, if not whole, in its host), signs left out."""
    compact = F.regexp_replace(F.lower(F.coalesce(F.try_url_decode(url), url)) if whole else host(url), "[^a-z0-9]", "")
    return F.coalesce(F.exists(words, lambda w: (F.length(w) >= 3) & F.contains(compact, w)), F.lit(False))


def website(value: Column, strict: bool = False) -> Column:
    """A firm's website with https:// where it has no scheme; blank for a blank one.

    An address that isn't of the web, or has no host, is blank, or an error if strict.
    """
    text = F.trim(F.coalesce(value, F.lit("")))
    full = F.when(F.contains(text, F.lit("://")), text).otherwise(F.concat(F.lit("https://"), text))
    bad = F.raise_error(F.concat(F.lit("no web address: "), text)).cast("string") if strict else F.lit("")
    return F.when(text == "", "").when(full.rlike(r"(?i)^https?://([^/?#@]*@)?[^/?#:@\s]"), full).otherwise(bad)


def mirrored(url: Column, domain: str = "linkedin.com", mirror: str = "tt") -> Column:
    """A company profile's address and the one of its public mirror, each once; an empty array for any other address."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), r"^([A-Za-z]+://)[^/]+", f"$1{mirror}.{domain}")
    return F.when(profile_kind(url, domain) == "company", F.array_distinct(F.array(F.trim(url), plain))).otherwise(F.array().cast("array<string>"))
