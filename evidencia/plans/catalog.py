"""Queries by name over the project's tables, and the SQL that gives the same rows.

SQL patterns avoid look-around, which DuckDB's engine doesn't have; unit tests cover the exact versions. Timestamps
leave as text or whole microseconds so that both engines give the same values.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import contacts, names, urls
from ..operators import ledger, matching, ordered, reports, signals
from ..runtime import table
from ..streaming import ledger as streams

DOMAIN = "linkedin.example"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL for it where SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Pieces of SQL used more than once.
HOST = r"regexp_replace(regexp_extract(lower(trim({u})), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@\[\]]+)(?::\d*)?(?:[/?#]|$)', 1), '^www\.', '')"
PAGE_KEY = r"regexp_replace(regexp_replace(trim({u}), '#.*$', ''), '/+$', '')"
PATH = r"regexp_replace(url_decode(regexp_extract(trim({u}), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '/+$', '')"
PROFILE_KEY = (
    "CASE WHEN {u} IS NULL THEN NULL WHEN " + HOST + " = 'linkedin.example' OR " + HOST + " LIKE '%.linkedin.example' THEN 'https://www.linkedin.example/' || "
    "array_to_string(CASE WHEN list_filter(string_split(lower(" + PATH + "), '/'), lambda p: p <> '')[1] IN ('in', 'company', 'school') "
    "THEN list_filter(string_split(lower(" + PATH + "), '/'), lambda p: p <> '')[1:2] ELSE list_filter(string_split(lower(" + PATH + "), '/'), lambda p: p <> '') END, '/') ELSE '' END"
)
HIT_KEY = "coalesce(nullif(" + PROFILE_KEY + ", ''), " + PAGE_KEY + ")"
FLAT = r"""list_filter(CASE WHEN regexp_matches(trim({c}), '^[\[{{]')
  THEN list_transform(list_filter(regexp_extract_all(trim({c}), '"(?:[^"\\]|\\.)*"\s*:?'), lambda x: x NOT LIKE '%:'), lambda x: regexp_replace(substr(rtrim(x), 2), '"$', ''))
  ELSE [trim({c})] END, lambda x: x <> '')"""


#: Addresses of a text as contacts.emails finds them; signs between words are doubled, so that each address has its own two neighbours.
_AT = r"regexp_replace({t}, '(\w)\s*[(\[]\s*at\s*[)\]]\s*(\w)', '\1@\2', 'gi')"
_ADDRESSES = r"list_distinct(list_transform(regexp_extract_all(regexp_replace(" + _AT + r", '([^\w.+%@-])', '\1\1', 'g'), '(?:^|[^\w.+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}})(?:[^\w-]|$)', 1), lambda e: lower(e)))"
MAILS = (
    "mails AS (SELECT page_id, company_id, regexp_replace(trim(url), '/+$', '') AS source, " + _ADDRESSES.format(t="markdown") + " AS es FROM pdf_pages WHERE markdown IS NOT NULL),"
    " mail AS (SELECT page_id, company_id, source, unnest(list_filter(es, lambda e: NOT ((e LIKE 'mailto%' AND list_contains(es, substr(e, 7))) OR (e LIKE 'to%' AND list_contains(es, substr(e, 3)))))) AS value FROM mails)"
)
#: Sections of a text as signals.sections cuts them, blank ones included.
SECTIONS = r"unnest(string_split(regexp_replace(regexp_replace(regexp_replace({t}, '\n\s*\n', chr(1), 'g'), '\n([ \t]*#{{1,6}}\s)', chr(1) || '\1', 'g'), '\n([ \t]*\*\*[^*\n]+\*\*[ \t]*)(\n|$|\x01)', chr(1) || '\1\2', 'g'), chr(1)))"


def page_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, company_id, source, value): the addresses of each page."""
    pages = table(spark, sf_dir, "pdf_pages").where("markdown is not null")
    return pages.select("page_id", "company_id", urls.source_key(F.col("url")).alias("source"), F.explode(contacts.emails(F.col("markdown"))).alias("value"))


# ---- values and texts


@query("WITH " + MAILS + " SELECT page_id, value AS email FROM mail")
def contact_email_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_mails(spark, sf_dir).select("page_id", F.col("value").alias("email"))


_NUMBER = r"((?:\+|00)\s?\d[\d ()./-]{6,20}\d)"
_E164 = r"(CASE WHEN length(regexp_replace(regexp_replace(replace(v, '(0)', ''), '\D', '', 'g'), '^00', '')) BETWEEN 8 AND 15 AND regexp_replace(regexp_replace(replace(v, '(0)', ''), '\D', '', 'g'), '^00', '') NOT LIKE '0%' THEN '+' || regexp_replace(regexp_replace(replace(v, '(0)', ''), '\D', '', 'g'), '^00', '') END)"
_FAXED = r"(?i)\b(?:tele|mobile )?(?:fax|facsimile|t[ée]l[ée]copie)\b[ \t]*[:：-]?\s*[+\d][\d ()./-]{6,20}\d"
_CHAT_LABEL = r"(?i)\bwhatsapp\b[^\d+\n]{0,12}" + _NUMBER
_CHAT_LINK = r"(?i)https?://(?:wa\.me/|api\.whatsapp\.com/send\?phone=)\+?(\d[\d -]{5,18})"
_PROFILES = r"(?i)(https?://(?:[a-z]{2,3}\.)?linkedin\.example/in/[\w%./?=&-]+)"
_TEXTS = "p AS (SELECT page_id, markdown AS t FROM pdf_pages WHERE markdown IS NOT NULL)"


@query(
    "WITH " + MAILS + ", " + _TEXTS + ", chat AS (SELECT page_id, '+' || regexp_replace(unnest(regexp_extract_all(t, '" + _CHAT_LINK + "', 1)), '\\D', '', 'g') AS value FROM p UNION SELECT page_id, " + _E164 + " FROM (SELECT page_id, unnest(regexp_extract_all(t, '" + _CHAT_LABEL + "', 1)) AS v FROM p)),"
    " num AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(t, '" + _FAXED + "', ' ', 'g'), '([^\\d ()./+-])', '\\1\\1', 'g'), '(?:^|[^\\d.,/-])" + _NUMBER + "(?:[^\\d]|$)', 1)) AS v FROM p),"
    " prof AS (SELECT DISTINCT page_id, regexp_replace(u, '[.,;:)\\]}]+$', '') AS u FROM (SELECT page_id, unnest(regexp_extract_all(t, '" + _PROFILES + "', 1)) AS u FROM p))"
    " SELECT DISTINCT page_id, channel, value FROM (SELECT page_id, 'email' AS channel, value FROM mail UNION ALL SELECT page_id, 'whatsapp', value FROM chat UNION ALL SELECT page_id, 'phone', value FROM chat UNION ALL SELECT page_id, 'phone', " + _E164 + " FROM num UNION ALL SELECT page_id, 'linkedin', " + PROFILE_KEY.format(u="u") + " FROM prof) WHERE value <> ''"
)
def contact_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of all channels of all pages."""
    return signals.signals(table(spark, sf_dir, "pdf_pages"), "page_id", "url", "markdown", DOMAIN).select("page_id", "channel", "value").distinct()


@query("WITH " + MAILS + r""", c AS (SELECT DISTINCT lower(trim(v)) AS value FROM (SELECT unnest(x.c."values") AS v, x.c.channel AS channel FROM (SELECT unnest(contact_conflicts) AS c FROM pdf_pages) x) WHERE channel = 'email')
SELECT page_id, value FROM mail WHERE value NOT IN (SELECT value FROM c)""")
def conflict_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubt = signals.conflicts(table(spark, sf_dir, "pdf_pages"), "url", "contact_conflicts").where("channel = 'email'")
    return matching.without_conflicts(page_mails(spark, sf_dir).select("page_id", "value"), doubt, ["value"])


@query("SELECT hit_id, " + HOST.format(u="url") + " AS host FROM search_hits WHERE url IS NOT NULL")
def url_hostname(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "search_hits").where("url is not null").select("hit_id", urls.host(F.col("url")).alias("host"))


@query(
    "WITH h AS (SELECT hit_id, " + HOST.format(u="url") + r""" AS host FROM search_hits WHERE url IS NOT NULL
UNION ALL SELECT * FROM (VALUES (-1, 'shop.example.co.uk'), (-2, 'example.co.uk'), (-3, 'a.b.example.org'), (-4, 'com')) v(hit_id, host)),
p AS (SELECT hit_id, host, string_split(host, '.') AS s FROM h)
SELECT hit_id, CASE WHEN len(s) < 2 THEN host
  WHEN length(s[-1]) = 2 AND len(s) >= 3 AND s[-2] IN ('ac', 'co', 'com', 'gov', 'net', 'org') THEN array_to_string(s[-3:], '.') ELSE array_to_string(s[-2:], '.') END AS site FROM p"""
)
def url_site_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "search_hits").where("url is not null").select("hit_id", "url")
    extra = spark.createDataFrame([(-1, "https://shop.example.co.uk/"), (-2, "https://example.co.uk"), (-3, "http://a.b.example.org/x"), (-4, "https://com/")], "hit_id long, url string")
    return hits.unionByName(extra).select("hit_id", urls.site_key(F.col("url")).alias("site"))


@query("SELECT contact_id, " + PROFILE_KEY.format(u="linkedin") + " AS profile FROM crm_contacts WHERE linkedin IS NOT NULL")
def profile_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "crm_contacts").where("linkedin is not null").select("contact_id", urls.profile_key(F.col("linkedin"), DOMAIN).alias("profile"))


@query(r"""WITH p AS (SELECT contact_id, trim(replace(phone, '(0)', '')) AS t FROM crm_contacts WHERE phone IS NOT NULL),
d AS (SELECT contact_id, t, regexp_replace(regexp_replace(t, '\D', '', 'g'), '^00', '') AS n FROM p)
SELECT contact_id, '+' || n AS e164 FROM d WHERE regexp_matches(t, '^(\+|00)') AND length(n) BETWEEN 8 AND 15 AND n NOT LIKE '0%'""")
def phone_e164(spark: SparkSession, sf_dir: str) -> DataFrame:
    phone = table(spark, sf_dir, "crm_contacts").where("phone is not null")
    return phone.select("contact_id", contacts.e164(F.col("phone")).alias("e164")).where("e164 is not null")


@query(
    r"""WITH u AS (SELECT DISTINCT name FROM companies WHERE name IS NOT NULL)
SELECT name, trim(regexp_replace(replace(lower(strip_accents(name)), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g')) AS normalised FROM u"""
)
def company_name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "companies").where("name is not null").select("name").distinct().select("name", names.normalised_name(F.col("name")).alias("normalised"))


_FOLDED = r"replace(lower(strip_accents(name)), 'ß', 'ss')"
_WORDED = r"trim(regexp_replace({t}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query(
    "WITH u AS (SELECT DISTINCT name, " + _FOLDED + " AS f FROM companies WHERE name IS NOT NULL), a AS (SELECT name, " + _WORDED.format(t="f") + " AS alias FROM u"
    " UNION SELECT name, b FROM (SELECT name, " + _WORDED.format(t="unnest(regexp_extract_all(f, '\\(([^()]*)\\)', 1))") + " AS b FROM u) WHERE length(replace(b, ' ', '')) >= 4"
    " UNION SELECT name, trim(regexp_replace(' ' || " + _WORDED.format(t="regexp_replace(f, '\\([^()]*\\)', ' ', 'g')") + ", '(?: (?:" + "|".join(names.LEGAL_FORMS) + "))+$', '')) FROM u) SELECT name, alias FROM a WHERE alias <> ''"
)
def company_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = table(spark, sf_dir, "companies").where("name is not null").select("name").distinct()
    return once.select("name", F.explode(names.name_aliases(F.col("name"))).alias("alias"))


@query(
    "WITH v AS (SELECT contact_id, 'email' AS channel, unnest(" + FLAT.format(c="additional_emails") + ") AS value FROM crm_contacts"
    " UNION ALL SELECT contact_id, 'phone', unnest(" + FLAT.format(c="additional_phones") + ") FROM crm_contacts"
    " UNION ALL SELECT contact_id, 'linkedin', unnest(" + FLAT.format(c="additional_linkedin") + ") FROM crm_contacts) SELECT contact_id, channel, value FROM v"
)
def nested_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    crm = table(spark, sf_dir, "crm_contacts")
    per = {"email": "additional_emails", "phone": "additional_phones", "linkedin": "additional_linkedin"}

    def tagged(channel: str, column: str) -> Column:
        return F.transform(contacts.flattened(F.col(column)), lambda v: F.struct(F.lit(channel).alias("channel"), v.alias("value")))

    items = F.concat(*[tagged(k, c) for k, c in per.items()])
    return crm.select("contact_id", F.explode(items).alias("x")).select("contact_id", "x.channel", "x.value")


@query("WITH s AS (SELECT page_id, " + SECTIONS.format(t="markdown") + " AS part FROM pdf_pages WHERE markdown IS NOT NULL) SELECT page_id, count(*) AS parts, CAST(sum(length(part)) AS BIGINT) AS chars FROM s WHERE trim(part) <> '' GROUP BY page_id")
def sections_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = signals.sections(table(spark, sf_dir, "pdf_pages").where("markdown is not null"), "page_id", "markdown")
    return parts.groupBy("page_id").agg(F.count("*").alias("parts"), F.sum(F.length("section").cast("long")).alias("chars"))


@query(r"""WITH l AS (SELECT page_id, l.href AS href, coalesce(l.text, '') AS label FROM (SELECT page_id, unnest(links) AS l FROM pdf_pages)
UNION SELECT page_id, regexp_extract(x, '\]\(([^)\s]+)\)$', 1), regexp_extract(x, '^\[([^\[\]\n]*)\]', 1) FROM (SELECT page_id, regexp_replace(unnest(regexp_extract_all(markdown, '(?:^|[^!])\[[^\[\]\n]*\]\([^)\s]+\)')), '^[^\[]', '') AS x FROM pdf_pages))
SELECT DISTINCT page_id, href, label FROM l WHERE regexp_matches(href, '(?i)^https?://') AND NOT regexp_matches(regexp_replace(href, '[?#].*$', ''), '(?i)\.(png|jpe?g|gif|svg|webp|ico|css|js|woff2?)$')""")
def page_links_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.page_links(table(spark, sf_dir, "pdf_pages"), "page_id", "markdown", "links")


# ---- ranking, first wins, sets


@query(
    "WITH h AS (SELECT hit_id, company_id, hit_ord, rank, " + HIT_KEY.format(u="url") + """ AS key FROM search_hits WHERE url IS NOT NULL)
SELECT company_id, key, hit_id FROM h QUALIFY row_number() OVER (PARTITION BY company_id, key ORDER BY hit_ord, hit_id) = 1"""
)
def url_key_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "search_hits").where("url is not null").withColumn("key", urls.hit_key(F.col("url"), DOMAIN))
    return ordered.first_by(hits, ["company_id", "key"], ["hit_ord", "hit_id"], []).select("company_id", "key", "hit_id")


@query(
    "WITH h AS (SELECT hit_id, company_id, query, rank, hit_ord, " + HIT_KEY.format(u="url") + """ AS key FROM search_hits WHERE url IS NOT NULL),
o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY company_id, query, key ORDER BY rank, hit_ord, hit_id) = 1)
SELECT company_id, query, hit_id, CAST(row_number() OVER (PARTITION BY company_id, query ORDER BY rank, hit_ord, hit_id) AS BIGINT) AS place FROM o QUALIFY place <= 5"""
)
def topk_stable_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "search_hits").where("url is not null").select("hit_id", "company_id", "query", "rank", "hit_ord", urls.hit_key(F.col("url"), DOMAIN).alias("key"))
    order = [F.col("rank"), F.col("hit_ord"), F.col("hit_id")]
    best = ordered.top_k(hits, [F.col("company_id"), F.col("query")], F.col("key"), order, 5)
    place = F.row_number().over(Window.partitionBy("company_id", "query").orderBy(*order)).cast("long")
    return best.select("company_id", "query", "hit_id", place.alias("place"))


@query("""WITH h AS (SELECT hit_id, company_id, query, CASE provider WHEN 'metasearch' THEN 0 WHEN 'listsearch' THEN 1 ELSE 2 END AS r FROM search_hits)
SELECT hit_id, company_id, r AS provider_rank FROM h QUALIFY r = min(r) OVER (PARTITION BY company_id, query)""")
def provider_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("provider") == "metasearch", 0).when(F.col("provider") == "listsearch", 1).otherwise(2)
    hits = table(spark, sf_dir, "search_hits").select("hit_id", "company_id", "query", rank.alias("provider_rank"))
    # null queries are a group of their own
    return ordered.fallback(hits.withColumn("q", F.struct("query")), ["company_id", "q"], "provider_rank").select("hit_id", "company_id", "provider_rank")


@query(
    "WITH h AS (SELECT hit_id, company_id, provider, hit_ord, " + HIT_KEY.format(u="url") + """ AS key FROM search_hits WHERE url IS NOT NULL),
a AS (SELECT *, CASE provider WHEN 'listsearch' THEN 0 WHEN 'metasearch' THEN 1 ELSE 2 END AS branch FROM h)
SELECT company_id, key, branch, hit_id FROM a QUALIFY row_number() OVER (PARTITION BY company_id, key ORDER BY branch, hit_ord, hit_id) = 1"""
)
def provider_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "search_hits").where("url is not null").select("hit_id", "company_id", "provider", "hit_ord", urls.hit_key(F.col("url"), DOMAIN).alias("key"))
    # a union of the providers' hits in their order, those of no known provider last; one scan, as all come from one table
    branch = F.when(F.col("provider") == "listsearch", 0).when(F.col("provider") == "metasearch", 1).otherwise(2)
    return ordered.first_by(hits.withColumn("branch", branch), ["company_id", "key"], ["branch", "hit_ord", "hit_id"], []).select("company_id", "key", "branch", "hit_id")


@query("SELECT company_id, trim(query) AS query, min(hit_id) AS first_hit, count(*) AS hits FROM search_hits WHERE query IS NOT NULL GROUP BY 1, 2")
def query_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "search_hits").where("query is not null")
    return hits.groupBy("company_id", F.trim("query").alias("query")).agg(F.min("hit_id").alias("first_hit"), F.count("*").alias("hits"))


_TERMS = lambda ts: "(" + " OR ".join(f"contains(v, '{t}')" for t in ts) + ")"


@query(
    "WITH h AS (SELECT hit_id, company_id, hit_ord, lower(concat_ws(' ', " + PATH.format(u="url") + ", title)) AS v FROM search_hits WHERE url IS NOT NULL),"
    " p AS (SELECT *, CASE WHEN " + _TERMS(urls.FORM_TERMS) + " THEN 3 WHEN " + _TERMS(urls.CONTACT_TERMS) + " THEN 0 WHEN " + _TERMS(urls.OFFICIAL_TERMS) + " THEN 1 ELSE 2 END AS priority FROM h)"
    " SELECT company_id, hit_id, priority FROM p QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY priority, hit_ord, hit_id) <= 12"
)
def link_priority_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "search_hits").where("url is not null").select("hit_id", "company_id", "hit_ord", urls.link_priority(F.col("url"), F.col("title")).alias("priority"))
    place = F.row_number().over(Window.partitionBy("company_id").orderBy("priority", "hit_ord", "hit_id"))
    return hits.withColumn("place", place).where("place <= 12").select("company_id", "hit_id", "priority")


@query("""SELECT company_id, name, website, country, crm_contact_count, CAST(epoch_us(updated_at) AS BIGINT) AS updated_us FROM
(SELECT DISTINCT company_id, name, website, country, crm_contact_count, updated_at FROM companies)
QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY updated_at DESC, name DESC NULLS LAST, website DESC NULLS LAST, country DESC NULLS LAST, crm_contact_count DESC NULLS LAST) = 1""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    firms = table(spark, sf_dir, "companies").select("company_id", "updated_at", "name", "website", "country", "crm_contact_count")
    return ledger.latest(firms, "company_id", ["updated_at"]).withColumn("updated_us", F.expr("unix_micros(cast(updated_at as timestamp))")).drop("updated_at")


# ---- joins


_CRM_KEYS = r"""k AS (SELECT contact_id, company_id, 'name' AS channel, lower(trim(name)) AS key FROM crm_contacts
UNION SELECT contact_id, company_id, 'email', lower(trim(email)) FROM crm_contacts
UNION SELECT contact_id, company_id, 'phone', regexp_replace(regexp_replace(phone, '\D', '', 'g'), '^00', '') FROM crm_contacts
UNION SELECT contact_id, company_id, 'linkedin', nullif(""" + PROFILE_KEY.format(u="linkedin") + r""", '') FROM crm_contacts),
u AS (SELECT * FROM k WHERE key IS NOT NULL AND key <> '' AND company_id IS NOT NULL)"""


def _crm_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    crm = table(spark, sf_dir, "crm_contacts")
    one = lambda c: F.array(c)
    channels = {"name": one(F.lower(F.trim("name"))), "email": one(F.lower(F.trim("email"))), "phone": one(contacts.phone_digits(F.col("phone"))), "linkedin": one(urls.profile_key(F.col("linkedin"), DOMAIN))}
    return matching.exploded_keys(crm, F.col("contact_id"), F.col("company_id"), channels)


@query(
    "WITH " + _CRM_KEYS + """, f AS (SELECT company_id, channel, key, min(contact_id) AS first FROM u GROUP BY ALL HAVING count(*) > 1)
SELECT u.contact_id, array_to_string(list_sort(list(DISTINCT u.channel)), ',') AS matched_by FROM u JOIN f ON u.company_id = f.company_id AND u.channel = f.channel AND u.key = f.key
WHERE u.contact_id > f.first GROUP BY u.contact_id"""
)
def crm_dedup_matched_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts that an earlier contact of the same firm already has, and by which channels; no pairs are made."""
    keys = _crm_keys(spark, sf_dir)
    first = keys.groupBy("scope", "channel", "key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = keys.join(first, ["scope", "channel", "key"]).where("id > first")
    return again.groupBy(F.col("id").alias("contact_id")).agg(F.array_join(F.sort_array(F.collect_set("channel")), ",").alias("matched_by"))


@query(
    "WITH " + _CRM_KEYS + """, f AS (SELECT company_id, channel, key, min(contact_id) AS first FROM u GROUP BY ALL)
SELECT c.contact_id FROM crm_contacts c WHERE c.contact_id NOT IN
(SELECT u.contact_id FROM u JOIN f ON u.company_id = f.company_id AND u.channel = f.channel AND u.key = f.key WHERE u.contact_id > f.first)"""
)
def crm_anti_new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = crm_dedup_matched_by(spark, sf_dir)
    return table(spark, sf_dir, "crm_contacts").select("contact_id").join(known, "contact_id", "left_anti")


@query(r"""WITH d AS (SELECT dup_id, company_id, lower(trim(full_name)) AS key FROM crm_duplicates WHERE full_name IS NOT NULL),
c AS (SELECT DISTINCT company_id, lower(trim(name)) AS key FROM crm_contacts WHERE name IS NOT NULL AND trim(name) <> '')
SELECT d.dup_id, c.key IS NOT NULL AS known FROM d LEFT JOIN c ON d.company_id = c.company_id AND d.key = c.key""")
def crm_known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    dup = table(spark, sf_dir, "crm_duplicates").where("full_name is not null").select("dup_id", "company_id", F.lower(F.trim("full_name")).alias("key"))
    crm = table(spark, sf_dir, "crm_contacts").select("company_id", F.lower(F.trim("name")).alias("key")).where("key is not null and key <> ''").distinct().withColumn("hit", F.lit(True))
    return dup.join(crm, ["company_id", "key"], "left").select("dup_id", F.coalesce("hit", F.lit(False)).alias("known"))


@query(r"""WITH d AS (SELECT DISTINCT company_id, lower(trim(full_name)) AS name FROM crm_duplicates WHERE full_name IS NOT NULL),
p AS (SELECT contact_id, company_id, lower(trim(name)) AS name FROM crm_contacts WHERE name IS NOT NULL AND trim(name) <> '')
SELECT d.company_id, d.name, min(p.contact_id) AS contact_id FROM d JOIN p ON d.company_id = p.company_id AND d.name = p.name GROUP BY d.company_id, d.name HAVING count(DISTINCT p.contact_id) = 1""")
def unique_match_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names found again that exactly one contact of the firm bears; a name of two contacts is attached to none."""
    people = table(spark, sf_dir, "crm_contacts").where("name is not null and trim(name) <> ''").select("contact_id", "company_id", F.lower(F.trim("name")).alias("name"))
    found = table(spark, sf_dir, "crm_duplicates").where("full_name is not null").select("company_id", F.lower(F.trim("full_name")).alias("name")).distinct()
    pairs = found.join(people, ["company_id", "name"]).select(F.struct("company_id", "name").alias("of"), "contact_id")
    return matching.only_match(pairs, "of", "contact_id").select("of.company_id", "of.name", "contact_id")


@query(
    r"""WITH n AS (SELECT DISTINCT company_id, trim(regexp_replace(lower(name), '[^\p{L}\p{N}]+', ' ', 'g')) AS phrase FROM companies WHERE name IS NOT NULL),
t AS (SELECT hit_id, company_id, trim(regexp_replace(lower(concat_ws(' ', title, snippet)), '[^\p{L}\p{N}]+', ' ', 'g')) AS text FROM search_hits)
SELECT DISTINCT t.hit_id, n.phrase FROM t JOIN n ON t.company_id = n.company_id WHERE n.phrase <> '' AND contains(' ' || t.text || ' ', ' ' || n.phrase || ' ')"""
)
def mention_word_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    phrases = table(spark, sf_dir, "companies").where("name is not null").select("company_id", norm(F.col("name")).alias("phrase")).distinct()
    texts = table(spark, sf_dir, "search_hits").select("hit_id", "company_id", norm(F.concat_ws(" ", "title", "snippet")).alias("text"))
    return matching.mentions(texts, phrases, "company_id", "text", "phrase").select("hit_id", "phrase").distinct()


@query(r"""WITH l AS (SELECT page_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS n FROM pdf_pages WHERE markdown IS NOT NULL),
a AS (SELECT page_id, n, line, last_value(CASE WHEN regexp_matches(line, '^#+ ') THEN line END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS heading FROM l)
SELECT page_id, CAST(n AS INTEGER) AS line_no, heading FROM a WHERE contains(line, '@')""")
def heading_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last heading before each line with an address."""
    lines = table(spark, sf_dir, "pdf_pages").where("markdown is not null").select("page_id", F.posexplode(F.split("markdown", "\n")).alias("pos", "line"))
    marked = matching.last_before(lines, [F.col("page_id")], [F.col("pos")], F.col("line").rlike("^#+ "), F.col("line"), "heading")
    return marked.where(F.contains("line", F.lit("@"))).select("page_id", (F.col("pos") + 1).alias("line_no"), "heading")


@query(r"""WITH p AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id AS click_id, user_id, epoch_us(ts) // 1000000 AS t FROM events WHERE event_type = 'click')
SELECT p.event_id, CAST(abs(p.s - c.t) AS BIGINT) AS distance, c.click_id FROM p JOIN c ON p.user_id = c.user_id AND abs(p.s - c.t) <= 43200
QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.s - c.t), c.t, c.click_id) = 1""")
def nearest_neighbor_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("s"))
    clicks = events.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("s").alias("t"))
    return matching.nearest(events.where("event_type = 'purchase'").select("event_id", "user_id", "s"), clicks, ["user_id"], "s", "t", 43200, "click_id").select("event_id", "distance", "click_id")


# ---- ledgers, windows, budgets


@query("""WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)
SELECT user_id, CAST(sum(CASE WHEN gap BETWEEN 0 AND 21600000000 THEN gap ELSE 0 END) AS BIGINT) AS active_us FROM g GROUP BY user_id""")
def active_seconds_gap_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.capped_gaps(table(spark, sf_dir, "events"), ["user_id"], "ts", 21600)


@query("""WITH r AS (SELECT user_id, event_type, ts, event_id, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
s AS (SELECT user_id, run, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS n FROM r GROUP BY user_id, run)
SELECT user_id, CAST(max(n) AS BIGINT) AS longest FROM s GROUP BY user_id""")
def failure_streak_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = ordered.streaks(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")
    return marked.groupBy("user_id").agg(F.max("streak").alias("longest"))


@query("SELECT company_key, CAST(epoch_us(max(heartbeat_at)) AS BIGINT) AS last_us FROM jobs WHERE company_key IS NOT NULL GROUP BY company_key HAVING max(heartbeat_at) < TIMESTAMP '2026-06-30 23:55:00'")
def stale_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = ledger.stale(table(spark, sf_dir, "jobs").where("company_key is not null"), "company_key", "heartbeat_at", dt.datetime(2026, 7, 1), 5)
    return old.select("company_key", F.expr("unix_micros(cast(last_seen as timestamp))").alias("last_us"))


@query("""SELECT company_key, id, CAST(epoch_us(created_at) AS BIGINT) AS created_us FROM (SELECT DISTINCT company_key, id, created_at FROM jobs WHERE company_key IS NOT NULL AND created_at IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY company_key ORDER BY created_at, id) = 1""")
def first_claim_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = ledger.first_claim(table(spark, sf_dir, "jobs"), "company_key", "created_at", "id")
    return first.select("company_key", "id", F.expr("unix_micros(cast(created_at as timestamp))").alias("created_us"))


@query("""WITH d AS (SELECT DISTINCT * FROM jobs)
SELECT id, CAST(greatest(0, CAST(epoch(date_trunc('second', coalesce(finished_at, heartbeat_at))) - epoch(date_trunc('second', started_at)) AS BIGINT)) AS BIGINT) AS elapsed FROM d WHERE started_at IS NOT NULL AND coalesce(finished_at, heartbeat_at) IS NOT NULL""")
def job_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "jobs").distinct().where("started_at is not null and coalesce(finished_at, heartbeat_at) is not null")
    return jobs.select("id", ledger.elapsed_seconds(F.col("started_at"), F.coalesce("finished_at", "heartbeat_at")).alias("elapsed"))


@query("SELECT coalesce(batch_id, '-') AS batch, count(DISTINCT id) AS jobs, CAST(min(epoch_us(created_at)) AS BIGINT) AS first_us FROM jobs GROUP BY 1")
def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = table(spark, sf_dir, "jobs").groupBy(F.coalesce("batch_id", F.lit("-")).alias("batch"), "id").agg(F.min(F.expr("unix_micros(cast(created_at as timestamp))")).alias("us"))
    return once.groupBy("batch").agg(F.count("*").alias("jobs"), F.min("us").alias("first_us"))


@query("SELECT DISTINCT company_id, name FROM companies WHERE company_id > 40 AND trim(name) <> '' AND trim(website) <> '' ORDER BY company_id, name LIMIT 50")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 50: the limit is the feature."""
    firms = table(spark, sf_dir, "companies").where("trim(name) <> '' and trim(website) <> ''").select("company_id", "name").distinct()
    return ledger.keyset_page(firms, "company_id", 40, 50, ["name"])


@query("""WITH f AS (SELECT DISTINCT company_id FROM companies)
SELECT f.company_id, count(c.contact_id) AS contacts, coalesce(list_sort(list({'contact_id': c.contact_id, 'name': coalesce(c.name, ''), 'email': coalesce(c.email, '')}) FILTER (c.contact_id IS NOT NULL)), []) AS nested FROM f LEFT JOIN crm_contacts c ON f.company_id = c.company_id GROUP BY f.company_id""")
def correlated_count_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each firm with its contacts nested in one row, as a point read of a firm wants them; an empty list for none."""
    firms = table(spark, sf_dir, "companies").select("company_id").distinct()
    one = F.struct("contact_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("email", F.lit("")).alias("email"))
    listed = table(spark, sf_dir, "crm_contacts").groupBy("company_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(one)).alias("list"))
    return firms.join(listed, "company_id", "left").select("company_id", F.coalesce("n", F.lit(0)).alias("contacts"), F.coalesce("list", F.array().cast("array<struct<contact_id:bigint,name:string,email:string>>")).alias("nested"))


@query("""WITH f AS (SELECT DISTINCT company_id, name FROM companies WHERE name IS NOT NULL)
SELECT company_id, name, CASE WHEN lower(name) = 'ga' THEN 0 WHEN lower(name) LIKE 'ga%' THEN 1 ELSE 2 END AS tier FROM f WHERE name ILIKE '%ga%' ORDER BY tier, lower(name), company_id, name LIMIT 20""")
def ilike_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best matches of a term, its signs taken as they are; the limit is the feature."""
    firms = table(spark, sf_dir, "companies").where("name is not null").select("company_id", "name").distinct()
    return ledger.best_matches(firms, "name", "ga", 20, ["company_id", "name"])


@query(
    "WITH h AS (SELECT DISTINCT company_id, query, " + HIT_KEY.format(u="url") + """ AS key, unnest(CASE WHEN len(engines) > 0 THEN engines ELSE ['unattributed'] END) AS engine FROM search_hits WHERE url IS NOT NULL),
p AS (SELECT engine, key, count(*) AS n FROM h GROUP BY engine, key), o AS (SELECT key, count(*) AS engines FROM p GROUP BY key)
SELECT p.engine, CAST(sum(p.n) AS BIGINT) AS observations, count(*) AS urls, CAST(sum(CASE WHEN o.engines = 1 THEN 1 ELSE 0 END) AS BIGINT) AS exclusive_urls FROM p JOIN o ON p.key = o.key GROUP BY p.engine"""
)
def engine_attribution_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "search_hits").where("url is not null")
    return reports.attribution(hits, F.col("engines"), F.struct("company_id", "query"), urls.hit_key(F.col("url"), DOMAIN))


@query(
    "WITH v AS (SELECT company_id, 'email' AS channel, lower(trim(email)) AS value FROM crm_contacts UNION SELECT company_id, 'phone', regexp_replace(regexp_replace(phone, '\\D', '', 'g'), '^00', '') FROM crm_contacts"
    " UNION SELECT company_id, 'linkedin', nullif(" + PROFILE_KEY.format(u="linkedin") + ", '') FROM crm_contacts)"
    " SELECT company_id, count(*) FILTER (channel = 'email') AS email, count(*) FILTER (channel = 'phone') AS phone, count(*) FILTER (channel = 'linkedin') AS linkedin, count(*) AS total FROM v WHERE value IS NOT NULL AND value <> '' GROUP BY company_id"
)
def distinct_methods_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    crm = table(spark, sf_dir, "crm_contacts")
    per = {"email": F.lower(F.trim("email")), "phone": contacts.phone_digits(F.col("phone")), "linkedin": F.nullif(urls.profile_key(F.col("linkedin"), DOMAIN), F.lit(""))}
    each = crm.select("company_id", F.explode(F.array(*[F.struct(F.lit(k).alias("channel"), v.alias("value")) for k, v in per.items()])).alias("x"))
    return reports.coverage(each.select("company_id", "x.*").where("value is not null and value <> ''"), "company_id", tuple(per))


@query("""WITH d AS (SELECT site, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY site ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents WHERE n_chars IS NOT NULL AND site IS NOT NULL)
SELECT doc_id, CAST(used AS BIGINT) AS used, CAST(greatest(0, least(n_chars, 20000 - (used - n_chars))) AS BIGINT) AS kept FROM d""")
def char_budget_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("n_chars is not null and site is not null").select("site", "doc_id", "n_chars")
    return ordered.running_cap(docs, ["site"], "doc_id", F.col("n_chars"), 20000, 4096).select("doc_id", F.col("used").cast("long"), F.col("kept").cast("long"))


@query("""WITH RECURSIVE p AS (SELECT company_id, page_id, length(markdown) AS n, row_number() OVER (PARTITION BY company_id ORDER BY page_id) AS i, count(*) OVER (PARTITION BY company_id) AS items FROM pdf_pages WHERE markdown IS NOT NULL),
r AS (SELECT company_id, page_id, i, items, least(n, 20000, 100000 // items) AS part, 100000 - least(n, 20000, 100000 // items) AS rest FROM p WHERE i = 1
UNION ALL SELECT p.company_id, p.page_id, p.i, p.items, least(p.n, 20000, r.rest // (p.items - p.i + 1)), r.rest - least(p.n, 20000, r.rest // (p.items - p.i + 1)) FROM r JOIN p ON p.company_id IS NOT DISTINCT FROM r.company_id AND p.i = r.i + 1)
SELECT page_id, CAST(part AS BIGINT) AS part FROM r""")
def fair_share_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each page fits a firm's budget: in turn its size, the cap, or an equal part of what is left."""
    pages = table(spark, sf_dir, "pdf_pages").where("markdown is not null").select("company_id", "page_id", F.length("markdown").cast("long").alias("n"))
    return ordered.fair_share_rows(pages, "company_id", "page_id", "n", 100_000, 20_000).select("page_id", "part")


@query(r"""WITH m AS (SELECT contact_id, lower(trim(email)) AS e FROM crm_contacts WHERE regexp_matches(email, '^[^@\s]+@[^@\s]+$')),
p AS (SELECT string_split(e, '@')[2] AS domain, CASE WHEN regexp_matches(e, '^[a-z]+\.[a-z]+@') THEN 'first.last' WHEN regexp_matches(e, '^[a-z]+-[a-z]+@') THEN 'first-last' WHEN regexp_matches(e, '^[a-z]+_[a-z]@') THEN 'last_f' WHEN regexp_matches(e, '^[a-z]+@') THEN 'word' ELSE 'other' END AS pattern, contact_id FROM m)
SELECT domain, pattern, min(contact_id) AS first_contact, count(*) AS n FROM p GROUP BY domain, pattern""")
def email_pattern_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = table(spark, sf_dir, "crm_contacts").where(F.col("email").rlike(r"^[^@\s]+@[^@\s]+$")).select("contact_id", F.lower(F.trim("email")).alias("e"))
    shape = lambda p: F.col("e").rlike(p)
    pattern = F.when(shape(r"^[a-z]+\.[a-z]+@"), "first.last").when(shape("^[a-z]+-[a-z]+@"), "first-last").when(shape("^[a-z]+_[a-z]@"), "last_f").when(shape("^[a-z]+@"), "word").otherwise("other")
    return mails.select(F.get(F.split("e", "@"), 1).alias("domain"), pattern.alias("pattern"), "contact_id").groupBy("domain", "pattern").agg(F.min("contact_id").alias("first_contact"), F.count("*").alias("n"))


# ---- the ledger as a stream


@query("SELECT CAST(epoch_us(time_bucket(INTERVAL 1 day, ts)) AS BIGINT) AS day_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows over the events as a stream of all that is available."""
    stream = streams.event_stream(spark, sf_dir, late="3650 days")
    counted = streams.run_available(streams.windowed_counts(stream, "ts", "event_type", "1 day"), "windows", "update")
    return counted.select(F.expr("unix_micros(window_start)").alias("day_us"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)
SELECT user_id, CAST(sum(CASE WHEN gap BETWEEN 0 AND 21600000000 THEN gap ELSE 0 END) AS BIGINT) AS active_us FROM g GROUP BY user_id""")
def stream_active_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as active_seconds_gap_capped, with state in a stream."""
    stream = streams.event_stream(spark, sf_dir, late="3650 days")
    return streams.run_available(streams.active_time(stream, "user_id", "ts", 21600), "active", "update")
