"""Queries on claims, known contacts, evidence, budgets and the ledger's rest; registered in the catalog.

People are the pairs of capitalised words that a page names, their contacts the addresses one of its sections holds
beside them: the test tables have no table of candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import contacts, names, profiles, urls
from ..operators import claims, matching, ordered, reports, signals
from ..runtime import table
from ..sources.recorded import reject_reason
from ..sources.sinks import absent_only
from .catalog import DOMAIN, FLAT, HIT_KEY, HOST, MAILS, PATH, PROFILE_KEY, SECTIONS, page_mails, query

_PAIR = r"([A-Z][a-z]+ [A-Z][a-z]+)"
_SPACED = r"trim(regexp_replace(lower({t}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_SOURCE = "regexp_replace(trim({u}), '/+$', '')"
_PARTS = "part AS (SELECT page_id, " + _SOURCE.format(u="url") + " AS source, " + SECTIONS.format(t="markdown") + " AS section FROM pdf_pages WHERE markdown IS NOT NULL)"
_PEOPLE = "people AS (SELECT DISTINCT page_id, company_id, " + _SOURCE.format(u="url") + " AS source, unnest(regexp_extract_all(markdown, '" + _PAIR + "', 1)) AS name FROM pdf_pages WHERE markdown IS NOT NULL)"
_BOUND = (
    "WITH " + MAILS + ", " + _PARTS + ", " + _PEOPLE + ", bound AS (SELECT DISTINCT n.page_id, n.company_id, n.name, m.value FROM people n JOIN mail m ON n.page_id = m.page_id JOIN part s ON s.page_id = n.page_id"
    " WHERE contains(lower(s.section), m.value) AND contains(' ' || " + _SPACED.format(t="s.section") + " || ' ', ' ' || lower(n.name) || ' '))"
)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pdf_pages").where("markdown is not null")
    return signals.sections(pages, "page_id", "markdown")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, company_id, source, name): pairs of capitalised words of each page."""
    pages = table(spark, sf_dir, "pdf_pages").where("markdown is not null")
    return pages.select("page_id", "company_id", urls.source_key(F.col("url")).alias("source"), F.explode(F.regexp_extract_all("markdown", F.lit(_PAIR), F.lit(1))).alias("name")).distinct()


def bound_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, company_id, name, value): people with the addresses that a section of their page holds beside them."""
    made = people(spark, sf_dir).join(page_mails(spark, sf_dir).select("page_id", "value"), "page_id").withColumn("channel", F.lit("email")).drop("source")
    made = made.withColumn("source", F.col("page_id").cast("string")).withColumn("claim_id", F.concat_ws("|", "page_id", "name", "value"))
    quotes = parts(spark, sf_dir).select(F.col("page_id").cast("string").alias("source"), F.col("section").alias("text"))
    return claims.bindings(made, quotes).where("bound").select("page_id", "company_id", "name", "value")


@query(_BOUND + " SELECT page_id, name, value AS email FROM bound")
def evidence_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a page and addresses: bound where one section holds both."""
    return bound_people(spark, sf_dir).select("page_id", "name", F.col("value").alias("email"))


@query(_BOUND + ", one AS (SELECT page_id, value, min(name) AS name FROM bound GROUP BY page_id, value HAVING count(DISTINCT name) = 1) SELECT page_id, value, name FROM one")
def bound_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of a page that exactly one name of it binds."""
    return claims.sole_owner(bound_people(spark, sf_dir), ["page_id", "value"], "name")


@query(
    _BOUND + ", doubt AS (SELECT DISTINCT lower(trim(v)) AS value FROM (SELECT unnest(x.c.\"values\") AS v, x.c.channel AS channel FROM (SELECT unnest(contact_conflicts) AS c FROM pdf_pages) x) WHERE channel = 'email'),"
    " claim AS (SELECT n.page_id AS id, n.name, m.value, n.source, n.page_id FROM people n JOIN mail m ON n.page_id = m.page_id"
    " UNION ALL SELECT -c.contact_id, c.name, lower(trim(c.email)), " + _SOURCE.format(u="c.linkedin") + ", NULL FROM crm_contacts c WHERE trim(c.name) <> '' AND trim(c.email) <> ''),"
    " fetched AS (SELECT DISTINCT " + _SOURCE.format(u="url") + " AS source FROM pdf_pages WHERE markdown IS NOT NULL AND url IS NOT NULL),"
    " held AS (SELECT DISTINCT c.id, c.name, c.value, c.source FROM claim c JOIN part s ON s.source = c.source WHERE contains(lower(s.section), c.value) AND contains(' ' || " + _SPACED.format(t="s.section") + " || ' ', ' ' || " + _SPACED.format(t="c.name") + " || ' ')),"
    " seen AS (SELECT DISTINCT value, source FROM mail WHERE source IS NOT NULL)"
    " SELECT c.id, c.name, c.value, CASE WHEN coalesce(c.source, '') = '' THEN 'no source' WHEN f.source IS NULL THEN 'source not fetched' WHEN d.value IS NOT NULL THEN 'conflicting' WHEN h.id IS NULL THEN 'not bound' WHEN s.value IS NULL THEN 'not observed' ELSE 'accepted' END AS verdict"
    " FROM claim c LEFT JOIN fetched f ON c.source = f.source LEFT JOIN doubt d ON c.value = d.value LEFT JOIN held h ON h.id = c.id AND h.name = c.name AND h.value = c.value AND h.source = c.source LEFT JOIN seen s ON s.value = c.value AND s.source = c.source"
)
def claim_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claimed address of the pages' people and of the known contacts, and what the evidence says of it."""
    pages = table(spark, sf_dir, "pdf_pages")
    mails = page_mails(spark, sf_dir)
    own = people(spark, sf_dir).join(mails.select("page_id", "value"), "page_id").select(F.col("page_id").alias("id"), "name", "value", "source")
    crm = table(spark, sf_dir, "crm_contacts").where("trim(name) <> '' and trim(email) <> ''").select((-F.col("contact_id")).alias("id"), "name", F.lower(F.trim("email")).alias("value"), urls.source_key(F.col("linkedin")).alias("source"))
    all_ = own.unionByName(crm).withColumn("channel", F.lit("email")).withColumn("claim_id", F.concat_ws("|", "id", "name", "value", F.coalesce("source", F.lit(""))))
    quotes = parts(spark, sf_dir).join(pages.select("page_id", urls.source_key(F.col("url")).alias("source")), "page_id").select("source", F.col("section").alias("text"))
    fetched = pages.where("markdown is not null and url is not null").select(urls.source_key(F.col("url")).alias("source"))
    observed = mails.where("source is not null").select(F.lit("email").alias("channel"), "value", "source")
    return claims.validated(all_, observed, signals.conflicts(pages, "url", "contact_conflicts"), fetched, quotes).select("id", "name", "value", "verdict")


_KNOWN = (
    "known AS (SELECT DISTINCT company_id AS scope, channel, key FROM (SELECT company_id, 'name' AS channel, " + _SPACED.format(t="name") + " AS key FROM crm_contacts"
    " UNION ALL SELECT company_id, 'email', lower(trim(email)) FROM crm_contacts UNION ALL SELECT company_id, 'email', lower(unnest(" + FLAT.format(c="additional_emails") + ")) FROM crm_contacts) WHERE key <> '' AND company_id IS NOT NULL)"
)


def known_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, channel, key) of all that the contacts of each firm hold, nested values too."""
    crm = table(spark, sf_dir, "crm_contacts")
    lower = lambda c: F.transform(contacts.flattened(c), lambda x: F.lower(x))
    channels = {"name": F.array(claims.spaced(F.col("name"))), "email": F.concat(F.coalesce(F.array(F.lower(F.trim("email"))), F.array().cast("array<string>")), lower(F.col("additional_emails")))}
    return matching.exploded_keys(crm, F.col("contact_id"), F.col("company_id"), channels).drop("id").distinct()


@query(
    _BOUND + ", " + _KNOWN + ", tagged AS (SELECT b.page_id, b.name, b.value, k.key IS NOT NULL AS old FROM bound b LEFT JOIN known k ON k.scope = b.company_id AND k.channel = 'email' AND k.key = b.value),"
    " who AS (SELECT b.page_id, b.name, max(CASE WHEN k.key IS NULL THEN 0 ELSE 1 END) AS named FROM bound b LEFT JOIN known k ON k.scope = b.company_id AND k.channel = 'name' AND k.key = lower(b.name) GROUP BY 1, 2),"
    " each AS (SELECT t.page_id, t.name, w.named, max(CASE WHEN old THEN 1 ELSE 0 END) AS mailed, count(*) FILTER (NOT old) AS fresh FROM tagged t JOIN who w ON t.page_id = w.page_id AND t.name = w.name GROUP BY 1, 2, 3)"
    " SELECT page_id, name, CASE WHEN mailed = 1 AND named = 1 THEN 'email,name' WHEN mailed = 1 THEN 'email' WHEN named = 1 THEN 'name' ELSE '' END AS matched_by, fresh FROM each WHERE fresh > 0 OR mailed + named = 0"
)
def crm_new_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People against the known contacts: matched addresses stripped, who keeps none is left out, how the rest matched."""
    bound = bound_people(spark, sf_dir).withColumn("id", F.concat_ws("|", "page_id", "name"))
    who = bound.select("id", "page_id", F.col("company_id").alias("scope"), F.lower("name").alias("name"), F.col("name").alias("shown")).distinct()
    kept, fresh = claims.against_known(who, bound.select("id", F.col("company_id").alias("scope"), F.lit("email").alias("channel"), F.col("value").alias("key")), known_keys(spark, sf_dir))
    left = fresh.groupBy("id").agg(F.count("*").alias("fresh"))
    return kept.join(left, "id", "left").select("page_id", F.col("shown").alias("name"), "matched_by", F.coalesce("fresh", F.lit(0)).alias("fresh"))


@query(
    "WITH " + MAILS + ", p AS (SELECT company_id, contact_id, string_split(" + _SPACED.format(t="name") + ", ' ')[-1] AS surname FROM crm_contacts WHERE trim(name) <> '' AND company_id IS NOT NULL),"
    " one AS (SELECT company_id, surname, min(contact_id) AS contact_id FROM p WHERE length(surname) >= 3 GROUP BY 1, 2 HAVING count(DISTINCT contact_id) = 1),"
    " v AS (SELECT company_id, value FROM mail UNION SELECT company_id, lower(trim(email)) FROM crm_contacts WHERE email LIKE '%@%'), m AS (SELECT DISTINCT company_id, value, unnest(regexp_split_to_array(split_part(value, '@', 1), '[^a-z]+')) AS word FROM v)"
    " SELECT o.company_id, o.contact_id, count(DISTINCT m.value) AS guesses FROM one o LEFT JOIN m ON m.company_id = o.company_id AND m.word = o.surname GROUP BY 1, 2"
)
def surname_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts whose surname no other of the firm bears, and how many addresses hold it in their local part: guesses only."""
    crm = table(spark, sf_dir, "crm_contacts").where("company_id is not null")
    bearers = crm.where("trim(name) <> ''").select("company_id", "contact_id", F.element_at(F.split(claims.spaced(F.col("name")), " "), -1).alias("surname")).where("length(surname) >= 3")
    values = page_mails(spark, sf_dir).select("company_id", "value").union(crm.where(F.contains("email", F.lit("@"))).select("company_id", F.lower(F.trim("email")))).distinct()
    mails = values.select("company_id", "value", F.explode(F.split(F.substring_index("value", "@", 1), "[^a-z]+")).alias("surname"))
    joined = claims.sole_owner(bearers, ["company_id", "surname"], "contact_id").join(mails, ["company_id", "surname"], "left")
    return joined.groupBy("company_id", "contact_id").agg(F.countDistinct("value").alias("guesses"))


_TITLE = "trim(regexp_replace(replace(lower(strip_accents(string_split(string_split(title, ' - ')[1], ' | ')[1])), 'ß', 'ss'), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


@query(
    "WITH t AS (SELECT DISTINCT title, string_split(" + _TITLE + ", ' ') AS w FROM search_hits WHERE title IS NOT NULL)"
    " SELECT title, array_to_string(list_transform(w, lambda x: upper(x[1]) || substr(x, 2)), ' ') AS name FROM t WHERE len(w) BETWEEN 2 AND 6 AND len(list_filter(w, lambda x: NOT regexp_matches(x, '^\\p{L}+$'))) = 0"
)
def title_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names at the head of hits' titles."""
    return table(spark, sf_dir, "search_hits").where("title is not null").select("title").distinct().select("title", names.name_from_title(F.col("title")).alias("name")).where("name <> ''")


@query(
    "WITH h AS (SELECT company_id, lower(string_split(title, ' - ')[1]) AS name, " + HIT_KEY.format(u="url") + " AS key FROM search_hits WHERE title IS NOT NULL AND url IS NOT NULL)"
    " SELECT company_id, name, min(key) AS key FROM h GROUP BY company_id, name HAVING count(DISTINCT key) = 1"
)
def sole_page_of_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names at the head of a firm's titles that lead to exactly one page."""
    hits = table(spark, sf_dir, "search_hits").where("title is not null and url is not null").select("company_id", F.lower(F.substring_index("title", " - ", 1)).alias("name"), urls.hit_key(F.col("url"), DOMAIN).alias("key"))
    return claims.sole_owner(hits, ["company_id", "name"], "key")


@query(
    "WITH c AS (SELECT company_id, min(name) AS name FROM companies WHERE trim(name) <> '' GROUP BY company_id), h AS (SELECT h.company_id, h.query, contains(lower(coalesce(h.snippet, '')), lower(c.name)) AS good, h.hit_ord, h.hit_id FROM search_hits h JOIN c ON h.company_id = c.company_id)"
    " SELECT company_id, query, good, hit_ord, hit_id FROM h QUALIFY row_number() OVER (PARTITION BY company_id, query ORDER BY NOT good, hit_ord, hit_id) = 1"
)
def preferred_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each query's hits the first whose snippet names the firm, else the first."""
    firms = table(spark, sf_dir, "companies").where("trim(name) <> ''").groupBy("company_id").agg(F.min("name").alias("name"))
    hits = table(spark, sf_dir, "search_hits").join(firms, "company_id")
    return claims.preferred(hits, ["company_id", "query"], F.contains(F.lower(F.coalesce("snippet", F.lit(""))), F.lower("name")), ["hit_ord", "hit_id"])


@query(
    "WITH h AS (SELECT DISTINCT company_id, " + _SOURCE.format(u="url") + " AS source FROM search_hits WHERE url IS NOT NULL), p AS (SELECT DISTINCT company_id, " + _SOURCE.format(u="url") + " AS source FROM pdf_pages WHERE url IS NOT NULL)"
    " SELECT * FROM h EXCEPT SELECT * FROM p"
)
def evidence_to_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of a firm's hits that its pages don't have yet."""
    of = lambda name: table(spark, sf_dir, name).where("url is not null").select("company_id", urls.source_key(F.col("url")).alias("source")).distinct()
    return of("search_hits").join(of("pdf_pages"), ["company_id", "source"], "left_anti")


@query(
    "WITH h AS (SELECT DISTINCT company_id, " + _SOURCE.format(u="url") + " AS source, " + _SPACED.format(t="concat_ws(' ', title, snippet)") + " AS text FROM search_hits WHERE url IS NOT NULL),"
    " c AS (SELECT DISTINCT company_id, " + _SPACED.format(t="name") + " AS name FROM crm_contacts WHERE trim(name) <> '' UNION SELECT DISTINCT company_id, " + _SPACED.format(t="name") + " FROM companies WHERE trim(name) <> '')"
    " SELECT DISTINCT h.company_id, h.source FROM h JOIN c ON h.company_id = c.company_id WHERE contains(' ' || h.text || ' ', ' ' || c.name || ' ')"
)
def naming_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of hits that name the firm or one of its contacts: a semi join on words."""
    hits = table(spark, sf_dir, "search_hits").where("url is not null").select("company_id", urls.source_key(F.col("url")).alias("source"), claims.spaced(F.concat_ws(" ", "title", "snippet")).alias("text")).distinct()
    of = lambda name: table(spark, sf_dir, name).where("trim(name) <> ''").select("company_id", claims.spaced(F.col("name")).alias("phrase"))
    return matching.mentions(hits, of("crm_contacts").unionByName(of("companies")).distinct(), "company_id", "text", "phrase").select("company_id", "source").distinct()


@query(
    "WITH " + MAILS + ", w AS (SELECT DISTINCT company_id, " + HOST.format(u="website") + " AS site FROM companies WHERE website IS NOT NULL AND website <> '')"
    " SELECT m.page_id, m.value, CASE WHEN max(CASE WHEN w.site = " + HOST.format(u="m.source") + " THEN 1 ELSE 0 END) = 1 THEN 'company_source' WHEN m.source IS NULL THEN 'unknown' ELSE 'published_document' END AS label FROM mail m LEFT JOIN w ON m.company_id = w.company_id GROUP BY m.page_id, m.value, m.source"
)
def signal_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each address was published: on the firm's own site, in another document, or nowhere that is known."""
    sites = table(spark, sf_dir, "companies").where("website is not null and website <> ''").select("company_id", urls.host(F.col("website")).alias("host")).distinct().withColumn("own", F.lit(1))
    mails = page_mails(spark, sf_dir).withColumn("host", urls.host(F.col("source")))
    label = F.when(F.col("own") == 1, "company_source").when(F.col("source").isNull(), "unknown").otherwise("published_document")
    return mails.join(sites, ["company_id", "host"], "left").select("page_id", "value", label.alias("label"))


@query(
    "WITH " + MAILS + r", ph AS (SELECT page_id, company_id, unnest(list_distinct(regexp_extract_all(markdown, '(\+\d[\d ()./-]{6,20}\d)', 1))) AS value FROM pdf_pages WHERE markdown IS NOT NULL),"
    " a AS (SELECT ph.page_id, ph.value, strpos(p.markdown, ph.value) AS at FROM ph JOIN pdf_pages p ON ph.page_id = p.page_id), b AS (SELECT m.page_id, m.value, strpos(lower(p.markdown), m.value) AS at FROM mail m JOIN pdf_pages p ON m.page_id = p.page_id)"
    " SELECT a.page_id, a.value AS phone, b.value AS email, CAST(abs(a.at - b.at) AS BIGINT) AS distance FROM a JOIN b ON a.page_id = b.page_id WHERE a.at > 0 AND b.at > 0 AND abs(a.at - b.at) <= 180"
    " QUALIFY row_number() OVER (PARTITION BY a.page_id, a.value ORDER BY abs(a.at - b.at), b.at, b.value) = 1"
)
def nearest_email_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address nearest to each number within 180 characters, by the places where they first stand."""
    pages = table(spark, sf_dir, "pdf_pages").where("markdown is not null")
    found = F.array_distinct(F.regexp_extract_all("markdown", F.lit(r"(\+\d[\d ()./-]{6,20}\d)"), F.lit(1)))
    phones = pages.select("page_id", "markdown", F.explode(found).alias("value")).select("page_id", "value", F.expr("instr(markdown, value)").alias("at")).where("at > 0")
    mails = page_mails(spark, sf_dir).select("page_id", "value").join(pages.select("page_id", F.lower("markdown").alias("t")), "page_id").select("page_id", "value", F.expr("instr(t, value)").alias("at")).where("at > 0")
    near = claims.nearest_place(phones, mails, ["page_id"], 180)
    return near.select("page_id", F.col("value").alias("phone"), F.col("near").alias("email"), F.col("distance").cast("long").alias("distance"))


#: Words near a contact that tell what it is for.
MARKERS = ["fax", "kontakt", "contact", "order"]


@query(
    "WITH " + MAILS + ", b AS (SELECT m.page_id, m.value, strpos(lower(p.markdown), m.value) AS pos, lower(p.markdown) AS t FROM mail m JOIN pdf_pages p ON m.page_id = p.page_id),"
    " c AS (SELECT page_id, value, substr(t, greatest(1, pos - 600), pos - greatest(1, pos - 600) + length(value) + 600) AS near FROM b WHERE pos > 0)"
    " SELECT page_id, value, " + " || ".join(f"CASE WHEN contains(near, '{m}') THEN ' {m}' ELSE '' END" for m in MARKERS) + " AS marks FROM c WHERE " + " OR ".join(f"contains(near, '{m}')" for m in MARKERS)
)
def marked_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with a marker within 600 characters, and which."""
    pages = table(spark, sf_dir, "pdf_pages").where("markdown is not null").select("page_id", F.lower("markdown").alias("t"))
    near = page_mails(spark, sf_dir).select("page_id", "value").join(pages, "page_id").withColumn("at", F.expr("instr(t, value)")).where("at > 0")
    near = near.withColumn("near", F.expr("substr(t, greatest(1, at - 600), at - greatest(1, at - 600) + length(value) + 600)"))
    hit = lambda m: F.contains("near", F.lit(m))
    marks = F.concat(*[F.when(hit(m), F.lit(f" {m}")).otherwise("") for m in MARKERS])
    return near.select("page_id", "value", marks.alias("marks")).where("marks <> ''")


# ---- what counts, and reports


@query(
    _BOUND + ", " + _KNOWN + ", p AS (SELECT DISTINCT b.company_id, b.page_id || '|' || b.name AS id, lower(b.name) AS name, k.key IS NULL AS new FROM bound b LEFT JOIN known k ON k.scope = b.company_id AND k.channel = 'name' AND k.key = lower(b.name))"
    " SELECT company_id, count(DISTINCT CASE WHEN new THEN name END) AS new_people, count(DISTINCT id) AS items FROM p GROUP BY company_id"
)
def contactable_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each firm: different people with an address that the contacts don't name, and all with an address."""
    bound = bound_people(spark, sf_dir).withColumn("id", F.concat_ws("|", "page_id", "name"))
    named = known_keys(spark, sf_dir).where("channel = 'name'").select(F.col("scope").alias("company_id"), F.col("key").alias("lower"), F.lit("name").alias("by"))
    who = bound.select("id", "company_id", "name", F.lower("name").alias("lower")).distinct().join(named, ["company_id", "lower"], "left")
    who = who.select("id", "company_id", "name", F.lit(True).alias("verified"), F.coalesce("by", F.lit("")).alias("matched_by"))
    return claims.contactable(who, bound.select("id", "value", F.lit("observed").alias("status")), "company_id")


@query("SELECT company_id, count(DISTINCT channel || '|' || full_name) FILTER (channel IS NOT NULL) AS channels, count(DISTINCT lower(trim(full_name))) FILTER (trim(full_name) <> '') AS people, count(*) FILTER (kind IS NULL) AS unknown FROM crm_duplicates GROUP BY company_id")
def duplicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each firm: different channel values, different people, findings without a kind."""
    dup = table(spark, sf_dir, "crm_duplicates")
    return dup.groupBy("company_id").agg(
        F.countDistinct(F.when(F.col("channel").isNotNull(), F.concat("channel", F.lit("|"), "full_name"))).alias("channels"),
        F.countDistinct(F.when(F.trim("full_name") != "", F.lower(F.trim("full_name")))).alias("people"),
        F.count_if(F.col("kind").isNull()).alias("unknown"),
    )


@query(
    "WITH v AS (SELECT company_id, 'email' AS channel, lower(trim(email)) AS value FROM crm_contacts UNION SELECT company_id, 'phone', regexp_replace(regexp_replace(phone, '\\D', '', 'g'), '^00', '') FROM crm_contacts"
    " UNION SELECT company_id, 'whatsapp', regexp_replace(regexp_replace(phone, '\\D', '', 'g'), '^00', '') FROM crm_contacts WHERE starts_with(trim(phone), '+'))"
    " SELECT company_id, count(*) AS methods FROM v WHERE value <> '' GROUP BY company_id"
)
def methods_with_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different ways to reach a firm's contacts; a number that also chats (here: an international one) counts twice."""
    digits = contacts.phone_digits(F.col("phone"))
    per = [F.struct(F.lit("email").alias("channel"), F.lower(F.trim("email")).alias("value")), F.struct(F.lit("phone").alias("channel"), digits.alias("value")), F.struct(F.lit("whatsapp").alias("channel"), F.when(F.startswith(F.trim("phone"), F.lit("+")), digits).alias("value"))]
    each = table(spark, sf_dir, "crm_contacts").select("company_id", F.explode(F.array(*per)).alias("x")).select("company_id", "x.*").where("value <> ''")
    return reports.methods(each, "company_id")


@query(
    "WITH h AS (SELECT DISTINCT company_id, query, " + HIT_KEY.format(u="url") + " AS key, unnest(CASE WHEN len(engines) > 0 THEN engines ELSE ['unattributed'] END) AS engine, coalesce(source_type, 'none') AS kind FROM search_hits WHERE url IS NOT NULL)"
    " SELECT engine, kind, count(*) AS hits, count(DISTINCT key) AS urls, count(DISTINCT company_id) AS firms FROM h GROUP BY engine, kind"
)
def engine_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kinds of sources each engine found, in hits, pages and firms."""
    engines = F.when(F.size(F.coalesce("engines", F.array().cast("array<string>"))) > 0, F.col("engines")).otherwise(F.array(F.lit("unattributed")))
    hits = table(spark, sf_dir, "search_hits").where("url is not null").select("company_id", "query", urls.hit_key(F.col("url"), DOMAIN).alias("key"), F.explode(engines).alias("engine"), F.coalesce("source_type", F.lit("none")).alias("kind")).distinct()
    return hits.groupBy("engine", "kind").agg(F.count("*").alias("hits"), F.countDistinct("key").alias("urls"), F.countDistinct("company_id").alias("firms"))


@query("SELECT company_id, query, CAST(count(*) FILTER (url IS NULL OR NOT regexp_matches(url, '(?i)^https?://')) AS BIGINT) AS rejected, count(*) FILTER (snippet IS NULL) AS unsaid, count(*) AS hits FROM search_hits GROUP BY company_id, query")
def triage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each query, those without a web address and those without a snippet."""
    hits = table(spark, sf_dir, "search_hits")
    return hits.groupBy("company_id", "query").agg(F.count_if(F.col("url").isNull() | ~F.col("url").rlike("(?i)^https?://")).alias("rejected"), F.count_if(F.col("snippet").isNull()).alias("unsaid"), F.count("*").alias("hits"))


@query(
    "SELECT c.company_id, count(DISTINCT p.page_id) AS pages, (SELECT count(*) FROM search_hits h WHERE h.company_id = c.company_id) AS hits, (SELECT count(*) FROM crm_contacts k WHERE k.company_id = c.company_id) AS contacts,"
    " (SELECT count(DISTINCT id) FROM jobs j WHERE j.company_id = c.company_id) AS jobs, (SELECT count(*) FROM crm_duplicates d WHERE d.company_id = c.company_id) AS duplicates FROM (SELECT DISTINCT company_id FROM companies) c LEFT JOIN pdf_pages p ON p.company_id = c.company_id GROUP BY c.company_id"
)
def firm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What there is on each firm; every table is aggregated before it is joined."""
    out = table(spark, sf_dir, "companies").select("company_id").distinct()
    for name, source, count in (("pages", "pdf_pages", F.count("*")), ("hits", "search_hits", F.count("*")), ("contacts", "crm_contacts", F.count("*")), ("jobs", "jobs", F.countDistinct("id")), ("duplicates", "crm_duplicates", F.count("*"))):
        out = out.join(table(spark, sf_dir, source).groupBy("company_id").agg(count.alias(name)), "company_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


@query("SELECT coalesce(batch_id, '-') AS batch, count(DISTINCT id) FILTER (status IN ('queued', 'running')) AS active, bool_and(status <> 'running' OR stage = 'search') AS all_searching FROM jobs GROUP BY 1")
def active_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active jobs of each batch, and whether all that run are at one stage."""
    jobs = table(spark, sf_dir, "jobs")
    return jobs.groupBy(F.coalesce("batch_id", F.lit("-")).alias("batch")).agg(F.countDistinct(F.when(F.col("status").isin("queued", "running"), F.col("id"))).alias("active"), F.bool_and((F.col("status") != "running") | (F.col("stage") == "search")).alias("all_searching"))


@query("SELECT contact_id, greatest(0, coalesce(try_cast(regexp_extract(phone, '(\\d+)$', 1) AS INTEGER), 0)) AS n FROM crm_contacts WHERE phone IS NOT NULL")
def coerced_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count out of any text: what is no number of the type, or below 0, is 0."""
    return table(spark, sf_dir, "crm_contacts").where("phone is not null").select("contact_id", F.greatest(F.lit(0), F.coalesce(F.regexp_extract("phone", r"(\d+)$", 1).try_cast("int"), F.lit(0))).alias("n"))


@query(_BOUND + " SELECT DISTINCT company_id, value FROM bound")
def assigned_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that belong to people of the firm."""
    return bound_people(spark, sf_dir).select("company_id", "value").distinct()


@query(
    _BOUND + ", doubt AS (SELECT DISTINCT lower(trim(v)) AS value FROM (SELECT unnest(q.c.\"values\") AS v FROM (SELECT unnest(contact_conflicts) AS c FROM pdf_pages) q))"
    " SELECT DISTINCT m.company_id, m.value FROM mail m WHERE m.company_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bound b WHERE b.company_id = m.company_id AND b.value = m.value) AND NOT EXISTS (SELECT 1 FROM doubt d WHERE d.value = m.value)"
)
def unassigned_to_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed addresses of a firm that belong to none of its people and are not in doubt: two anti joins."""
    doubt = signals.conflicts(table(spark, sf_dir, "pdf_pages"), "url", "contact_conflicts").select("value").distinct()
    seen = page_mails(spark, sf_dir).where("company_id is not null").select("company_id", "value").distinct()
    return seen.join(assigned_values(spark, sf_dir), ["company_id", "value"], "left_anti").join(doubt, "value", "left_anti").select("company_id", "value")


# ---- sets, orders and budgets


@query(
    "WITH h AS (SELECT hit_id, company_id, query, CASE provider WHEN 'metasearch' THEN 0 WHEN 'listsearch' THEN 1 ELSE 2 END AS r, snippet IS NOT NULL AS eligible, hit_ord FROM search_hits), e AS (SELECT company_id, query, min(r) AS r FROM h WHERE eligible GROUP BY 1, 2)"
    " SELECT hit_id, 'eligible' AS status FROM h JOIN e ON h.company_id = e.company_id AND h.query IS NOT DISTINCT FROM e.query AND h.r = e.r WHERE eligible"
    " UNION ALL SELECT hit_id, 'pending' FROM (SELECT h.*, row_number() OVER (PARTITION BY h.company_id, h.query ORDER BY r, hit_ord, hit_id) AS n FROM h WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.company_id = h.company_id AND e.query IS NOT DISTINCT FROM h.query)) WHERE n <= 5"
)
def fallback_with_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first provider with eligible hits (here: with a snippet); where none has any, five of all providers' others."""
    rank = F.when(F.col("provider") == "metasearch", 0).when(F.col("provider") == "listsearch", 1).otherwise(2)
    hits = table(spark, sf_dir, "search_hits").select("hit_id", "company_id", F.struct("query").alias("q"), rank.alias("r"), F.col("snippet").isNotNull().alias("eligible"), "hit_ord")
    good = ordered.fallback(hits.where("eligible"), ["company_id", "q"], "r").select("hit_id", F.lit("eligible").alias("status"))
    rest = hits.join(hits.where("eligible").select("company_id", "q").distinct(), ["company_id", "q"], "left_anti")
    pending = rest.withColumn("n", F.row_number().over(Window.partitionBy("company_id", "q").orderBy("r", "hit_ord", "hit_id"))).where("n <= 5")
    return good.unionByName(pending.select("hit_id", F.lit("pending").alias("status")))


@query(
    "WITH a AS (SELECT company_id, 1 AS branch, page_id AS ord, " + _SOURCE.format(u="url") + " AS source FROM pdf_pages WHERE trim(markdown) <> '' AND url IS NOT NULL UNION ALL SELECT company_id, 2, hit_id, " + _SOURCE.format(u="url") + " FROM search_hits WHERE snippet IS NOT NULL AND url IS NOT NULL)"
    " SELECT company_id, source, branch, ord FROM a QUALIFY row_number() OVER (PARTITION BY company_id, source ORDER BY branch, ord) = 1"
)
def evidence_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, then excerpts of hits, each source once: pages and excerpts become one table of evidence."""
    pages = table(spark, sf_dir, "pdf_pages").where("trim(markdown) <> '' and url is not null").select("company_id", F.lit(1).alias("branch"), F.col("page_id").alias("ord"), urls.source_key(F.col("url")).alias("source"))
    hits = table(spark, sf_dir, "search_hits").where("snippet is not null and url is not null").select("company_id", F.lit(2).alias("branch"), F.col("hit_id").alias("ord"), urls.source_key(F.col("url")).alias("source"))
    return ordered.first_by(pages.unionByName(hits), ["company_id", "source"], ["branch", "ord"], []).select("company_id", "source", "branch", "ord")


#: Words of trade in a title or snippet.
TRADE = ["import", "export", "shipment", "customs", "supplier"]
_TRADE_TEXT = "lower(concat_ws(' ', h.title, h.snippet))"


@query(
    "WITH c AS (SELECT company_id, min(name) AS name, first(products ORDER BY updated_at) AS products FROM companies WHERE trim(name) <> '' GROUP BY company_id),"
    " l AS (SELECT h.company_id, " + _SOURCE.format(u="h.url") + " AS source, h.hit_id FROM search_hits h JOIN c ON h.company_id = c.company_id WHERE h.url IS NOT NULL AND contains(" + _TRADE_TEXT + ", lower(c.name)) AND (" + " OR ".join(f"contains({_TRADE_TEXT}, '{t}')" for t in TRADE) + " OR h.source_type = 'directory'))"
    " SELECT company_id, source, min(hit_id) AS first_hit FROM l GROUP BY company_id, source"
)
def trade_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits that name the firm and speak of trade, or stand in a directory; the first of each source."""
    firms = table(spark, sf_dir, "companies").where("trim(name) <> ''").groupBy("company_id").agg(F.min("name").alias("name"))
    text = F.lower(F.concat_ws(" ", "title", "snippet"))
    hits = table(spark, sf_dir, "search_hits").where("url is not null").join(firms, "company_id").where(F.contains(text, F.lower("name")) & (F.exists(F.array(*map(F.lit, TRADE)), lambda t: F.contains(text, t)) | (F.col("source_type") == "directory")))
    return ordered.first_by(hits.withColumn("source", urls.source_key(F.col("url"))), ["company_id", "source"], ["hit_id"], []).select("company_id", "source", F.col("hit_id").alias("first_hit"))


@query("SELECT DISTINCT company_id, query FROM search_hits WHERE coalesce(len(engines), 0) = 0 EXCEPT SELECT company_id, query FROM search_hits WHERE len(engines) > 0 AND snippet IS NOT NULL AND rank <= 2")
def queries_unattributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with hits of no engine, less those with a good hit of a named one: a difference of sets."""
    hits = table(spark, sf_dir, "search_hits")
    none = hits.where("coalesce(size(engines), 0) <= 0").select("company_id", "query")
    return none.subtract(hits.where("size(engines) > 0 and snippet is not null and rank <= 2").select("company_id", "query"))


@query(
    "WITH a AS (SELECT DISTINCT company_id, string_split(" + _SPACED.format(t="name") + ", ' ') AS w FROM companies WHERE trim(name) <> ''), b AS (SELECT DISTINCT company_id, company_name, string_split(" + _SPACED.format(t="company_name") + ", ' ') AS v FROM jobs WHERE trim(company_name) <> '' AND company_id IS NOT NULL)"
    " SELECT b.company_id, b.company_name, CAST(max(len(list_distinct(list_intersect(v, w)))) AS INTEGER) AS shared FROM b JOIN a ON a.company_id = b.company_id WHERE list_has_any(v, w) GROUP BY 1, 2"
)
def shared_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a firm in the ledger that share words with its names, and how many."""
    words = lambda c: F.split(claims.spaced(c), " ")
    a = table(spark, sf_dir, "companies").where("trim(name) <> ''").select("company_id", words(F.col("name")).alias("w")).distinct()
    b = table(spark, sf_dir, "jobs").where("trim(company_name) <> '' and company_id is not null").select("company_id", "company_name", words(F.col("company_name")).alias("v")).distinct()
    return b.join(a, "company_id").where(F.arrays_overlap("v", "w")).groupBy("company_id", "company_name").agg(F.max(F.size(F.array_intersect("v", "w"))).alias("shared"))


_SCOPE = HOST.format(u="c.website") + " <> '' AND (" + HOST.format(u="h.url") + " = " + HOST.format(u="c.website") + " OR ends_with(" + HOST.format(u="h.url") + ", '.' || " + HOST.format(u="c.website") + "))"
_ROOT = "regexp_replace(" + PATH.format(u="c.website") + ", '(?i)/index\\.(html?|php|aspx?)$', '')"
_BELOW = "(" + _ROOT + " = '' OR " + PATH.format(u="h.url") + " = " + _ROOT + " OR starts_with(" + PATH.format(u="h.url") + ", " + _ROOT + " || '/'))"


@query("WITH c AS (SELECT DISTINCT company_id, website FROM companies WHERE website <> '') SELECT DISTINCT h.hit_id FROM search_hits h JOIN c ON h.company_id = c.company_id WHERE h.url IS NOT NULL AND " + _SCOPE + " AND " + _BELOW)
def hits_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits on the firm's own site, below its own path."""
    firms = table(spark, sf_dir, "companies").where("website <> ''").select("company_id", "website").distinct()
    hits = table(spark, sf_dir, "search_hits").where("url is not null").select("hit_id", "company_id", "url").join(firms, "company_id")
    return hits.where(urls.official_scope(F.col("website"), F.col("url"))).select("hit_id").distinct()


_TERMS = lambda ts: "(" + " OR ".join(f"contains(v, '{t}')" for t in ts) + ")"


@query(
    "WITH c AS (SELECT company_id, min(website) AS website FROM companies WHERE website <> '' GROUP BY company_id), h AS (SELECT h.company_id, h.url, min(h.hit_id) AS ord, lower(" + PATH.format(u="h.url") + ") AS v, c.website FROM search_hits h JOIN c ON h.company_id = c.company_id WHERE " + _SCOPE + " AND " + _BELOW + " GROUP BY h.company_id, h.url, c.website),"
    " p AS (SELECT *, CASE WHEN " + _TERMS(urls.FORM_TERMS) + " THEN 3 WHEN " + _TERMS(urls.CONTACT_TERMS) + " THEN 0 WHEN " + _TERMS(urls.OFFICIAL_TERMS) + " THEN 1 ELSE 2 END AS priority FROM h)"
    " SELECT company_id, url, priority, CAST(row_number() OVER (PARTITION BY company_id ORDER BY url <> website, priority, ord) AS INTEGER) AS place FROM p QUALIFY place <= 12"
)
def official_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of a firm's own site to fetch: its address, then contact pages, at most twelve (the budget is the feature)."""
    firms = table(spark, sf_dir, "companies").where("website <> ''").groupBy("company_id").agg(F.min("website").alias("website"))
    hits = table(spark, sf_dir, "search_hits").select("company_id", "url", "hit_id").join(firms, "company_id").where(urls.official_scope(F.col("website"), F.col("url")))
    once = hits.groupBy("company_id", "url", "website").agg(F.min("hit_id").alias("ord")).withColumn("priority", urls.link_priority(F.col("url"), F.lit("")))
    place = F.row_number().over(Window.partitionBy("company_id").orderBy(F.col("url") != F.col("website"), "priority", "ord"))
    return once.withColumn("place", place).where("place <= 12").select("company_id", "url", "priority", "place")


@query(
    "WITH h AS (SELECT company_id, " + HIT_KEY.format(u="url") + " AS key, min(rank) AS rank, min(hit_id) AS hit_id FROM search_hits WHERE url IS NOT NULL AND rank IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY rank, hit_id) AS n FROM h)"
    " SELECT company_id, key, CASE WHEN n <= 14 THEN 1 ELSE 2 END AS wave FROM r WHERE n <= 20"
)
def crawl_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty pages of each firm in two waves, six of them kept for what the first wave leads to (the budget is the feature)."""
    hits = table(spark, sf_dir, "search_hits").where("url is not null and rank is not null").groupBy("company_id", urls.hit_key(F.col("url"), DOMAIN).alias("key")).agg(F.min("rank").alias("rank"), F.min("hit_id").alias("hit_id"))
    return claims.waves(hits, ["company_id"], ["rank", "hit_id"], 14, 6).select("company_id", "key", "wave")


@query(
    "WITH h AS (SELECT company_id, hit_id, lower(url) AS u, " + HOST.format(u="url") + " AS host FROM search_hits WHERE url IS NOT NULL), w AS (SELECT company_id, min(" + HOST.format(u="website") + ") AS site FROM companies WHERE website <> '' GROUP BY company_id)"
    " SELECT h.company_id, h.hit_id, CASE WHEN h.host = w.site AND h.host <> '' THEN 0 WHEN contains(h.u, '/press') OR contains(h.u, '/news') THEN 1 ELSE 2 END AS tier FROM h LEFT JOIN w ON h.company_id = w.company_id QUALIFY row_number() OVER (PARTITION BY h.company_id ORDER BY tier, h.hit_id) <= 6"
)
def topup_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six more pages of each firm: of its own site first, then press and news, then others (the budget is the feature)."""
    sites = table(spark, sf_dir, "companies").where("website <> ''").groupBy("company_id").agg(F.min(urls.host(F.col("website"))).alias("site"))
    hits = table(spark, sf_dir, "search_hits").where("url is not null").select("company_id", "hit_id", F.lower("url").alias("u"), urls.host(F.col("url")).alias("host")).join(sites, "company_id", "left")
    tier = F.when((F.col("host") == F.col("site")) & (F.col("host") != ""), 0).when(F.contains("u", F.lit("/press")) | F.contains("u", F.lit("/news")), 1).otherwise(2)
    ranked = hits.withColumn("tier", tier).withColumn("n", F.row_number().over(Window.partitionBy("company_id").orderBy("tier", "hit_id")))
    return ranked.where("n <= 6").select("company_id", "hit_id", "tier")


# ---- addresses and names


@query(
    "WITH u AS (SELECT DISTINCT linkedin AS url FROM crm_contacts WHERE linkedin IS NOT NULL UNION SELECT DISTINCT url FROM search_hits WHERE url IS NOT NULL), p AS (SELECT url, " + HOST.format(u="url") + " AS host, list_filter(string_split(lower(" + PATH.format(u="url") + "), '/'), lambda p: p <> '') AS parts FROM u)"
    " SELECT url, CASE WHEN (host = 'linkedin.example' OR host LIKE '%.linkedin.example') AND parts[1] = 'in' THEN 'person' WHEN (host = 'linkedin.example' OR host LIKE '%.linkedin.example') AND parts[1] = 'company' THEN 'company' WHEN parts[-1] LIKE '%.pdf' THEN 'pdf' ELSE '' END AS kind FROM p"
)
def profile_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an address leads to: a person's or a firm's profile, or a file."""
    of = lambda name, c: table(spark, sf_dir, name).where(F.col(c).isNotNull()).select(F.col(c).alias("url"))
    return of("crm_contacts", "linkedin").union(of("search_hits", "url")).distinct().select("url", urls.profile_kind(F.col("url"), DOMAIN).alias("kind"))


@query("WITH c AS (SELECT DISTINCT company_id, string_split(" + _SPACED.format(t="name") + ", ' ') AS w FROM companies WHERE trim(name) <> '') SELECT DISTINCT h.hit_id FROM search_hits h JOIN c ON h.company_id = c.company_id WHERE len(list_filter(c.w, lambda x: length(x) >= 3 AND contains(regexp_replace(" + HOST.format(u="h.url") + ", '[^a-z0-9]', '', 'g'), x))) > 0")
def distinctive_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits whose host holds a word of the firm's name."""
    firms = table(spark, sf_dir, "companies").where("trim(name) <> ''").select("company_id", F.split(claims.spaced(F.col("name")), " ").alias("w")).distinct()
    hits = table(spark, sf_dir, "search_hits").where("url is not null").select("hit_id", "company_id", "url").join(firms, "company_id")
    return hits.where(urls.distinctive(F.col("w"), F.col("url"), whole=False)).select("hit_id").distinct()


@query(r"SELECT DISTINCT website, CASE WHEN trim(website) = '' THEN '' WHEN regexp_matches(x, '(?i)^https?://([^/?#@]*@)?[^/?#:@\s]') THEN x ELSE '' END AS normalised FROM (SELECT website, CASE WHEN contains(website, '://') THEN trim(website) ELSE 'https://' || trim(website) END AS x FROM companies WHERE website IS NOT NULL)")
def website_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "companies").where("website is not null").select("website").distinct().select("website", urls.website(F.col("website")).alias("normalised"))


@query("WITH r AS (SELECT DISTINCT phone_region AS region FROM jobs UNION SELECT * FROM (VALUES ('ru'), ('CN'), ('KR')) v(region)) SELECT region, CASE upper(trim(region)) WHEN 'CN' THEN 'google cse,baidu' WHEN 'KR' THEN 'google cse,naver' WHEN 'BY' THEN 'google cse,yandex' WHEN 'RU' THEN 'google cse,yandex' WHEN 'KZ' THEN 'google cse,yandex' WHEN 'KG' THEN 'google cse,yandex' WHEN 'UZ' THEN 'google cse,yandex' ELSE '' END AS engines FROM r")
def region_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engines for each region of the ledger, and for three more."""
    regions = table(spark, sf_dir, "jobs").select(F.col("phone_region").alias("region")).union(spark.createDataFrame([("ru",), ("CN",), ("KR",)], "region string")).distinct()
    return regions.select("region", F.array_join(profiles.engines_of(F.col("region")), ",").alias("engines"))


@query("SELECT DISTINCT company_id, '\"' || trim(name) || '\" official website' AS query FROM companies WHERE trim(name) <> ''")
def official_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "companies").where("trim(name) <> ''").select("company_id", F.concat(F.lit('"'), F.trim("name"), F.lit('" official website')).alias("query")).distinct()


@query(
    "WITH p AS (SELECT DISTINCT d.company_id, trim(d.full_name) AS person FROM crm_duplicates d WHERE trim(d.full_name) <> '' AND d.kind = 'unverified_candidate'), c AS (SELECT company_id, min(trim(name)) AS name FROM companies WHERE trim(name) <> '' GROUP BY company_id)"
    " SELECT p.company_id, '\"' || p.person || '\" \"' || c.name || '\" (email OR phone OR contact)' AS query FROM p JOIN c ON p.company_id = c.company_id"
)
def people_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for each person of a firm without a channel."""
    firms = table(spark, sf_dir, "companies").where("trim(name) <> ''").groupBy("company_id").agg(F.min(F.trim("name")).alias("name"))
    open_ = table(spark, sf_dir, "crm_duplicates").where("trim(full_name) <> '' and kind = 'unverified_candidate'").select("company_id", F.trim("full_name").alias("person")).distinct()
    return open_.join(firms, "company_id").select("company_id", F.concat(F.lit('"'), "person", F.lit('" "'), "name", F.lit('" (email OR phone OR contact)')).alias("query"))


# ---- input and ledger


@query(
    "SELECT company_id, name, CASE WHEN name IS NULL OR trim(name) = '' THEN 'blank name' WHEN crm_contact_count < 0 THEN 'negative contact count' WHEN target_contact_count < 0 THEN 'negative target' WHEN customs_search_enabled IS NULL THEN 'no flag' ELSE '' END AS reason FROM companies"
)
def input_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a firm's record can't be taken; empty where it can."""
    return table(spark, sf_dir, "companies").select("company_id", "name", reject_reason().alias("reason"))


@query(
    "WITH a AS (SELECT DISTINCT company_id FROM jobs WHERE status IN ('queued', 'running') AND company_id IS NOT NULL), c AS (SELECT company_id, min(coalesce(crm_contact_count, 0)) AS n FROM companies GROUP BY company_id)"
    " SELECT c.company_id, CASE WHEN n < 4 THEN 4 ELSE 1 END AS target FROM c WHERE company_id NOT IN (SELECT company_id FROM a)"
)
def jobs_to_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firms without an active job, and how many contacts a new one should look for."""
    firms = table(spark, sf_dir, "companies").groupBy("company_id").agg(F.min(F.coalesce("crm_contact_count", F.lit(0))).alias("n"))
    active = table(spark, sf_dir, "jobs").where("status in ('queued', 'running') and company_id is not null").select("company_id")
    return absent_only(firms, active, ["company_id"], ["n"]).select("company_id", F.when(F.col("n") < 4, 4).otherwise(1).alias("target"))


@query("WITH j AS (SELECT DISTINCT id, run, status FROM jobs) SELECT DISTINCT run FROM j WHERE run IS NOT NULL AND run NOT IN (SELECT run FROM j WHERE status = 'completed' AND run IS NOT NULL)")
def runs_not_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs none of whose jobs is completed: their outputs are left out of results."""
    jobs = table(spark, sf_dir, "jobs").where("run is not null")
    return jobs.select("run").distinct().join(jobs.where("status = 'completed'").select("run"), "run", "left_anti")


_AS_OF = "TIMESTAMP '2026-07-01 00:00:00'"


@query(
    "WITH b AS (SELECT batch_id, min(started_at) AS began, max(heartbeat_at) AS seen FROM jobs WHERE batch_id IS NOT NULL GROUP BY batch_id)"
    " SELECT batch_id, CAST(greatest(0, 172800 - coalesce(date_diff('second', began, seen), 0)) AS BIGINT) AS remaining, CAST(greatest(0, coalesce(date_diff('second', seen, " + _AS_OF + "), 0)) AS BIGINT) AS age, CASE WHEN seen IS NULL OR date_diff('second', seen, " + _AS_OF + ") > 10 THEN 'paused' ELSE 'running' END AS stage FROM b"
)
def batch_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of a batch: seconds left of two days, age of its last sign, and 'paused' if that is over ten seconds."""
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    batches = table(spark, sf_dir, "jobs").where("batch_id is not null").groupBy("batch_id").agg(F.min("started_at").alias("began"), F.max("heartbeat_at").alias("seen"))
    age = F.unix_timestamp(F.lit("2026-07-01 00:00:00").cast("timestamp")) - seconds("seen")
    left = F.greatest(F.lit(0).cast("long"), 172800 - F.coalesce(seconds("seen") - seconds("began"), F.lit(0)))
    return batches.select("batch_id", left.alias("remaining"), F.greatest(F.lit(0).cast("long"), F.coalesce(age, F.lit(0))).alias("age"), F.when(age.isNull() | (age > 10), "paused").otherwise("running").alias("stage"))


@query(
    "WITH r AS (SELECT event_id, user_id, ts, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),"
    " s AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS failures FROM r), f AS (SELECT user_id, min(CASE WHEN failures >= 2 THEN epoch_us(ts) END) AS stopped FROM s GROUP BY user_id)"
    " SELECT s.user_id, CAST(f.stopped AS BIGINT) AS stopped_us, count(*) FILTER (epoch_us(s.ts) > f.stopped) AS skipped, bool_and(f.stopped IS NOT NULL) AS suspended FROM s JOIN f ON s.user_id = f.user_id GROUP BY s.user_id, f.stopped"
)
def engine_suspensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A breaker over each user's requests: suspended at the second failure since the last success, and what that skips."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    stopped = ordered.breaker(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "purchase", 2, "ts")
    micros = F.expr("unix_micros(cast(ts as timestamp))")
    joined = events.join(stopped, "user_id").withColumn("us", F.expr("unix_micros(cast(stopped as timestamp))"))
    return joined.groupBy("user_id", F.col("us").alias("stopped_us")).agg(F.count_if(micros > F.col("us")).alias("skipped")).withColumn("suspended", F.col("stopped_us").isNotNull())


@query(
    r"WITH l AS (SELECT page_id, company_id, markdown, regexp_replace(markdown, '(^|[^!])\[[^\[\]\n]*\]\([^)\s]+\)', '\1', 'g') AS bare FROM pdf_pages WHERE markdown IS NOT NULL), c AS (SELECT company_id, min(" + _SPACED.format(t="name") + ") AS name FROM companies WHERE trim(name) <> '' GROUP BY company_id),"
    " m AS (SELECT l.page_id, contains(' ' || " + _SPACED.format(t="markdown") + " || ' ', ' ' || c.name || ' ') AS anywhere, contains(' ' || " + _SPACED.format(t="bare") + " || ' ', ' ' || c.name || ' ') AS outside FROM l JOIN c ON l.company_id = c.company_id WHERE c.name <> '') SELECT page_id, outside FROM m WHERE anywhere"
)
def mentions_outside_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that name their firm, and whether they do so outside links."""
    firms = table(spark, sf_dir, "companies").where("trim(name) <> ''").groupBy("company_id").agg(F.min(claims.spaced(F.col("name"))).alias("name")).where("name <> ''")
    pages = table(spark, sf_dir, "pdf_pages").where("markdown is not null").select("page_id", "company_id", "markdown").join(firms, "company_id")
    bare: Column = F.regexp_replace("markdown", r"(^|[^!])\[[^\[\]\n]*\]\([^)\s]+\)", "$1")
    named = lambda text: names.contains_phrase(claims.spaced(text), F.col("name"))
    return pages.where(named(F.col("markdown"))).select("page_id", named(bare).alias("outside"))


@query("SELECT page_id, trim(coalesce(markdown, '')) <> '' OR len(links) > 0 AS usable FROM pdf_pages")
def usable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page has anything to work on."""
    return table(spark, sf_dir, "pdf_pages").select("page_id", ((F.trim(F.coalesce("markdown", F.lit(""))) != "") | (F.coalesce(F.size("links"), F.lit(0)) > 0)).alias("usable"))


@query(
    "WITH p AS (SELECT page_id, company_id, " + HOST.format(u="requested_url") + " AS asked, " + HOST.format(u="url") + " AS got, " + _SPACED.format(t="regexp_extract(markdown, '(?m)^#+ *([^\\n]+)', 1)") + " AS heading FROM pdf_pages WHERE url IS NOT NULL), c AS (SELECT company_id, min(" + _SPACED.format(t="name") + ") AS name FROM companies WHERE trim(name) <> '' GROUP BY company_id)"
    " SELECT p.page_id, CASE WHEN asked IS NULL OR asked = '' OR asked = got THEN 'unchanged' WHEN contains(' ' || heading || ' ', ' ' || c.name || ' ') THEN 'confirmed_redirect' ELSE 'unverified_redirect' END AS state FROM p LEFT JOIN c ON p.company_id = c.company_id"
)
def site_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page came from the host that was asked, from another whose first heading names the firm, or from any other."""
    firms = table(spark, sf_dir, "companies").where("trim(name) <> ''").groupBy("company_id").agg(F.min(claims.spaced(F.col("name"))).alias("name"))
    pages = table(spark, sf_dir, "pdf_pages").where("url is not null").join(firms, "company_id", "left")
    asked, got = urls.host(F.col("requested_url")), urls.host(F.col("url"))
    heading = claims.spaced(F.regexp_extract("markdown", r"(?m)^#+ *([^\n]+)", 1))
    state = F.when(asked.isNull() | (asked == "") | (asked == got), "unchanged").when(names.contains_phrase(heading, F.col("name")), "confirmed_redirect").otherwise("unverified_redirect")
    return pages.select("page_id", state.alias("state"))
