"""More queries over the project's tables: attempts, binding, merging, near values, planning; registered in the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import contacts, profiles, urls
from ..operators import matching, ordered, reports, signals
from ..runtime import table
from .catalog import DOMAIN, HIT_KEY, HOST, MAILS, PAGE_KEY, PATH, PROFILE_KEY, page_mails, query

_MAIL = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"


@query(
    "WITH p AS (SELECT page_id, " + PAGE_KEY.format(u="coalesce(requested_url, url)") + """ AS key, CASE WHEN coalesce(error, '') = '' AND coalesce(trim(markdown), '') <> '' THEN 0 ELSE 1 END AS failed, fetched_at FROM pdf_pages WHERE coalesce(requested_url, url) IS NOT NULL)
SELECT key, failed, page_id FROM p QUALIFY row_number() OVER (PARTITION BY key ORDER BY failed, fetched_at, page_id) = 1"""
)
def attempt_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several fetches of one address the first that worked, or else the first; keyed by the address asked for."""
    failed = F.when((F.coalesce("error", F.lit("")) == "") & (F.coalesce(F.trim("markdown"), F.lit("")) != ""), 0).otherwise(1)
    tries = table(spark, sf_dir, "pdf_pages").select(urls.page_key(F.coalesce("requested_url", "url")).alias("key"), failed.alias("failed"), "fetched_at", "page_id").where("key is not null")
    return ordered.first_by(tries, ["key"], ["failed", "fetched_at", "page_id"], []).select("key", "failed", "page_id")


@query(
    r"""WITH l AS (SELECT page_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS n FROM pdf_pages WHERE markdown IS NOT NULL),
t AS (SELECT page_id, n, line FROM l WHERE regexp_matches(line, '(?i)\bTel\.? ?[+(0-9]')), e AS (SELECT page_id, n AS m, lower(unnest(list_distinct(regexp_extract_all(line, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')))) AS email FROM l)
SELECT t.page_id, CAST(t.n AS BIGINT) AS line_no, e.email, CAST(abs(t.n - e.m) AS BIGINT) AS distance FROM t JOIN e ON t.page_id = e.page_id AND abs(t.n - e.m) <= 3
QUALIFY row_number() OVER (PARTITION BY t.page_id, t.n ORDER BY abs(t.n - e.m), e.m, e.email) = 1"""
)
def nearest_email_to_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address nearest to each line with a telephone number, within three lines of the same page."""
    lines = table(spark, sf_dir, "pdf_pages").where("markdown is not null").select("page_id", F.posexplode(F.split("markdown", "\n")).alias("pos", "line")).withColumn("n", (F.col("pos") + 1).cast("long"))
    phones = lines.where(F.col("line").rlike(r"(?i)\bTel\.? ?[+(0-9]")).select("page_id", "n")
    mails = lines.where(F.contains("line", F.lit("@"))).select("page_id", F.col("n").alias("m"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(_MAIL), F.lit(1)))).alias("email")).withColumn("email", F.lower("email"))
    return matching.nearest(phones, mails, ["page_id"], "n", "m", 3, "email").select("page_id", F.col("n").alias("line_no"), "email", "distance")


@query("WITH " + MAILS + r""", c AS (SELECT DISTINCT company_id, lower(trim(email)) AS value FROM crm_contacts WHERE email IS NOT NULL), x AS (SELECT DISTINCT lower(trim(v)) AS value FROM (SELECT unnest(q.c."values") AS v FROM (SELECT unnest(contact_conflicts) AS c FROM pdf_pages) q))
SELECT DISTINCT m.company_id, m.value FROM mail m WHERE m.company_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c.company_id = m.company_id AND c.value = m.value) AND NOT EXISTS (SELECT 1 FROM x WHERE x.value = m.value)""")
def unassigned_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed addresses less those the firm's contacts have, less conflicting ones: two anti joins."""
    seen = page_mails(spark, sf_dir).where("company_id is not null").select("company_id", "value").distinct()
    known = table(spark, sf_dir, "crm_contacts").where("email is not null").select("company_id", F.lower(F.trim("email")).alias("value"))
    double = signals.conflicts(table(spark, sf_dir, "pdf_pages"), "url", "contact_conflicts").select("value")
    return seen.join(known, ["company_id", "value"], "left_anti").join(double, "value", "left_anti").select("company_id", "value")


@query(
    "WITH k AS (SELECT contact_id, company_id, nullif(trim(regexp_replace(lower(strip_accents(name)), '[^\\p{L}\\p{N}]+', ' ', 'g')), '') AS name, nullif(" + PROFILE_KEY.format(u="linkedin") + """, '') AS profile FROM crm_contacts WHERE company_id IS NOT NULL),
p AS (SELECT company_id, profile, min(contact_id) AS first FROM k WHERE profile IS NOT NULL GROUP BY 1, 2), n AS (SELECT company_id, name, min(contact_id) AS first, count(DISTINCT profile) AS profiles FROM k WHERE name IS NOT NULL GROUP BY 1, 2)
SELECT k.contact_id, least(k.contact_id, coalesce(p.first, k.contact_id), CASE WHEN n.profiles <= 1 THEN n.first ELSE k.contact_id END) AS person FROM k LEFT JOIN p ON k.company_id = p.company_id AND k.profile = p.profile LEFT JOIN n ON k.company_id = n.company_id AND k.name = n.name"""
)
def people_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts of a firm with one profile are one person, and so are those of one name unless their profiles differ."""
    from ..functions.names import normalised_name

    name = F.nullif(normalised_name(F.col("name")), F.lit(""))
    k = table(spark, sf_dir, "crm_contacts").where("company_id is not null").select("contact_id", "company_id", name.alias("name"), F.nullif(urls.profile_key(F.col("linkedin"), DOMAIN), F.lit("")).alias("profile"))
    by_profile = k.where("profile is not null").groupBy("company_id", "profile").agg(F.min("contact_id").alias("fp"))
    # one profile or none: the least and the greatest are the same, no set is needed
    by_name = k.where("name is not null").groupBy("company_id", "name").agg(F.min("contact_id").alias("fn"), F.min("profile").alias("lo"), F.max("profile").alias("hi"))
    joined = k.join(by_profile, ["company_id", "profile"], "left").join(by_name, ["company_id", "name"], "left")
    first = F.when(F.col("lo").eqNullSafe(F.col("hi")), F.col("fn"))
    return joined.select("contact_id", F.least("contact_id", F.coalesce("fp", "contact_id"), F.coalesce(first, "contact_id")).alias("person"))


@query(
    "WITH w AS (SELECT DISTINCT company_id, website FROM companies WHERE website IS NOT NULL AND website <> ''), h AS (SELECT company_id, " + HOST.format(u="url") + " AS host, rank FROM search_hits WHERE url IS NOT NULL AND regexp_matches(url, '(?i)^https?://')),"
    " s AS (SELECT h.company_id, h.host, CASE WHEN h.host = " + HOST.format(u="w.website") + " THEN 1 ELSE 0 END AS same, h.rank FROM h LEFT JOIN w ON h.company_id = w.company_id WHERE h.host <> '')"
    " SELECT company_id, host, same FROM s QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY same DESC, rank, host DESC) = 1"
)
def website_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best host of each firm's hits: its known one first, then the best rank, then the greatest text; one maximum."""
    sites = table(spark, sf_dir, "companies").where("website is not null and website <> ''").select("company_id", urls.host(F.col("website")).alias("known")).distinct()
    hits = table(spark, sf_dir, "search_hits").where(F.col("url").rlike("(?i)^https?://")).select("company_id", urls.host(F.col("url")).alias("host"), "rank").where("host <> ''")
    scored = hits.join(sites, "company_id", "left").withColumn("same", F.when(F.col("host") == F.col("known"), 1).otherwise(0))
    # a missing rank comes last
    best = F.max(F.struct("same", (-F.coalesce("rank", F.lit(2**31 - 2))).alias("r"), "host")).alias("b")
    return scored.groupBy("company_id").agg(best).select("company_id", "b.host", "b.same")


_SLUG = "string_split(lower(" + PATH.format(u="url") + "), '/')"


@query(
    "WITH u AS (SELECT DISTINCT url, list_filter(" + _SLUG + ", lambda p: p <> '') AS parts FROM search_hits WHERE url IS NOT NULL),"
    r" s AS (SELECT url, list_filter(regexp_split_to_array(parts[2], '[-_]+'), lambda w: w <> '') AS w FROM u WHERE len(parts) = 2 AND parts[1] = 'in')"
    r" SELECT url, w[-1] AS stable_id FROM s WHERE regexp_matches(w[-1], '\d')"
)
def profile_stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "search_hits").where("url is not null").select("url").distinct()
    return hits.select("url", profiles.stable_id(F.col("url")).alias("stable_id")).where("stable_id <> ''")


#: Profile addresses beside the tables', whose slugs are of one word.
_SLUGS = ["https://www.linkedin.com/in/pat-van-sample-1a2b", "https://linkedin.com/in/sales-manager", "https://linkedin.com/in/kim_other/"]
_QUOTED = lambda ws: ", ".join(f"'{w}'" for w in ws)


@query(
    "WITH u AS (SELECT DISTINCT url FROM search_hits WHERE url IS NOT NULL UNION SELECT DISTINCT linkedin FROM crm_contacts WHERE linkedin IS NOT NULL UNION SELECT unnest([" + _QUOTED(_SLUGS) + "])), p AS (SELECT url, list_filter(" + _SLUG + ", lambda p: p <> '') AS parts FROM u),"
    r" w AS (SELECT url, list_filter(regexp_split_to_array(parts[2], '[-_]+'), lambda w: w <> '') AS w FROM p WHERE len(parts) = 2 AND parts[1] = 'in'), n AS (SELECT url, len(w) AS k, CASE WHEN regexp_matches(w[-1], '\d') THEN w[:-2] ELSE w END AS w FROM w)"
    r" SELECT url, CASE WHEN k >= 2 AND len(w) BETWEEN 2 AND 6 AND len(list_filter(w, lambda x: NOT regexp_matches(x, '^\p{L}{2,}$') OR x IN (" + _QUOTED(profiles.GENERIC) + "))) = 0"
    " THEN array_to_string(list_transform(w, lambda x, i: CASE WHEN i > 1 AND x IN (" + _QUOTED(profiles.PARTICLES) + ") THEN x ELSE upper(x[1]) || substr(x, 2) END), ' ') ELSE '' END AS name FROM n"
)
def profile_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name spelt in each person's profile address, empty where there is none."""
    found = table(spark, sf_dir, "search_hits").where("url is not null").select("url").union(table(spark, sf_dir, "crm_contacts").where("linkedin is not null").select("linkedin")).distinct()
    all_ = found.union(spark.createDataFrame([(u,) for u in _SLUGS], "url string")).distinct()
    return all_.where(F.lower(urls.path(F.col("url"))).rlike("^/+in/+[^/]+/*$")).select("url", profiles.name_from_profile(F.col("url")).alias("name"))


@query("SELECT company_id, country, CASE WHEN regexp_matches(trim(country), '^[A-Za-z]{2}$') THEN upper(trim(country)) WHEN lower(trim(country)) IN ('spain', '西班牙') THEN 'ES' WHEN lower(trim(country)) IN ('japan', '日本') THEN 'JP' WHEN lower(trim(country)) IN ('russia', 'russian federation', '俄罗斯') THEN 'RU' END AS region FROM (SELECT DISTINCT company_id, country FROM companies WHERE country IS NOT NULL)")
def phone_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    firms = table(spark, sf_dir, "companies").where("country is not null").select("company_id", "country").distinct()
    return firms.select("company_id", "country", profiles.region(F.col("country")).alias("region"))


_MAILED = (
    r"m AS (SELECT company_id, contact_id, lower(trim(email)) AS email, split_part(lower(trim(email)), '@', 2) AS domain, regexp_replace(split_part(lower(trim(email)), '@', 1), '\+.*$', '') AS local FROM crm_contacts WHERE email LIKE '%@%'),"
    r" s AS (SELECT *, CASE WHEN regexp_matches(local, '^[a-z]\.[a-z]{2,}$') THEN 'f.last' WHEN regexp_matches(local, '^[a-z]{2,}\.[a-z]{2,}$') THEN 'first.last' WHEN regexp_matches(local, '^[a-z]{2,}_[a-z]{2,}$') THEN 'first_last' END AS pattern FROM m)"
)


@query("WITH " + _MAILED + " SELECT domain, pattern, min(contact_id) AS basis, count(*) AS n FROM s WHERE pattern IS NOT NULL GROUP BY domain, pattern")
def pattern_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first contact whose address shows how a domain makes addresses of names."""
    return _shaped(spark, sf_dir).where("pattern <> ''").groupBy("domain", "pattern").agg(F.min("contact_id").alias("basis"), F.count("*").alias("n"))


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    email = F.lower(F.trim("email"))
    mailed = table(spark, sf_dir, "crm_contacts").where(F.contains("email", F.lit("@")))
    return mailed.select("company_id", "contact_id", email.alias("email"), F.get(F.split(email, "@"), 1).alias("domain"), profiles.shape_of(F.substring_index(email, "@", 1)).alias("pattern"))


@query(
    "WITH " + _MAILED + ", b AS (SELECT company_id, domain, pattern, min(contact_id) AS basis FROM s WHERE pattern IS NOT NULL GROUP BY 1, 2, 3),"
    " o AS (SELECT contact_id, company_id, string_split(trim(regexp_replace(replace(lower(strip_accents(name)), 'ß', 'ss'), '[^a-z]+', ' ', 'g')), ' ') AS w FROM crm_contacts WHERE trim(name) <> '' AND coalesce(trim(email), '') = ''),"
    " x AS (SELECT o.contact_id, b.pattern, b.basis, CASE b.pattern WHEN 'f.last' THEN w[1][1] || '.' || w[-1] WHEN 'first.last' THEN w[1] || '.' || w[-1] ELSE w[1] || '_' || w[-1] END || '@' || b.domain AS email FROM o JOIN b ON o.company_id = b.company_id WHERE len(w) >= 2)"
    " SELECT contact_id, email, pattern, 'inferred' AS status FROM x WHERE email NOT IN (SELECT email FROM m) QUALIFY row_number() OVER (PARTITION BY contact_id ORDER BY basis, pattern, email) <= 3"
)
def inferred_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses a firm's known patterns would give to contacts without one: at most three, never one that is known."""
    from ..functions.names import normalised_name

    shaped = _shaped(spark, sf_dir)
    basis = shaped.where("pattern <> ''").groupBy("company_id", "domain", "pattern").agg(F.min("contact_id").alias("basis"))
    w = F.split(F.trim(F.regexp_replace(normalised_name(F.col("name")), "[^a-z]+", " ")), " ")
    open_ = table(spark, sf_dir, "crm_contacts").where("trim(name) <> '' and coalesce(trim(email), '') = ''").select("contact_id", "company_id", w.alias("w")).where(F.size("w") >= 2)
    made = open_.join(basis, "company_id").withColumn("email", F.concat(profiles.rendered(F.col("pattern"), F.get("w", 0), F.element_at("w", -1)), F.lit("@"), F.col("domain")))
    place = F.row_number().over(Window.partitionBy("contact_id").orderBy("basis", "pattern", "email"))
    fresh = made.join(shaped.select("email"), "email", "left_anti").withColumn("n", place).where("n <= 3")
    return fresh.select("contact_id", "email", "pattern", F.lit("inferred").alias("status"))


@query(
    "WITH f AS (SELECT DISTINCT company_id, name, " + HOST.format(u="website") + """ AS domain, target_contact_count FROM companies WHERE name IS NOT NULL AND trim(name) <> ''),
q AS (SELECT company_id, unnest(list_filter(['"' || name || '" (procurement OR purchasing OR sourcing OR buyer)', '"' || name || '" ("refractory engineer" OR metallurgist OR "technical manager")', 'site:linkedin.com/in "' || name || '"', '"' || name || '" (email OR phone OR WhatsApp OR "wa.me")',
  CASE WHEN coalesce(domain, '') <> '' THEN 'site:' || domain || ' (team OR management OR contact)' END, CASE WHEN coalesce(domain, '') <> '' THEN 'site:' || domain || ' filetype:pdf' END,
  CASE WHEN target_contact_count >= 4 THEN '"' || name || '" (leadership OR director OR manager OR engineer OR "sales contact")' END, CASE WHEN target_contact_count >= 4 AND coalesce(domain, '') <> '' THEN 'site:' || domain || ' (email OR phone OR WhatsApp OR "mailto:" OR "tel:")' END], lambda x: x IS NOT NULL)) AS query FROM f)
SELECT DISTINCT company_id, query FROM q"""
)
def planned_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search texts of each firm; those of a website or a larger target only where it has one."""
    firms = table(spark, sf_dir, "companies").where("name is not null and trim(name) <> ''").select("company_id", "name", urls.host(F.col("website")).alias("domain"), "target_contact_count").distinct()
    name, domain = F.concat(F.lit('"'), F.col("name"), F.lit('"')), F.col("domain")
    known, more = F.coalesce(domain, F.lit("")) != "", F.col("target_contact_count") >= 4
    texts = [
        F.concat(name, F.lit(" (procurement OR purchasing OR sourcing OR buyer)")),
        F.concat(name, F.lit(' ("refractory engineer" OR metallurgist OR "technical manager")')),
        F.concat(F.lit("site:linkedin.com/in "), name),
        F.concat(name, F.lit(' (email OR phone OR WhatsApp OR "wa.me")')),
        F.when(known, F.concat(F.lit("site:"), domain, F.lit(" (team OR management OR contact)"))),
        F.when(known, F.concat(F.lit("site:"), domain, F.lit(" filetype:pdf"))),
        F.when(more, F.concat(name, F.lit(' (leadership OR director OR manager OR engineer OR "sales contact")'))),
        F.when(known & more, F.concat(F.lit("site:"), domain, F.lit(' (email OR phone OR WhatsApp OR "mailto:" OR "tel:")'))),
    ]
    return firms.select("company_id", F.explode(F.array_compact(F.array(*texts))).alias("query")).distinct()


@query("""WITH f AS (SELECT DISTINCT company_id, name, CASE WHEN len(products) > 0 THEN ' (' || array_to_string(list_transform(products, lambda p: '"' || replace(p, '"', ' ') || '"'), ' OR ') || ')' ELSE '' END AS clause FROM companies WHERE name IS NOT NULL AND trim(name) <> '')
SELECT DISTINCT company_id, unnest(['"' || name || '" (import OR importer OR shipment OR customs)' || clause, '"' || name || '" (Panjiva OR ImportGenius OR Volza OR Trademo)' || clause, '"' || name || '" (consignee OR buyer OR supplier) (shipment OR "bill of lading")' || clause]) AS query FROM f""")
def trade_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    firms = table(spark, sf_dir, "companies").where("name is not null and trim(name) <> ''").select("company_id", "name", "products").distinct()
    quoted = F.transform("products", lambda p: F.concat(F.lit('"'), F.replace(p, F.lit('"'), F.lit(" ")), F.lit('"')))
    clause = F.when(F.size("products") > 0, F.concat(F.lit(" ("), F.array_join(quoted, " OR "), F.lit(")"))).otherwise("")
    name = F.concat(F.lit('"'), F.col("name"), F.lit('"'))
    ends = (" (import OR importer OR shipment OR customs)", " (Panjiva OR ImportGenius OR Volza OR Trademo)", ' (consignee OR buyer OR supplier) (shipment OR "bill of lading")')
    return firms.select("company_id", F.explode(F.array(*[F.concat(name, F.lit(e), clause) for e in ends])).alias("query")).distinct()


@query("SELECT company_id, count(*) AS pages, CAST(sum(length(markdown)) AS BIGINT) AS chars, count(*) FILTER (coalesce(error, '') <> '') AS failed, count(DISTINCT provider) AS providers FROM pdf_pages GROUP BY company_id")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pdf_pages")
    return pages.groupBy("company_id").agg(F.count("*").alias("pages"), F.sum(F.length("markdown").cast("long")).alias("chars"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("failed"), F.countDistinct("provider").alias("providers"))


@query(
    "WITH h AS (SELECT company_id, " + HIT_KEY.format(u="url") + """ AS key, hit_id, coalesce(title, '') AS title FROM search_hits WHERE url IS NOT NULL)
SELECT company_id, key, string_agg(title, chr(10) ORDER BY hit_id, title) AS text FROM h GROUP BY company_id, key"""
)
def text_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titles of all hits of a page in their order."""
    hits = table(spark, sf_dir, "search_hits").where("url is not null").select(F.struct("company_id", urls.hit_key(F.col("url"), DOMAIN).alias("key")).alias("g"), "hit_id", F.coalesce("title", F.lit("")).alias("title"))
    return reports.text_of(hits, "g", "hit_id", "title").select("g.company_id", "g.key", "text")


@query("""SELECT id, company_key, CAST(epoch_us(created_at) AS BIGINT) AS created_us FROM (SELECT DISTINCT id, company_key, created_at FROM jobs WHERE created_at IS NOT NULL) ORDER BY created_at DESC, id DESC LIMIT 100""")
def newest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of the newest hundred: the limit is the feature."""
    jobs = table(spark, sf_dir, "jobs").where("created_at is not null").select("id", "company_key", "created_at").distinct()
    return jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(100).select("id", "company_key", F.expr("unix_micros(cast(created_at as timestamp))").alias("created_us"))


@query("""WITH d AS (SELECT DISTINCT id, batch_id, started_at, heartbeat_at FROM jobs WHERE batch_id IS NOT NULL AND started_at IS NOT NULL AND heartbeat_at IS NOT NULL)
SELECT batch_id, CAST(least(172800, sum(greatest(0, CASE WHEN date_diff('second', started_at, heartbeat_at) <= 1800 THEN date_diff('second', started_at, heartbeat_at) ELSE 0 END))) AS BIGINT) AS active_seconds FROM d GROUP BY batch_id""")
def batch_active_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active time of a batch, gaps of more than half an hour left out, and no more than the batch may last."""
    jobs = table(spark, sf_dir, "jobs").where("batch_id is not null and started_at is not null and heartbeat_at is not null").select("id", "batch_id", "started_at", "heartbeat_at").distinct()
    gap = F.unix_timestamp(F.col("heartbeat_at").cast("timestamp")) - F.unix_timestamp(F.col("started_at").cast("timestamp"))
    return jobs.groupBy("batch_id").agg(F.least(F.lit(172800).cast("long"), F.sum(F.when(gap.between(0, 1800), gap).otherwise(0))).alias("active_seconds"))


@query(r"""WITH o AS (SELECT dup_id, company_id, trim(full_name) AS name, channel FROM crm_duplicates WHERE full_name IS NOT NULL AND trim(full_name) <> ''),
e AS (SELECT DISTINCT company_id, trim(name) AS name FROM crm_contacts WHERE name IS NOT NULL)
SELECT o.company_id, o.name, CASE WHEN max(CASE WHEN e.name IS NULL THEN 0 ELSE 1 END) = 1 THEN 'update' ELSE 'insert' END AS action, count(*) AS rows FROM o LEFT JOIN e ON o.company_id = e.company_id AND o.name = e.name GROUP BY o.company_id, o.name""")
def upsert_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an export does to the contacts of each firm: enrich a known name or insert a new one."""
    found = table(spark, sf_dir, "crm_duplicates").where("full_name is not null and trim(full_name) <> ''").groupBy("company_id", F.trim("full_name").alias("name")).agg(F.count("*").alias("rows"))
    known = table(spark, sf_dir, "crm_contacts").where("name is not null").select("company_id", F.trim("name").alias("name")).distinct().withColumn("hit", F.lit(1))
    return found.join(known, ["company_id", "name"], "left").select("company_id", "name", F.when(F.col("hit") == 1, "update").otherwise("insert").alias("action"), "rows")
