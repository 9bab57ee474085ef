"""Problem 5: records that hold template residue, filler or error-page text instead of real content.

Each page is cut into units (sentences, headings, labels). The evidence of all hosts finds the residue: a unit that
stands under different address slugs on different hosts, only ever on pages that say next to nothing, most of which
have nothing to do with their own slug and title. Detectors mark unfilled places, filler and the plainest messages, so
that also what stands once in a corpus is found. A page is residue when nothing else is left of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import bounded_broadcast, col, cut
from .repeated_lines import Support, _match, identified, letters_by_line, repeated_lines, site_of

#: Letters and signs from which on a unit counts as long.
LONG = 100
PAGE_MARK = r"\[PDF page \d+\]"

# How unfilled places of a template are written.
PLACEHOLDER = r"\{\{[^{}\n]{1,60}\}\}|\{%[^{}\n]{1,60}%\}|\$\{[^{}\n]{1,60}\}|<<[^<>\n]{1,60}>>|«[^«»\n]{1,40}»|@@[^@\n]{1,60}@@|%%[^%\n]{1,60}%%|\[\p{L}[\p{L}_ -]{0,40}\](?!\()|<\p{L}[\p{L}\d_ -]{0,40}>|_\p{L}+_TBD_|_{3,}|\bTBD\b"

#: What every unfilled place has: a cheap test before the costly one.
HOLE = r"[{<«@%\[_$]|TBD"

# Words of filler text. A unit made of them is filler.
LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor tempus incididunt labore dolore magna aliqua donec mauris nisi nulla tellus felis massa congue augue lectus varius orci pretium ornare vitae velit risus porta quis nostrud ut enim ad minim veniam duis aute irure vestibulum pellentesque curabitur integer vivamus".split()
FILLER = r"lorem ipsum|placeholder|click to (add|edit|enter)|text goes here|sample (paragraph|text)|\btodo\b|to be (completed|written|defined|done)|\btext text\b|\basdf|\bqwerty|\bx{3,}\b|aquí va (su|tu|el) texto|texto de (ejemplo|relleno|exemplo)|blindtext|beispieltext|platzhalter|texte (à|a) remplacer|texte (factice|d'exemple)|testo (segnaposto|di esempio)|inserire (qui )?il testo|inserir texto|seu texto aqui|voorbeeldtekst|tekst hier|tu wpisz|przykładowy tekst|tekst zastępczy|текст-заполнитель|здесь будет текст|вставьте текст"

# The status lines of HTTP and the plainest messages on missing pages, log-ins and scripts in the nine
# languages, for those that stand but once or twice. All other wordings are left to the hosts' evidence.
ERROR = r"\b(error|http|fehler|erreur|errore|erro|fout|błąd|ошибка)\s*:?\s*[345]\d\d\b|^[345]\d\d\b|bad gateway|(page|file|document) (was )?not found|server error|serverfehler|erreur (du |de )?serveur|error del servidor|errore (del|di) server|erro (do|no) servidor|serverfout|błąd serwera|ошибка сервера|service unavailable|gateway timeout|nicht gefunden|introuvable|no encontrad[ao]|non trovat[ao]|não encontrad[ao]|niet gevonden|nie znaleziono|не найден"
ACCESS = r"access denied|\bforbidden\b|(log|sign)[- ]?in (is )?(needed|required)|please (log|sign) in|zugriff verweigert|accès refusé|acceso denegado|accesso negato|acesso negado|toegang geweigerd|odmowa dostępu|доступ запрещ[её]н"
SCRIPT = r"javascript|noscript|\bscripts?\b|\bskripte?\b|\bskrypty?\b|\bскрипты?\b|(enable|allow|turn on|switch on) cookies"


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern at its top level."""
    parts, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        depth += (c in "([") - (c in ")]")
        if c == "|" and not depth:
            parts.append(pattern[start:i])
            start = i + 1
        i += 2 if c == "\\" else 1
    return [*parts, pattern[start:]]


def _any(*patterns: str) -> str:
    """One pattern for text in small letters. Alternatives of one first letter share its test, so that few are tried at a place."""
    first: dict[str, list[str]] = {}
    for alternative in _alternatives("|".join(patterns)):
        # a letter that may be missing can't be tested for all
        shared = alternative[0] if alternative[0].isalpha() and alternative[1:2] not in ("?", "*", "{") else ""
        first.setdefault(shared, []).append(alternative[len(shared) :])
    return "|".join(f"{k}(?:{'|'.join(v)})" if k else "|".join(v) for k, v in first.items())


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}]+", " ")), " "), lambda w: w != "")


def units(body: Column) -> Column:
    """Sentences, headings and labels of a body; lines broken by the layout are joined first."""
    # patterns begin with the letter they seek, so that the JVM tries few places
    marked = F.replace(F.regexp_replace(body, PAGE_MARK, "\n\n"), F.lit("\r"), F.lit(""))
    paragraphs = F.split(marked, r"\n(?:\s*\n|(?=\s*(?:[#*>|-]|\d+\.)\s))")
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.split(F.trim(F.regexp_replace(p, r"[\s\x{A0}]+", " ")), r" (?<=[.!?:…] )")))
    return F.filter(pieces, lambda u: u.rlike(r"[\p{L}\p{N}_{}<>\[\]%@«»]"))


#: Filler and messages of all kinds, in small letters.
MESSAGE = _any(FILLER, ERROR, ACCESS, SCRIPT)


def measured(us: Column) -> Column:
    """Units with the number of words outside unfilled places, of those places and of words of filler."""

    def one(u: Column) -> Column:
        may = u.rlike(HOLE)
        words = _words(F.when(may, F.regexp_replace(u, PLACEHOLDER, " ")).otherwise(u))
        holes = F.when(may, F.size(F.regexp_extract_all(u, F.lit(f"({PLACEHOLDER})"), F.lit(1)))).otherwise(0)
        return F.struct(u.alias("text"), F.size(words).alias("words"), holes.alias("holes"), F.size(F.filter(words, lambda w: w.isin(LATIN))).alias("latin"))

    return F.transform(us, one)


def identity(unit: Column) -> Column:
    """What a unit says, apart from capitalised words, figures and signs; all of it where no word in small letters is left."""
    small = F.regexp_replace(unit, r"[^\p{L}]+|\p{Lu}\p{L}*", "")
    return F.when(F.length(small) >= 4, F.xxhash64(small)).otherwise(F.xxhash64(F.lit(1), F.lower(unit)))


def kinds(us: Column, identities: bool = True) -> Column:
    """Measured units with kind residue, label (too short to say anything) or text, words and, if wanted, identity."""

    def one(u: Column) -> Column:
        kind = (
            F.when((u["holes"] > 0) & (u["words"] <= 9 * u["holes"]), "residue")
            .when((u["words"] > 0) & (u["latin"] * 10 >= u["words"] * 6), "residue")
            .when((u["words"] <= 14) & F.lower(u["text"]).rlike(MESSAGE), "residue")
            .when(u["words"] <= 3, "label")
            .otherwise("text")
        )
        return F.struct(kind.alias("kind"), u["words"].alias("words"), *([identity(u["text"]).alias("id")] if identities else []))

    return F.transform(us, one)


def said(units: Column) -> Column:
    """How many words the units say that no detector marks."""
    return F.aggregate(F.filter(units, lambda u: u["kind"] != "residue"), F.lit(0), lambda n, u: n + u["words"])


def boilerplate_lines(df: DataFrame, key: str, text: str, url: str, support: Support, share: float = 0.5, hosts: int = 2, hot: int = 2000) -> DataFrame:
    """(key, n): lines that their own site repeats, and lines that other hosts repeat wherever they stand.

    A site of which few files were fetched can't show that it repeats a line; the hosts together can: a wording that is
    a repeated line in at least `share` of its places, on at least `hosts` sites, is one here too.
    """
    page = df.select(col(df, key).alias("key"), site_of(col(df, url)).alias("site"), F.xxhash64(F.trim(col(df, url))).alias("u"), col(df, text).alias("text")).where("text is not null")
    # what is written with a capital, a figure or a sign of an address names a firm, a person or a date
    masked = F.split(F.regexp_replace("text", r"(?<!\S)[^\s\p{Lu}@\d]*+[\p{Lu}@\d]\S*+|[^\p{L}\n]+", ""), "\n", -1)
    each = page.select("key", "site", "u", F.posexplode(F.arrays_zip(letters_by_line(F.col("text")).alias("letters"), masked.alias("masked"))).alias("n", "x"))
    each = identified(each.select("key", "site", "u", (F.col("n") + 1).alias("n"), "x.letters", "x.masked"), support)
    # across hosts a line is the same if all its letters are, or those of its words in small letters
    both = F.filter(F.array(F.when(F.length("masked") >= 8, F.xxhash64("masked")), F.col("h2")), lambda x: x.isNotNull())
    # one pass over the texts serves the search within sites and across them
    long = cut(each.select("key", "site", "u", "n", "h1", "h2", both.alias("ids")))
    within = long.where("site is not null").select("key", "site", "u", "n", "h1", "h2")
    gone = repeated_lines(df, key, text, url, support, within).select(F.col(key).alias("key"), F.col("line_no").alias("n"), F.lit(1).alias("again"))
    each = long.where("key is not null").select("key", F.xxhash64("site").alias("site"), "n", "ids")
    each = cut(each.join(gone, ["key", "n"], "left").withColumn("again", F.coalesce("again", F.lit(0))))
    # only pages of sites that show repeated lines at all can say whether a line is one
    shown = each.groupBy("key").agg(F.max("again").alias("any")).where("any = 1").select("key")
    counts = each.join(shown, "key", "left_semi").select("site", "again", F.explode("ids").alias("id")).groupBy("id", "site").agg(F.count("*").alias("n"), F.sum("again").alias("a"))
    wording = cut(counts.groupBy("id").agg(F.sum("n").alias("support"), F.sum("a").alias("a"), F.count_if(F.col("a") > 0).alias("hosts")).where((F.col("a") >= share * F.col("support")) & (F.col("hosts") >= hosts)).select("id", "support"))
    total = wording.agg(F.sum("support")).first()[0] or 0
    elsewhere = each.where("again = 0").select("key", "n", F.col("site").alias("u"), F.explode("ids").alias("id"))
    matched = _match(elsewhere, wording, ["id"], total, hot).select("key", "n")
    return each.where("again = 1").select("key", "n").unionByName(matched).distinct()


def page_units(df: DataFrame, key: str, text: str, url: str, title: str, error: str, support: Support, low: int) -> DataFrame:
    """One row for each page: key, site, slug, error, blank, matches (slug or title terms stand in the body), thin, units, ids.

    thin: the page says at most `low` words outside what the detectors mark. A thin page has its units, any other page
    the identities of its units, which show what stands beside content.
    """
    gone = boilerplate_lines(df, key, text, url, support).groupBy(F.col("key").alias("__k")).agg(F.collect_set("n").alias("gone"))
    page = df.select(col(df, key).alias("key"), site_of(col(df, url)).alias("site"), F.trim(col(df, url)).alias("url"), col(df, title).cast("string").alias("title"), col(df, error).cast("string").alias("error"), col(df, text).alias("text"))
    page = page.join(gone, F.col("key").eqNullSafe(F.col("__k")), "left").drop("__k")
    body = F.expr("array_join(filter(transform(split(text, '\\n', -1), (l, i) -> if(array_contains(gone, cast(i + 1 as int)), '', l)), x -> x is not null), '\n')")
    page = page.withColumn("body", F.when(F.col("gone").isNull(), F.col("text")).otherwise(body))
    dropped = F.expr("filter(transform(split(text, '\\n', -1), (l, i) -> if(array_contains(gone, cast(i + 1 as int)), l, '')), x -> x != '')")
    page = page.withColumn("us", F.coalesce(units(F.col("body")), F.array().cast("array<string>")))
    # a page's first long units mostly say enough; only where they don't are all its units tested
    first = F.slice(F.filter("us", lambda u: F.length(u) >= LONG // 2), 1, 5)
    page = page.withColumn("own", F.when(said(kinds(measured(first), False)) <= low, kinds(measured(F.col("us")))))
    page = page.withColumn("thin", F.coalesce(said(F.col("own")) <= low, F.lit(False)))
    dropped_units = F.filter(kinds(measured(dropped)), lambda u: u["kind"] == "residue")  # a message that a whole site repeats is still a message
    page = page.withColumn("units", F.when(F.col("thin"), F.concat("own", F.when(F.col("gone").isNull(), F.array()).otherwise(dropped_units))))
    page = page.withColumn("ids", F.when(~F.col("thin"), F.array_distinct(F.transform("us", identity))))
    slug = F.regexp_extract("url", r"([^/?#]*)/*(?:[?#].*)?$", 1)
    terms = F.filter(_words(F.concat_ws(" ", F.regexp_replace(slug, r"(?i)\.pdf$", ""), F.regexp_replace("title", r"(?i)\.pdf", " "))), lambda w: F.length(w) >= 4)
    matches = F.when(F.col("thin"), F.arrays_overlap(terms, _words(F.coalesce("body", F.lit("")))))
    return page.select("key", F.xxhash64("site").alias("site"), F.xxhash64(slug).alias("slug"), "error", (~F.coalesce("text", F.lit("")).rlike(r"[^\s\x{A0}\x{FEFF}\x{200B}]")).alias("blank"), F.coalesce(matches, F.lit(False)).alias("matches"), "thin", "units", "ids")


def duplicated(page: DataFrame, slugs: int, hosts: int) -> DataFrame:
    """(id): units that the hosts together show to be no content.

    Such a unit stands under at least `slugs` different slugs on at least `hosts` hosts, never on a page that says
    more, and at most half of its pages have to do with their slug or title.
    """
    each = page.where("thin").select("site", "slug", "matches", F.explode("units").alias("u")).where("u.kind <> 'residue' and u.words > 1")
    # by slug first: few rows are left for the count of different ones, however often a unit stands
    by_slug = each.groupBy(F.col("u.id").alias("id"), "slug").agg(F.min("site").alias("s1"), F.max("site").alias("s2"), F.count("*").alias("n"), F.sum(F.col("matches").cast("long")).alias("m"))
    wide = by_slug.groupBy("id").agg(F.count("*").alias("slugs"), F.min("s1").alias("s1"), F.max("s2").alias("s2"), F.sum("n").alias("n"), F.sum("m").alias("m"))
    enough = (F.col("slugs") >= slugs) & (F.col("m") * 2 <= F.col("n")) & (F.lit(hosts <= 1) | (F.col("s1") != F.col("s2")))
    candidates = cut(wide.where(enough).select("id"))
    beside = page.where("not thin").select(F.explode("ids").alias("id")).join(bounded_broadcast(candidates, 200_000, "candidates"), "id", "left_semi").distinct()
    return candidates.join(beside, "id", "left_anti")


def find_residue(df: DataFrame, key: str = "page_id", text: str = "markdown", url: str = "url", title: str = "title", error: str = "error", support: Support = Support(), low: int = 40, slugs: int = 3, hosts: int = 2) -> DataFrame:
    """(key): pages whose text, the lines repeated by its site aside, is nothing but residue; blank pages with an error.

    Null text counts as blank; null or blank error as none; pages without url take part without a site; an empty table
    gives an empty result; repeated rows of one key give one row. low: words outside what the detectors mark, up to
    which a page says next to nothing. slugs, hosts: as for `duplicated`; hosts is 1 or 2.
    """
    page = cut(page_units(df, key, text, url, title, error, support, low))
    thin = page.where("thin").select("key", F.explode("units").alias("u")).select("key", "u.kind", "u.words", "u.id")
    known = duplicated(page, slugs, hosts).withColumn("known", F.lit(True))
    # a label in front of something else says nothing by itself
    judged = thin.join(known, "id", "left").withColumn("known", F.coalesce("known", F.lit(False)) | (F.col("kind") == "residue"))
    open_ = (F.col("kind") == "text") & ~F.col("known")
    sums = judged.groupBy("key").agg(F.count_if("known").alias("residues"), F.sum(F.when(F.col("known"), F.col("words") + 1).otherwise(0)).alias("residue_words"), F.count_if(open_).alias("open"), F.sum(F.when(open_, F.col("words")).otherwise(0)).alias("open_words"))
    joined = page.select("key", "blank", "error", "matches", "thin").join(sums, "key", "left")
    nothing = F.col("thin") & (F.col("residues") > 0) & (
        (F.col("open") == 0)
        # one short unit that nothing explains, on a page whose address and title have nothing to do with it
        | ((F.col("open") == 1) & (F.col("open_words") <= 10) & (F.col("residue_words") * 2 >= F.col("open_words")) & ~F.col("matches"))
    )
    empty = F.col("blank") & (F.trim(F.coalesce(F.col("error"), F.lit(""))) != "")
    return joined.where(F.when(F.col("blank"), empty).otherwise(F.coalesce(nothing, F.lit(False)))).select(F.col("key").alias(key)).distinct()


def exclude_residue(df: DataFrame, key: str = "page_id", **columns) -> DataFrame:
    """df without the pages that find_residue names; rows of null key stay."""
    found = find_residue(df, key, **columns).select(F.col(key).alias("__key"))
    return df.join(found, col(df, key) == F.col("__key"), "left_anti")
