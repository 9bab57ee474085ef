"""The queries of problems 1 to 8 and, where SQL can express one, its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import language as p3
from . import mixing as p7
from . import names as p1
from . import pii as p2
from . import reading as p8
from . import repeated_lines as p4
from . import residue as p5
from . import tokenize as p6


def _linked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1.link_names(table(spark, sf_dir, "crm_duplicates"), short_forms=table(spark, sf_dir, "name_forms"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1.same_entity_pairs(_linked_names(spark, sf_dir))


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked_names(spark, sf_dir)


def _pii_field(spark: SparkSession, sf_dir: str) -> tuple[p2.Field, DataFrame]:
    return p2.fitted(table(spark, sf_dir, "pdf_pages"), table(spark, sf_dir, "crm_contacts"), table(spark, sf_dir, "name_forms"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    field, proposed = _pii_field(spark, sf_dir)
    return p2.find_proposed(proposed, field, "bigint").select("page_id", "pii_type", "pii_value").distinct()


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    field, proposed = _pii_field(spark, sf_dir)
    return p2.redact_proposed(proposed, field, "bigint")


def _language_model(spark: SparkSession, sf_dir: str) -> p3.Model:
    pages, documents = table(spark, sf_dir, "pdf_pages"), table(spark, sf_dir, "documents")
    return p3.fit_model(table(spark, sf_dir, "lang_samples"), (documents, "doc_id", "text", "lang"), (pages, "page_id", "markdown", "declared_lang"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pdf_pages")
    kept = pages.join(p5.find_residue(pages), "page_id", "left_anti")
    return p3.wrong_labels(kept, _language_model(spark, sf_dir)).select("page_id", "para_no", "lang")


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3.segment(table(spark, sf_dir, "pdf_pages"), _language_model(spark, sf_dir)).withColumnRenamed("key", "page_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4.repeated_lines(table(spark, sf_dir, "pdf_pages"))


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4.without_repeated_lines(table(spark, sf_dir, "pdf_pages")).select("page_id", "markdown")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5.find_residue(table(spark, sf_dir, "pdf_pages"))


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5.exclude_residue(table(spark, sf_dir, "pdf_pages")).select("page_id", "url")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6.encode(table(spark, sf_dir, "documents"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7.shares(p7_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_levels(spark, sf_dir).where("level >= 4").select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_entities, p2_found, p2_redacted, p3_found, p3_segments, p4_found, p4_clean, p5_found, p5_clean, p6_ids, p7_mix, p7_shares, p8_found, p8_levels)}

#: Lines' letters, sites and distinct urls, as DuckDB counts them.
P4_SQL = r"""
WITH page AS (
  SELECT page_id, trim(url) AS u, markdown,
         nullif(regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#@:]+)', 1), '^www\.', ''), '') AS site
  FROM pdf_pages),
line AS (
  SELECT page_id, site, u, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS line_no
  FROM page WHERE site IS NOT NULL AND markdown IS NOT NULL),
letters AS (
  SELECT page_id, site, u, line_no,
         lower(regexp_replace(replace(replace(replace(replace(replace(line, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), '[^\p{L}]+', '', 'g')) AS k
  FROM line),
sites AS (SELECT site, count(DISTINCT u) AS urls FROM page WHERE site IS NOT NULL GROUP BY site),
freq AS (
  SELECT l.site, l.k FROM letters l JOIN sites s ON l.site = s.site WHERE length(l.k) >= 12
  GROUP BY l.site, l.k, s.urls HAVING count(DISTINCT l.u) >= 3 AND count(DISTINCT l.u) * 10 >= s.urls)
"""

ORACLE = {
    "p4_found": P4_SQL + "SELECT DISTINCT l.page_id, CAST(l.line_no AS INTEGER) AS line_no FROM letters l JOIN freq f ON l.site = f.site AND l.k = f.k",
}
