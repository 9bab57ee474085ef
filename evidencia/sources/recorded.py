"""Recorded responses and files as tables: search responses, sitemaps, exports, results, page texts, HTML cards."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESPONSE = "struct<results: array<struct<title: string, url: string, content: string, engines: array<string>>>, unresponsive_engines: array<array<string>>>"


def search_results(df: DataFrame, key: str, body: str, limit: int) -> DataFrame:
    """(key, rank, title, url, snippet, engines, public) of JSON search responses.

    The rank is the place in the response before anything is left out; addresses that aren't of the web, or have no
    host, are left out; public marks the first `limit` of the rest. Bodies that aren't JSON give no rows.
    """
    parsed = df.select(F.col(key), F.from_json(body, RESPONSE).alias("r"))
    each = parsed.select(key, F.posexplode("r.results").alias("pos", "x")).where(F.col("x.url").rlike(r"(?i)^https?://[^/?#@\[\]\s]+"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return each.select(key, (F.col("pos") + 1).alias("rank"), "x.title", "x.url", F.coalesce("x.content", F.lit("")).alias("snippet"), F.coalesce("x.engines", F.array().cast("array<string>")).alias("engines"), (place <= limit).alias("public"))


def unresponsive(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, engine, reason) of engines that a response names as not answering."""
    parsed = df.select(F.col(key), F.explode(F.from_json(body, RESPONSE)["unresponsive_engines"]).alias("e"))
    return parsed.where((F.size("e") >= 2) & (F.trim(F.get("e", 0)) != "")).select(key, F.trim(F.get("e", 0)).alias("engine"), F.trim(F.get("e", 1)).alias("reason"))


def markdown_results(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, rank, title, url, snippet) of search responses written as markdown: numbered headings over list items."""
    blocks = F.slice(F.split(F.concat(F.lit("\n"), F.col(body)), r"\n(?=###\s+\d+\.\s)"), 2, 100000)
    each = df.select(F.col(key), F.explode(blocks).alias("b"))
    items = F.filter(F.split("b", "\n"), lambda x: F.startswith(x, F.lit("- ")) & ~F.startswith(x, F.lit("- **URL**:")))
    parsed = each.select(key, F.regexp_extract("b", r"^###\s+(\d+)\.", 1).cast("int").alias("rank"), F.regexp_extract("b", r"^###\s+\d+\.\s+([^\n]+?)\s*(?:\n|$)", 1).alias("title"), F.regexp_extract("b", r"\n- \*\*URL\*\*:\s*(\S+)\s*(?:\n|$)", 1).alias("url"), F.coalesce(F.trim(F.substring(F.get(items, 0), 3, 100000)), F.lit("")).alias("snippet"))
    return parsed.where(F.col("url").rlike("(?i)^https?://"))


def sitemap_locations(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, pos, url): the distinct web addresses of a sitemap's loc elements in order, whatever the namespace."""
    found = F.array_distinct(F.transform(F.xpath(F.col(xml), F.lit('//*[local-name()="loc"]/text()')), lambda x: F.trim(x)))
    return df.select(F.col(key), F.posexplode(F.filter(found, lambda u: u.rlike("(?i)^https?://"))).alias("pos", "url"))


COMPANY = "name string, website string, linkedin_url string, industries array<string>, products array<string>, crm_contact_count int, target_contact_count int, customs_search_enabled boolean"


def company_input(spark: SparkSession, path: str) -> DataFrame:
    """Firms from JSON files, one object each, with `reason`: why a record can't be taken, empty where it can."""
    raw = spark.read.schema(COMPANY).option("multiLine", True).json(path)
    return raw.withColumn("reason", reject_reason())


def reject_reason() -> Column:
    """Why a firm's record can't be taken, by its columns; empty where it can."""
    blank = F.coalesce(F.trim("name"), F.lit("")) == ""
    return F.when(blank, "blank name").when(F.col("crm_contact_count") < 0, "negative contact count").when(F.col("target_contact_count") < 0, "negative target").when(F.col("customs_search_enabled").isNull(), "no flag").otherwise("")


def clamped(limit: int, most: int) -> int:
    """How many results to ask a provider for: from 1 to the most it gives."""
    return max(1, min(most, limit))


def redacted(text: Column, *secrets: str) -> Column:
    """A message without the keys it may repeat."""
    for s in filter(None, secrets):
        text = F.replace(text, F.lit(s), F.lit("***"))
    return text


def first_json_object(text: str | None) -> str | None:
    """The first JSON object that can be read out of noisy text, written again in short form."""
    decoder = json.JSONDecoder()
    at = (text or "").find("{")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(text, at)
            return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            at = text.find("{", at + 1)
    return None


def json_object(text: Column) -> Column:
    run = F.pandas_udf(lambda s: s.map(first_json_object), T.StringType())
    return run(text)


def capped_text(pages: DataFrame, doc: str, page_no: str, text: str, cap: int = 250_000, most: int = 60) -> DataFrame:
    """(doc, text, pages): a document's first `most` page texts under their markers, cut at `cap` characters in all.

    A page without text, as one that couldn't be read, takes no place.
    """
    pages = pages.where(F.col(text).isNotNull()).withColumn("__n", F.row_number().over(Window.partitionBy(doc).orderBy(page_no))).where(F.col("__n") <= most)
    w = Window.partitionBy(doc).orderBy(page_no).rowsBetween(Window.unboundedPreceding, 0)
    running = pages.withColumn("__before", F.sum(F.length(text)).over(w) - F.length(text)).where(F.col("__before") < cap)
    part = F.substring(F.col(text), F.lit(1), (F.lit(cap) - F.col("__before")).cast("int"))
    marked = running.withColumn("__part", F.concat(F.lit("[PDF page "), F.col(page_no), F.lit("]\n"), part))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(page_no, "__part"))), lambda x: x["__part"]), "\n\n")
    return marked.groupBy(doc).agg(joined.alias("text"), F.count("*").alias("pages"))


def export_rows(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV export with a header (a byte order mark is no part of it); a missing required column is an error."""
    df = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"')
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing from {path}: {', '.join(missing)}")
    return df


def result_files(spark: SparkSession, folder: str, schema: str, key: list[str]) -> DataFrame:
    """Result files of runs (run/file.json): the latest file of each key by its time of change; summaries left out."""
    raw = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).json(folder)
    named = raw.withColumn("path", F.col("_metadata.file_path")).withColumn("modified", F.col("_metadata.file_modification_time")).where(~F.col("path").endswith("/summary.json"))
    named = named.withColumn("run", F.element_at(F.split("path", "/"), -2))
    place = F.row_number().over(Window.partitionBy("run", *key).orderBy(F.desc("modified"), "path"))
    return named.withColumn("__n", place).where("__n = 1").drop("__n")


def jdbc_snapshot(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A table of a database, read in ranges of its key; filters and column choices reach the database."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts), **options)
    return reader.load()


class _Cards(HTMLParser):
    """Blocks of a page that hold one heading and a mail or phone link; menus, footers and quotes left out."""

    SKIP, VOID, HEADS = {"nav", "footer", "blockquote", "script", "style"}, {"br", "img", "hr", "input", "meta", "link", "source", "wbr"}, {"h2", "h3", "h4", "h5", "h6"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = {"tag": "", "children": [], "attrs": {}, "up": None}
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "children": [], "attrs": dict(attrs), "up": self.at}
        self.at["children"].append(node)
        if tag not in self.VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node["tag"] != tag:
            node = node["up"]
        if node is not None and node["up"] is not None:
            self.at = node["up"]

    def handle_data(self, data):
        self.at["children"].append(data)


def _text(node) -> str:
    if isinstance(node, str):
        return node
    return "" if node["tag"] in _Cards.SKIP else " ".join(_text(c) for c in node["children"])


def _walk(node) -> Iterator[dict]:
    if not isinstance(node, str) and node["tag"] not in _Cards.SKIP:
        yield node
        for c in node["children"]:
            yield from _walk(c)


def html_cards(html: str | None, most: int = 2500, up: int = 4) -> tuple[list[str], list[tuple[str, str, str]]]:
    """(cards, conflicts) of a page: contact blocks as text; (channel, visible, linked) where label and link differ."""
    parser = _Cards()
    parser.feed(html or "")
    cards: list[str] = []
    conflicts: list[tuple[str, str, str]] = []
    clean = lambda v: " ".join(v.split())
    for node in list(_walk(parser.root)):
        href = node["attrs"].get("href") or ""
        scheme, _, target = href.partition(":")
        if node["tag"] != "a" or scheme.lower() not in {"mailto", "tel"}:
            continue
        target, shown = target.split("?")[0].strip(), clean(_text(node))
        plain = shown.replace(" (at) ", "@").replace("(at)", "@").replace("[at]", "@").lower()
        if scheme.lower() == "mailto" and "@" in plain and " " not in plain and plain != target.lower():
            conflicts.append(("email", plain, target.lower()))
        figures = lambda v: "".join(c for c in v if c.isdigit())
        if scheme.lower() == "tel" and len(figures(shown)) >= 7 and figures(shown)[-7:] != figures(target)[-7:]:
            conflicts.append(("phone", shown, target))
        block, steps = node["up"], 0
        while block is not None and block["up"] is not None and steps < up:
            heads = [n for n in _walk(block) if n["tag"] in _Cards.HEADS]
            body = clean(_text(block))
            if len(heads) > 1 or len(body) > most:
                break
            if len(heads) == 1:
                if body not in cards:
                    cards.append(body)
                break
            block, steps = block["up"], steps + 1
    return cards, list(dict.fromkeys(conflicts))


def contact_cards(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, cards, conflicts) of each page's HTML; null and broken HTML give empty lists."""
    schema = T.StructType([df.schema[key], T.StructField("cards", T.ArrayType(T.StringType())), T.StructField("conflicts", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("channel", "visible", "href")])))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [html_cards(h) for h in batch[html]]
            yield pd.DataFrame({key: batch[key], "cards": [g[0] for g in got], "conflicts": [[dict(zip(("channel", "visible", "href"), c, strict=True)) for c in g[1]] for g in got]})

    return df.select(key, html).mapInPandas(run, schema)
