"""Search providers over recorded responses: a Spark data source, the protocol behind it, and a table function on texts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path
from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

COLUMNS = "query string, provider string, rank int, title string, url string, snippet string, engines array<string>, public boolean"


class SearchProvider(Protocol):
    """Anything that answers a query with hits: title, url, snippet, engines and rank."""

    def search(self, query: str, limit: int) -> list[dict]: ...


def hits_of(line: str, limit: int) -> Iterator[dict]:
    """Hits of one recorded response (query, provider, body) in a line of JSON; lines that aren't, or whose body isn't, give none.

    The rank is the place before anything is left out; public marks the first `limit` web addresses.
    """
    try:
        record = json.loads(line)
        results = record["body"]["results"]
    except (ValueError, KeyError, TypeError):
        return
    n = 0
    for rank, r in enumerate(results if isinstance(results, list) else [], 1):
        if isinstance(r, dict) and re.match(r"(?i)https?://[^/?#@\[\]\s]+", str(r.get("url") or "")):
            n += 1
            yield {"query": record.get("query"), "provider": record.get("provider"), "rank": rank, "title": r.get("title"), "url": r["url"], "snippet": r.get("content") or "", "engines": r.get("engines") or [], "public": n <= limit}


class Recorded:
    """A provider that answers from a folder of recorded responses."""

    def __init__(self, folder: str):
        self.folder = folder

    def search(self, query: str, limit: int) -> list[dict]:
        lines = (line for path in sorted(Path(self.folder).glob("*.jsonl")) for line in path.open(encoding="utf-8"))
        return [h for line in lines for h in hits_of(line, limit) if h["query"] == query and h["public"]]


class RecordedResponses(DataSource):
    """spark.read.format("recorded_responses").option("limit", 5).load(folder): the hits of all *.jsonl files, a task for each."""

    @classmethod
    def name(cls) -> str:
        return "recorded_responses"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options.get("path", ""), int(self.options.get("limit", 5)))


class _Reader(DataSourceReader):
    def __init__(self, folder: str, limit: int):
        self.folder, self.limit = folder.removeprefix("file:"), limit

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(str(p)) for p in sorted(Path(self.folder).glob("*.jsonl"))] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value:
            with open(partition.value, encoding="utf-8") as f:
                for line in f:
                    for hit in hits_of(line, self.limit):
                        yield tuple(hit.values())


@udtf(returnType="no int, section string")
class TextSections:
    """text_sections(text): the parts of a text between blank lines and headings, as rows for SQL."""

    def eval(self, text: str):
        for no, part in enumerate(p for p in re.split(r"\n\s*\n|\n(?=[ \t]*#{1,6}\s)", text or "") if p.strip()):
            yield no, part


def register(spark: SparkSession) -> None:
    """Make the data source and the table function known to a session."""
    spark.dataSource.register(RecordedResponses)
    spark.udtf.register("text_sections", TextSections)
