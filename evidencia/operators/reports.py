"""Aggregates over evidence: attribution, contact methods, coverage, active time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attribution(hits: DataFrame, engines: Column, query: Column, key: Column) -> DataFrame:
    """(engine, observations, urls, exclusive_urls): what each engine found, and what no other did.

    A hit that several engines found counts for each; the same engine, query and key count once. Hits without engines
    count for 'unattributed'. Exclusive is decided by the least and greatest engine of a key, so no set is collected.
    """
    named = F.when(F.size(F.coalesce(engines, F.array().cast("array<string>"))) > 0, engines).otherwise(F.array(F.lit("unattributed")))
    seen = hits.select(query.alias("query"), key.alias("key"), F.explode(named).alias("engine")).where("key is not null").distinct()
    pairs = seen.groupBy("engine", "key").agg(F.count("*").alias("n"))
    origin = pairs.groupBy("key").agg(F.min("engine").alias("engine"), F.max("engine").alias("last")).where("engine = last").select("key", "engine", F.lit(1).alias("own"))
    joined = pairs.join(origin, ["key", "engine"], "left")
    return joined.groupBy("engine").agg(F.sum("n").alias("observations"), F.count("*").alias("urls"), F.sum(F.coalesce("own", F.lit(0))).alias("exclusive_urls"))


def methods(values: DataFrame, group: str) -> DataFrame:
    """(group, methods): distinct (channel, value) of each group; a phone that also chats counts for both channels."""
    return values.select(group, "channel", "value").distinct().groupBy(group).agg(F.count("*").alias("methods"))


def coverage(values: DataFrame, group: str, channels: tuple[str, ...]) -> DataFrame:
    """(group, one count for each channel, total) of distinct values."""
    once = values.select(group, "channel", "value").distinct()
    return once.groupBy(group).agg(*[F.count_if(F.col("channel") == c).alias(c) for c in channels], F.count("*").alias("total"))


def text_of(parts: DataFrame, group: str, order: str, text: str, name: str = "text") -> DataFrame:
    """(group, text): parts joined by line feeds in their order; a group must fit one row."""
    listed = F.sort_array(F.collect_list(F.struct(order, text)))
    return parts.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: x[text]), "\n").alias(name))
