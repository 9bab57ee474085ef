"""A ledger of jobs as events: latest state, first claim, staleness, elapsed time, pages by key."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The greatest row of each key by `order`; whole rows that come twice count once. Partial aggregation, no sort."""
    rest = [c for c in df.columns if c != key and c not in order]
    best = F.max(F.struct(*[F.col(c) for c in (*order, *rest)])).alias("__x")
    return df.groupBy(key).agg(best).select(*[F.col(key) if c == key else F.col(f"__x.{c}").alias(c) for c in df.columns])


def first_claim(df: DataFrame, key: str, at: str, id_: str) -> DataFrame:
    """(key, id, at) of the earliest row of each key, the least id among equals; rows of null key or time left out."""
    claim = F.min(F.struct(at, id_)).alias("c")
    return df.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key).agg(claim).select(key, F.col(f"c.{id_}").alias(id_), F.col(f"c.{at}").alias(at))


def stale(df: DataFrame, key: str, heartbeat: str, as_of: dt.datetime, minutes: int) -> DataFrame:
    """(key, last_seen) of keys whose last heartbeat lies more than `minutes` before as_of, which the caller gives."""
    seen = df.groupBy(key).agg(F.max(heartbeat).alias("last_seen"))
    return seen.where(F.col("last_seen") < F.lit(as_of - dt.timedelta(minutes=minutes)).cast("timestamp_ntz"))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Whole seconds between two times, never below 0; null where either is."""
    return F.greatest(F.lit(0).cast("long"), F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp")))


def keyset_page(df: DataFrame, key: str, after: int, limit: int, ties: list[str] | None = None) -> DataFrame:
    """The next `limit` rows by key, then ties, beyond `after`: a filter that reaches the scan, and a top-k without a full sort."""
    return df.where(F.col(key) > after).orderBy(key, *(ties or [])).limit(limit)


def relevance(text: Column, term: str) -> Column:
    """0 equal, 1 begins with the term, 2 holds it, whatever the case; null for no match."""
    t, x = term.lower(), F.lower(text)
    return F.when(x == t, 0).when(F.startswith(x, F.lit(t)), 1).when(F.contains(x, F.lit(t)), 2)


def best_matches(df: DataFrame, text: str, term: str, limit: int, ties: list[str]) -> DataFrame:
    """df with `tier`, the `limit` rows that hold the term: best tier first, then by text and ties."""
    return df.withColumn("tier", relevance(F.col(text), term)).where("tier is not null").orderBy("tier", F.lower(text), *ties).limit(limit)
