"""Joins of evidence: by any of several keys, exactly one, nearest, last before, phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import contains_phrase


def exploded_keys(df: DataFrame, id_: Column, scope: Column, channels: dict[str, Column]) -> DataFrame:
    """(id, scope, channel, key): one row for each distinct non-empty key; a channel's column is an array of keys."""
    def tagged(channel: str, keys: Column) -> Column:
        return F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.struct(F.lit(channel).alias("channel"), k.alias("key")))

    each = [tagged(channel, keys) for channel, keys in channels.items()]
    flat = df.select(id_.alias("id"), scope.alias("scope"), F.explode(F.concat(*each)).alias("x"))
    return flat.where("x.key is not null and x.key <> '' and scope is not null").select("id", "scope", "x.channel", "x.key").distinct()


def match_any(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, matched_by): pairs of exploded keys that share any, with the channels they share.

    One equi-join on (scope, channel, key) in place of a condition that joins by this or that key.
    """
    a, b = left.withColumnRenamed("id", "left_id"), right.withColumnRenamed("id", "right_id")
    return a.join(b, ["scope", "channel", "key"]).groupBy("left_id", "right_id").agg(F.sort_array(F.collect_set("channel")).alias("matched_by"))


def known_by(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, matched_by, known): for each left id the channels by which any right row knows it; no pairs are made."""
    keys = right.select("scope", "channel", "key").distinct().withColumn("hit", F.lit(1))
    joined = left.join(keys, ["scope", "channel", "key"], "left")
    return joined.groupBy("id").agg(F.sort_array(F.collect_set(F.when(F.col("hit") == 1, F.col("channel")))).alias("matched_by"), F.max(F.coalesce("hit", F.lit(0))).alias("known"))


def only_match(pairs: DataFrame, of: str, to: str) -> DataFrame:
    """Pairs whose `of` has exactly one distinct `to`, by partial aggregation."""
    return pairs.groupBy(of).agg(F.min(to).alias(to), F.max(to).alias("__hi")).where(F.col(to) == F.col("__hi")).drop("__hi")


def last_before(df: DataFrame, group: list[Column], order: list[Column], mark: Column, value: Column, name: str) -> DataFrame:
    """Rows with `name`: the value of the last marked row at or before each, as-of backwards; one sort, no range join."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(F.when(mark, value), ignorenulls=True).over(w))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, other: str, radius: int, id_: str) -> DataFrame:
    """left with the nearest right row within the radius: least distance, then least position, then least id.

    Positions are whole numbers. Both sides meet in cells of the radius' width, so a key with very many rows is split.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(max(radius, 1))).cast("long")
    r = right.select(*keys, other, id_).withColumn("__cell", F.explode(F.array(cell(other) - 1, cell(other), cell(other) + 1)))
    pairs = left.withColumn("__cell", cell(at)).join(r, [*keys, "__cell"]).withColumn("distance", F.abs(F.col(at) - F.col(other))).where(F.col("distance") <= radius)
    best = F.min(F.struct("distance", other, id_)).alias("__best")
    return pairs.groupBy(*left.columns).agg(best).select(*left.columns, F.col("__best.distance").alias("distance"), F.col(f"__best.{id_}").alias(id_))


def mentions(texts: DataFrame, phrases: DataFrame, key: str, text: str, phrase: str) -> DataFrame:
    """texts joined with the phrases of the same key that stand in them at word bounds; an equi-join narrows first."""
    return texts.join(phrases, key).where(contains_phrase(F.col(text), F.col(phrase)))


def without_conflicts(signals: DataFrame, conflicts: DataFrame, on: list[str]) -> DataFrame:
    """Signals of values that some page shows with two meanings leave altogether."""
    return signals.join(conflicts.select(*on).distinct(), on, "left_anti")
