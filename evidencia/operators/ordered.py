"""Order-dependent steps on rows: first wins, top k, latest, fallback, fusion, budgets, gaps and streaks.

Where order decides, it is a column. Ties end at a unique key, so results are the same for any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import free_name


def first_wins(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; rows equal in all of it are one choice. Null is a key of its own."""
    n = free_name(df, "__n")
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(n) == 1).drop(n)


def first_by(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """first_wins by partial aggregation, for keys that hold very many rows: no key is sorted in one task."""
    best = F.min(F.struct(*[F.col(c) for c in (*order, *keep)])).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__best.{c}").alias(c) for c in (*order, *keep)])


def top_k(df: DataFrame, group: list[Column], key: Column, order: list[Column], k: int) -> DataFrame:
    """k rows of each group after duplicates of a key have given way to their first; a duplicate takes no place."""
    d, n = free_name(df, "__d"), free_name(df, "__r")
    once = df.withColumn(d, F.row_number().over(Window.partitionBy(*group, key).orderBy(*order))).where(F.col(d) == 1).drop(d)
    return once.withColumn(n, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(n) <= k).drop(n)


def fallback(df: DataFrame, group: list[str], rank: str) -> DataFrame:
    """The rows of each group's first source that has any: the least rank wins as a whole."""
    best = df.groupBy(*group).agg(F.min(rank).alias("__best"))
    joined = df.join(best, group)
    return joined.where(F.col(rank) == F.col("__best")).drop("__best")


def running_cap(df: DataFrame, group: list[str], order: str, size: Column, cap: int, width: int) -> DataFrame:
    """Rows with `used`, the size so far, and `kept`, how much of the row fits under the cap.

    Rows come in the order of a whole number, unique in its group. Sums of stretches of `width` numbers run first, so
    a group with very many rows is added up in as many tasks as it has stretches.
    """
    s, stretch, before = free_name(df, "__size"), free_name(df, "__stretch"), free_name(df, "__before")
    sized = df.withColumn(s, size).withColumn(stretch, F.floor(F.col(order) / width))
    sums = sized.groupBy(*group, stretch).agg(F.sum(s).alias(before))
    upto = F.sum(before).over(Window.partitionBy(*group).orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn(before, F.coalesce(upto, F.lit(0)))
    inside = F.sum(s).over(Window.partitionBy(*group, stretch).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    used = F.col(before) + F.col("used")
    joined = sized.withColumn("used", inside).join(sums, [*group, stretch]).withColumn("used", used)
    return joined.withColumn("kept", F.greatest(F.lit(0), F.least(F.col(s), F.lit(cap) - (F.col("used") - F.col(s))))).drop(s, stretch, before)


def fair_share(sizes: list[int], total: int, most: int) -> list[int]:
    """Parts of a budget: each item in turn gets its size, the cap, or an equal part of what is left, rounded down."""
    left, parts = total, []
    for i, size in enumerate(sizes):
        parts.append(min(size, most, left // (len(sizes) - i)))
        left -= parts[-1]
    return parts


def fair_share_rows(df: DataFrame, group: str, order: str, size: str, total: int, most: int) -> DataFrame:
    """df with `part`, as fair_share gives it to the rows of a group in their order; null is a group of its own.

    Each part depends on the one before, so a group runs through one task, row by row: nothing of it is held. A row
    without size gets nothing and takes no place.
    """
    counted = df.where(F.col(size).isNotNull())
    n = counted.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__items"))
    rows = counted.join(n, F.col(group).eqNullSafe(F.col("__g"))).drop("__g").repartition(group).sortWithinPartitions(group, order)
    schema, columns = T.StructType([*df.schema.fields, T.StructField("part", T.LongType())]), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, items = object(), 0, 0
        for batch in batches:
            parts = []
            for g, s, many in zip(*(batch.column(c).to_pylist() for c in (group, size, "__items")), strict=True):
                if g != now or not items:
                    now, left, items = g, total, many
                parts.append(min(s, most, left // items))
                left, items = left - parts[-1], items - 1
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(parts, pa.int64())], names=[*columns, "part"])

    return rows.mapInArrow(run, schema)


def breaker(df: DataFrame, group: list[str], order: list[str], failed: Column, worked: Column, most: int, at: str) -> DataFrame:
    """(group..., stopped): when the `most`-th failure since the last success came; null where it never did.

    What neither failed nor worked changes nothing.
    """
    run, n = free_name(df, "__run"), free_name(df, "__n")
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    since = df.withColumn(run, F.sum(F.when(worked, 1).otherwise(0)).over(w))
    inside = Window.partitionBy(*group, run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = since.withColumn(n, F.sum(F.when(failed, 1).otherwise(0)).over(inside))
    return counted.groupBy(*group).agg(F.min(F.when(F.col(n) >= most, F.col(at))).alias("stopped"))


def capped_gaps(df: DataFrame, group: list[str], ts: str, cap_seconds: float) -> DataFrame:
    """(group..., active_us): time between neighbouring events, gaps above the cap and backward steps left out."""
    micros = F.expr(f"unix_micros(cast({ts} as timestamp))")
    gap = micros - F.lag(micros).over(Window.partitionBy(*group).orderBy(ts))
    seen = df.select(*group, gap.alias("gap"))
    return seen.groupBy(*group).agg(F.sum(F.when(F.col("gap").between(0, int(cap_seconds * 1_000_000)), F.col("gap")).otherwise(0)).alias("active_us"))


def streaks(df: DataFrame, group: list[str], order: list[str], failed: Column) -> DataFrame:
    """Rows with `streak`: how many failures stand in a row up to and with this one; a success is 0."""
    w = Window.partitionBy(*group).orderBy(*order)
    runs = F.sum(F.when(failed, 0).otherwise(1)).over(w)
    run = free_name(df, "__run")
    numbered = df.withColumn(run, runs)
    inside = Window.partitionBy(*group, run).orderBy(*order)
    return numbered.withColumn("streak", F.sum(F.when(failed, 1).otherwise(0)).over(inside)).drop(run)
