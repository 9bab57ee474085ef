"""Writing results: one folder for each kind, parts by key, JSON of assembled results, insert where absent."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import first_by


def write_tables(tables: dict[str, DataFrame], folder: str, by: list[str] | None = None) -> None:
    """Each table into its own Parquet folder, in folders by key where the table has the key."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        parts = [c for c in by or [] if c in df.columns]
        (writer.partitionBy(*parts) if parts else writer).parquet(f"{folder}/{name}")


def assembled(groups: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, result): one JSON object for each key, with a list for each group, in the rows' order by all columns."""
    parts = [df.select(F.col(key).alias("k"), F.lit(name).alias("g"), F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("j")) for name, df in groups.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    listed = rows.groupBy("k", "g").agg(F.sort_array(F.collect_list("j")).alias("js"))
    field = F.concat(F.to_json(F.array("g")).substr(F.lit(2), F.length(F.to_json(F.array("g"))) - 2), F.lit(":["), F.array_join("js", ","), F.lit("]"))
    return listed.withColumn("f", field).groupBy("k").agg(F.sort_array(F.collect_list("f")).alias("fs")).select(F.col("k").alias(key), F.concat(F.lit("{"), F.array_join("fs", ","), F.lit("}")).alias("result"))


def absent_only(new: DataFrame, present: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """Rows of `new` whose key `present` doesn't have, the least of each key by `order` and then all columns: what an insert may add."""
    rest = [c for c in new.columns if c not in on and c not in order]
    return first_by(new, on, order, rest).join(present.select(*on).distinct(), on, "left_anti").select(*new.columns)


def inside(folder: str, path: str) -> str:
    """The path below the folder; an error for one that leads out of it."""
    full = os.path.normpath(os.path.join(folder, path))
    if full != os.path.normpath(folder) and not full.startswith(os.path.normpath(folder) + os.sep):
        raise ValueError(f"{path} lies outside {folder}")
    return full
