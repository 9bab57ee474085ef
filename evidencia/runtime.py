"""Session, tables and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "evidencia", cpus: str | int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use; a cluster passes its own session instead."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a folder of our own only where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="evidencia-checkpoint-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Compute df once, into the shared checkpoint folder, and go on from those files (they survive a lost executor)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't have yet, so that helper columns never clash with the caller's."""
    taken = {c.lower() for c in df.columns}
    name, n = wanted, 0
    while name.lower() in taken:
        n += 1
        name = f"{wanted}_{n}"
    return name


def col(df: DataFrame, name: str) -> Column:
    """df's column of exactly this name, whatever dots it holds."""
    return df["`" + name.replace("`", "``") + "`"]


def bounded_broadcast(df: DataFrame, rows: int, what: str) -> DataFrame:
    """Broadcast df after counting it: beyond `rows` rows it stays an ordinary join side."""
    n = df.limit(rows + 1).count()
    return F.broadcast(df) if n <= rows else df.hint("shuffle_hash")


def hash_sample(df: DataFrame, key: Column, n: int, spare: int = 8) -> DataFrame:
    """At most n rows of df, those of least key hash: the same rows however df is partitioned.

    Only rows under a hash bound that leaves about spare * n of them are put in order, so that tasks send a few rows
    each to the driver, whatever the size of df; filters that df applies after its scan may leave fewer than n.
    """
    h = free_name(df, "__h")
    hashed = df.withColumn(h, F.xxhash64(key))
    total = df.count()
    if total > spare * n:
        hashed = hashed.where(F.col(h) < -(2**63) + spare * n * 2**64 // total)
    return hashed.orderBy(h).limit(n).drop(h)
