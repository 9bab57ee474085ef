"""Problem 7: a mix of sources in target shares of the total size, small sources repeated up to a cap.

Every record gets a hash. Sizes are summed by source and hash bucket; a source's budget is met by all records whose
hash lies below a threshold, found in the bucket where the running sum crosses the budget. Only that bucket is looked
at again, in finer buckets, so a filter on the hash draws the records and nothing is sorted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import col, cut
from .tokenize import TOKENIZERS, count_tokens


@dataclass(frozen=True)
class Mix:
    """bits: of the hash, at each of `rounds` refinements; total: tokens of the mix, None for the most that all shares allow."""

    bits: int = 10
    rounds: int = 4
    total: int | None = None
    seed: int = 11


def source_name(source: Column) -> Column:
    """One spelling of a source: trimmed, small letters, hyphens and spaces as underscores."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(source)), r"[\s-]+", "_"), F.lit(""))


#: Targets, and sources, up to which they are broadcast; more are joined by a shuffle.
FEW = 10_000


def _near(wanted: DataFrame):
    """What joins a table with a row for each target: a broadcast up to FEW of them, else a shuffle."""
    return F.broadcast if wanted.limit(FEW + 1).count() <= FEW else lambda df: df


def targets_of(targets: DataFrame, sizes: DataFrame, mix: Mix) -> DataFrame:
    """(mix_name, source, share, whole, rest): how often each source is used in whole and the tokens of its last part.

    Shares of sources without any tokens fall to the others in proportion. The total is the given one, or the largest
    at which no source needs more repeats than allowed; where a given total needs more, a source stops at its cap.
    """
    wanted = targets.select("mix_name", source_name(F.col("source")).alias("source"), F.col("target_share").alias("share"), F.col("max_repeats").cast("long").alias("cap"))
    wanted = wanted.where("source is not null and share > 0 and cap > 0").join(sizes, "source").where("size > 0")
    all_ = Window.partitionBy("mix_name")
    share = F.col("share") / F.sum("share").over(all_)
    placed = wanted.withColumn("part", share).withColumn("total", F.min(F.col("size") * F.col("cap") / F.col("part")).over(all_) if mix.total is None else F.lit(float(mix.total)))
    budget = F.least(F.floor(F.col("part") * F.col("total")).cast("long"), F.col("size") * F.col("cap"))
    placed = placed.withColumn("budget", budget).withColumn("whole", F.expr("budget div size"))
    return placed.select("mix_name", "source", F.col("share").alias("target_share"), "cap", "whole", (F.col("budget") - F.col("whole") * F.col("size")).alias("rest"))


def thresholds(records: DataFrame, wanted: DataFrame, mix: Mix) -> DataFrame:
    """(mix_name, source, below): of each source, the records whose hash lies below `below` make up `rest` tokens.

    Nested histograms: each round sums only the records of the bucket in which the running sum crosses the budget.
    The last bucket goes in if that comes nearer to the budget. The table of thresholds has a row for each target.
    """
    near = _near(wanted)
    state = wanted.select("mix_name", "source", "rest", F.lit(0).cast("long").alias("low"))
    pool = records.join(near(wanted.select("mix_name", "source")), "source").select("mix_name", "source", "hash", "tokens")
    for r in range(mix.rounds):
        shift = 62 - mix.bits * (r + 1)
        width = 1 << shift
        inside = pool.join(near(state), ["mix_name", "source"]).where((F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + F.lit(1 << (shift + mix.bits))))
        if r == 1:
            # from the second round on only the records of the first boundary buckets are carried: few, so once is enough
            inside = cut(inside)
            pool = inside.select("mix_name", "source", "hash", "tokens")
        histogram = inside.groupBy("mix_name", "source", "low", "rest", F.shiftright(F.col("hash") - F.col("low"), shift).alias("bucket")).agg(F.sum("tokens").alias("t"))
        # at most 2**bits rows for each target
        running = F.sum("t").over(Window.partitionBy("mix_name", "source").orderBy("bucket"))
        crossing = histogram.withColumn("upto", running).where(F.col("upto") > F.col("rest")).groupBy("mix_name", "source").agg(F.min(F.struct("bucket", "upto", "t")).alias("x"))
        last = r == mix.rounds - 1
        after = F.col("rest") - (F.col("x.upto") - F.col("x.t"))
        take = F.when(F.lit(last) & (F.col("x.upto") - F.col("rest") < after), 1).otherwise(0) if last else F.lit(0)
        low = F.col("low") + (F.col("x.bucket") + take) * F.lit(width)
        # no bucket crosses: all that is left lies below
        state = state.join(crossing, ["mix_name", "source"], "left").select("mix_name", "source", F.when(F.col("x").isNull(), F.lit(0)).otherwise(after).cast("long").alias("rest"), F.coalesce(low, F.col("low") + F.lit(1 << (shift + mix.bits))).cast("long").alias("low"))
        state = cut(state)
    return state.select("mix_name", "source", F.col("low").alias("below"))


def mix_sources(df: DataFrame, targets: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> DataFrame:
    """(mix_name, key, source, tokens, repeats, target_share, share_reached) of the chosen records of every mix.

    Sizes are tokens of the public vocabulary. Records of null source, null and empty texts have no share and are never
    chosen; targets of sources that df doesn't have are left out; equal rows are records of their own.
    """
    names = targets.select(source_name(F.col("source")).alias("__source")).where("__source is not null").distinct()
    near = _near(names)
    # what no target names is left out before its tokens are counted
    asked = df.join(near(names), source_name(col(df, source)) == F.col("__source"), "left_semi")
    counted = count_tokens(asked, key, text, (source,), vocabulary, tokenizers)
    records = counted.select(F.col(f"`{key}`").alias("key"), source_name(F.col(f"`{source}`")).alias("source"), "tokens").where("source is not null and tokens > 0")
    records = cut(records.withColumn("hash", F.shiftrightunsigned(F.xxhash64(F.lit(mix.seed), "key", "source"), 2)))
    sizes = records.groupBy("source").agg(F.sum("tokens").alias("size"))
    wanted = cut(targets_of(targets, sizes, mix))
    near = _near(wanted)
    edge = thresholds(records, wanted, mix)
    plan = wanted.join(edge, ["mix_name", "source"])
    used = records.join(near(plan), "source").withColumn("repeats", (F.col("whole") + (F.col("hash") < F.col("below")).cast("long")).cast("int")).where("repeats > 0")
    used = used.select("mix_name", "key", "source", "tokens", "repeats", "target_share")
    share = used.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("t"))
    share = share.withColumn("share_reached", F.col("t") / F.sum("t").over(Window.partitionBy("mix_name"))).drop("t")
    return used.join(near(share), ["mix_name", "source"]).select("mix_name", F.col("key").alias(key), "source", "tokens", "repeats", "target_share", "share_reached")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, records, most_repeats, tokens, share_reached) for every target, reached or not."""
    got = mixed.groupBy("mix_name", "source").agg(F.count("*").alias("records"), F.max("repeats").alias("most_repeats"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("share_reached").alias("share_reached"))
    asked = targets.select("mix_name", source_name(F.col("source")).alias("source"), "target_share")
    zero = {"records": 0, "most_repeats": 0, "tokens": 0, "share_reached": 0.0}
    return asked.join(got, ["mix_name", "source"], "left").fillna(zero).select("mix_name", "source", "target_share", "records", "most_repeats", "tokens", "share_reached")
