"""Connected components by repeated joins, for links that no single task may hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node of each component; nodes are those of the edges.

    Each round sends every node's least known label over its links and then jumps to that label's own label, so long
    chains end in a logarithm of their length. Each round is cut into the shared checkpoint folder; nothing is
    collected but one count. Null ends are left out; an empty input gives an empty result.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y").distinct()
    both = cut(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))))
    label = cut(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("component")))
    for _ in range(rounds):
        least = both.join(label.select(F.col("node").alias("y"), "component"), "y").groupBy("x").agg(F.min("component").alias("m"))
        hooked = label.join(least.withColumnRenamed("x", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("near"))
        jumped = hooked.join(label.select(F.col("node").alias("near"), F.col("component").alias("far")), "near", "left")
        new = cut(jumped.select("node", "old", F.least("near", F.coalesce("far", "near")).alias("component")))
        changed = new.where("component <> old").limit(1).count()
        label = new.select("node", "component")
        if not changed:
            return label
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
