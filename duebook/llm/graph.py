"""Connected components of an edge table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the least node reachable.

    Each round hooks every root to the least root next to its tree, then shortens all paths by
    half; both are joins, and the number of rounds grows with the logarithm of the longest path.
    Hot roots are pre-aggregated before the shuffle. A table in the shared folder ends each round.
    An empty edge table gives an empty result.
    """
    pairs = edges.select("a", "b").filter("a <> b")
    label = pairs.selectExpr("a AS node", "least(a, b) AS root").union(pairs.selectExpr("b AS node", "least(a, b) AS root"))
    label = keep(label.groupBy("node").agg(F.min("root").alias("root")), "labels")
    left = keep(pairs, "edges")
    for _ in range(rounds):
        # paths are shortened until every node names a root
        while True:
            up = label.select(F.col("node").alias("root"), F.col("root").alias("above"))
            label = keep(label.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "labels")
            moved = label.filter("moved").limit(1).count()
            label = label.select("node", "root")
            if not moved:
                break
        a = label.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = label.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = keep(left.join(a, "a").join(b, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
        if not left.limit(1).count():
            return label.withColumnRenamed("root", "component")
        hook = left.selectExpr("greatest(a, b) AS node", "least(a, b) AS root").groupBy("node").agg(F.min("root").alias("hooked"))
        label = label.join(hook, "node", "left").select("node", F.coalesce("hooked", "root").alias("root"))
        label = keep(label, "labels")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
