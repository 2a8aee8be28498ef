"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.runtime import cut


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Alternates large-star and small-star rewrites until the edge set is a forest
    of stars. Every rewrite is aggregations and equi-joins on nodes; each round
    is checkpointed in the shared folder, so lineage stays short. Null ends are
    not edges; self-loops give a component of their own. The number of rounds
    grows with the logarithm of the longest path; ``rounds`` only guards
    against a fault in the data, and passing it raises.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node"))
    # each edge points from the larger to the smaller end
    state = cut(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    n = state.count()
    for _ in range(rounds):
        # large star: each node links its larger neighbours to the smallest one it knows
        both = state.select("u", "v").unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each node links its smaller neighbours and itself to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rewired = large.join(least, "u")
        new = rewired.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(rewired.select("u", F.col("m").alias("v"))).distinct()
        new = cut(new)
        # a forest of stars: one parent per node, and no parent has one itself
        before, n = n, new.count()
        stable = n == before and new.join(state, ["u", "v"], "left_anti").isEmpty()
        state = new
        if stable:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = state.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.distinct().join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
