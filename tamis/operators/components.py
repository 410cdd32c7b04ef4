"""Connected components by contraction, in logarithmically many rounds whatever the graph.

Every node picks one neighbour, the least in an order that is new (and as good as random) in each round.  A cycle of picks
has two nodes: if x picked y, then y's pick comes no later than x in the order, and so on around.  The earlier of the
two is the root of a tree, and each tree becomes one node of the next round.  A tree has two nodes at least, so a round
leaves half of the nodes at most: a graph of n nodes settles within log2(n) rounds.  A tree's nodes find its root by
doubling their reach, within log2 of its depth, which is small as the order is random.

All steps are sums by key, combined before they are shuffled, and equi-joins that adaptive execution can split where one node
is a hub.  Graphs shrink by half or more, so all rounds together cost a few times the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.operators.storage import stored

Keep = Callable[[DataFrame], DataFrame]


def _picks(edges: DataFrame, turn: int) -> DataFrame:
    """a, to: the pick of each node of edges (a < b)."""
    key = lambda x: F.struct(F.xxhash64(x, F.lit(turn)).alias("h"), F.col(x).alias("id"))
    ends = edges.select("a", key("b").alias("near")).unionAll(edges.select(F.col("b").alias("a"), key("a").alias("near")))
    return ends.groupBy("a").agg(F.min("near").alias("near")).select("a", F.col("near.id").alias("to"))


def _trees(picks: DataFrame, turn: int, keep: Keep) -> DataFrame:
    """a, root of each node."""
    place = lambda x: F.struct(F.xxhash64(x, F.lit(turn)), F.col(x))
    back = picks.select(F.col("a").alias("to"), F.col("to").alias("back"))
    up = picks.join(back, "to").select("a", F.when((F.col("back") == F.col("a")) & (place("a") < place("to")), F.col("a")).otherwise(F.col("to")).alias("root"))
    up = keep(up)
    while True:
        # twice as far at each join; two joins before anyone looks whether that changed anything
        for last in (False, True):
            further = up.select(F.col("a").alias("root"), F.col("root").alias("next"))
            up = up.join(further, "root").select("a", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
            if not last:
                up = up.drop("moved")
        up = keep(up)
        if not up.where("moved").limit(1).count():
            return up.drop("moved")


def components(edges: DataFrame, left: str = "a", right: str = "b", keep: Keep = stored) -> DataFrame:
    """node, root (the smallest node) of all nodes of edges (left, right), which may repeat and have either direction.

    An edge with a null end joins nothing; one from a node to itself only names it.  keep writes a table that is read several times.
    """
    pairs = edges.select(F.col(left).alias("x"), F.col(right).alias("y")).where("x is not null and y is not null")
    named = keep(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    now, levels = named.where("a <> b"), []
    while now.limit(1).count():
        turn = len(levels)
        levels.append(_trees(keep(_picks(now, turn)), turn, keep))
        of = lambda x, r, tree=levels[-1]: tree.select(F.col("a").alias(x), F.col("root").alias(r))
        moved = now.join(of("a", "p"), "a").join(of("b", "q"), "b").where("p <> q")
        now = keep(moved.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
    alone = named.where("a = b").select(F.col("a").alias("node"))
    if not levels:
        return alone.select("node", F.col("node").alias("root"))
    # from the last round back to the first: where each root of a round has ended
    end = levels.pop()
    while levels:
        tree = levels.pop()
        end = keep(tree.join(end.select(F.col("a").alias("root"), F.col("root").alias("end")), "root", "left").select("a", F.coalesce("end", "root").alias("root")))
    least = end.groupBy("root").agg(F.min("a").alias("least"))
    found = end.join(least, "root").select(F.col("a").alias("node"), F.col("least").alias("root"))
    only = alone.join(found, "node", "left_anti").select("node", F.col("node").alias("root"))
    return found.unionByName(only)


def with_others(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """labels and, as components of their own, the nodes (one column) without edges."""
    name: Column = F.col("node")
    return nodes.toDF("node").distinct().join(labels, "node", "left").select("node", F.coalesce("root", name).alias("root"))
