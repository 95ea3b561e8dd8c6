"""Connected components of a distributed graph by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """id and component (the smallest id reachable) of every end of the edges (a, b).

    In each round every node takes its smallest neighbour, if smaller than itself; the ends of all edges are replaced so,
    and edges that became loops vanish. Node and edge counts fall by a factor each round; nothing is collected.
    """
    both = edges.select("a", "b").where("a <> b")
    live = stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label: DataFrame | None = None
    for _ in range(rounds):
        least = stored(live.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("id"), F.least("a", "p").alias("p")), "least")
        up = least.select(F.col("id").alias("p"), F.col("p").alias("pp"))
        jumped = stored(least.join(up, "p", "left").select("id", F.coalesce("pp", "p").alias("p")), "jumped")
        if label is None:
            label = jumped.select("id", F.col("p").alias("component"))
        else:
            step = jumped.select(F.col("id").alias("component"), "p")
            label = label.join(step, "component", "left").select("id", F.coalesce("p", "component").alias("component"))
        label = stored(label, "labels")
        a, b = (jumped.select(F.col("id").alias(x), F.col("p").alias("p" + x)) for x in "ab")
        moved = live.where("a > b").join(a, "a").join(b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        # a node that others now stand for must stay tied to the node that stands for it
        ties = jumped.select(F.col("p").alias("id")).distinct().join(jumped, "id").select(F.col("id").alias("a"), F.col("p").alias("b"))
        one_way = moved.unionByName(ties).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        live = stored(one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
        if live.isEmpty():
            return label
    raise RuntimeError("the graph did not contract")
