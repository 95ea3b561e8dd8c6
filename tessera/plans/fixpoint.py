"""Set-valued fixed points by semi-naive iteration: only what the last round added is joined again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import kept


#: Rounds whose tables are read one by one before they are put together.
COMPACT = 16


def fixpoint(base: DataFrame, step: Callable[[DataFrame], DataFrame], limit: int = 10_000) -> DataFrame:
    """The least set that holds base and step(of itself). step takes the newly found rows and returns rows of base's
    columns; it must be monotone. Nulls count as equal."""
    columns = base.columns
    found = kept(base.distinct())
    delta = found
    for n in range(limit):
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in columns]
        on = same[0]
        for s in same[1:]:
            on &= s
        new = step(delta).select(columns).distinct().alias("n").join(found.alias("o"), on, "left_anti")
        delta = kept(new)
        if delta.isEmpty():
            return found
        found = found.unionByName(delta)
        if (n + 1) % COMPACT == 0:  # one table again, so that plans do not grow with the rounds
            found = kept(found)
    raise RuntimeError(f"no fixed point within {limit} rounds")


def reachable(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """All (src, dst) such that dst can be reached from src over edges(src, dst), each start itself included. Cycles are
    no matter; no path is enumerated."""
    starts = edges.select("src").union(edges.select("dst")).distinct() if starts is None else starts.select(F.col(starts.columns[0]).alias("src")).distinct()
    base = starts.select("src", F.col("src").alias("dst"))
    hop = edges.select(F.col("src").alias("dst"), F.col("dst").alias("next")).distinct()
    return fixpoint(base, lambda delta: delta.join(hop, "dst").select("src", F.col("next").alias("dst")))
