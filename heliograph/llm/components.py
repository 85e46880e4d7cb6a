"""Connected components of an edge list by contraction: every round is a saved table, and the next one has only what it left apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, label) of each vertex of edges (a, b): label is the least vertex of its component; loops and repeated edges don't matter.

    A round names each vertex after the least one of its neighbourhood, then after that one's name, and renames the edges.
    Edges within one name go, equal ones become one, so each round runs over fewer. Names are put together at the end. A hub is
    a group that is aggregated in parts first; joins run between saved tables, so Spark can split them.
    """
    left = saved(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    named = []
    while not left.isEmpty():
        if len(named) == rounds:
            raise RuntimeError(f"edges are left after {rounds} rounds")
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = saved(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("up")), "cc-near")
        above = near.select(F.col("v").alias("x"), F.col("up").alias("label"))
        names = saved(near.join(above, near.up == above.x).select("v", "label"), "cc-names")
        one, other = (names.select(F.col("v").alias(s), F.col("label").alias(f"n{s}")) for s in "ab")
        renamed = left.join(one, "a").join(other, "b").filter("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct()
        renamed = saved(renamed, "cc-edges")
        discard(left)
        discard(near)
        left = renamed
        named.append(names)
    if not named:
        return left.select(F.col("a").alias("v"), F.col("b").alias("label"))
    out = named[-1]
    for names in named[-2::-1]:
        later = out.select(F.col("v").alias("x"), F.col("label").alias("next"))
        out = saved(names.join(later, names.label == later.x, "left").select("v", F.coalesce("next", "label").alias("label")), "cc-labels")
    return out
