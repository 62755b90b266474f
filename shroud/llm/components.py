"""Connected components by alternating large-star / small-star rounds.

``edges`` has two long columns ``a``, ``b``.  A star step is a grouped minimum
(combined map-side) joined back on the centre; a hot centre is one row on one
side of that join, so adaptive skew splitting can cut the other side.  Each
round is written to the shared folder, which cuts the lineage.  The result has
``node`` and ``component`` (smallest node reachable) for every node that has an
edge.  The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over directed edges (u, v): v of u's list is linked to the smallest of it."""
    if large:
        nbr = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = nbr.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = nbr.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        nbr = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = nbr.groupBy("u").agg(F.min("v").alias("m"))
        out = nbr.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Rows (node, component).  Self-loops, repeats and null ends are ignored."""
    e = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))
    e = e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = scratch.write(e, f"{name}-0")
    step, mark = 0, None
    while True:
        step += 1
        e = scratch.write(_star(_star(e, True), False), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        new = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if new == mark:
            break
        mark = new
    # at the fixpoint every edge leads from a node to its root
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
