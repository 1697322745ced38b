"""Connected components of an edge table by contraction, entirely in tables.

Every node hooks onto its least neighbour, hooks are shortened by following them, edges are rewritten to them, and what
has become one node falls away; a star is done in one round and any graph in about the logarithm of its size, chains of
rising numbers included. Nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: How often a round's hooks are followed; each time their reach doubles.
JUMPS = 2


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (u, v); root is some node of its component, the same for all of them.

    Loops and repeated edges do nothing; nodes without an edge to another node do not appear. Nodes can be of any type
    that has an order; rows with nulls are left out.
    """
    e = cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u is not null and v is not null and u != v").distinct())
    maps = []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p"))
        for _ in range(JUMPS):
            hook = cut(hook)
            hook = hook.join(hook.select(F.col("u").alias("p"), F.col("p").alias("pp")), "p").select("u", F.col("pp").alias("p"))
        hook = cut(hook)
        maps.append(hook)
        to_u, to_v = hook.select("u", F.col("p").alias("pu")), hook.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        moved = e.join(to_u, "u").join(to_v, "v").filter("pu != pv")
        e = cut(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
    if not maps:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = maps[0].select(F.col("u").alias("node"), F.col("p").alias("root"))
    # a hook may lie on another node of its round, which moves on in the next: follow all rounds in order
    for k, hook in enumerate(maps):
        if k:
            step = hook.select(F.col("u").alias("root"), "p")
            out = out.join(step, "root", "left").select("node", F.coalesce("p", "root").alias("root"))
    return out
