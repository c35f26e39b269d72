"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.plans.scratch import drop_materialised, materialise


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """``edges(left, right)`` to ``(node, component)``; a component's id is its smallest node.

    Each round hooks every neighbour of a node to the smallest one near it (large star, then small star), so
    a chain of n nodes closes in O(log n) rounds and no node's neighbourhood is ever held in one row. Every
    round is written to the shared folder. Nodes in no edge are not listed; null ends and loops are ignored;
    an empty table gives an empty result.
    """
    e = (
        edges.select(F.col(left).alias("u"), F.col(right).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e = materialise(e, "edges")
    state = None
    for _ in range(max_rounds):
        # large star: the larger neighbours of u, and of u itself, move to the smallest of all
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the smaller neighbours of u, and u, move to the smallest
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lows, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        new = materialise(small, "edges")
        drop_materialised(e)
        e = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
    else:
        raise RuntimeError(f"components did not close in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
