"""Connected components by alternating large-star and small-star rounds over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scriptorium.llm.common import cut, drop_checkpoint

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round: every vertex points its neighbours (larger ones, or smaller ones and itself) to the least."""
    if large:
        around = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = around.join(least, "u")
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): every id of the pairs and the least id it is connected to.

    Both stars only aggregate by minimum and re-point edges, so no component is ever gathered in one task, and a hub
    is pre-aggregated before its shuffle. Self loops and null ends are ignored; without pairs the result is empty.
    """
    edges = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        following = cut(_star(_star(edges, True), False))
        moved = following.exceptAll(edges).limit(1).count() + edges.exceptAll(following).limit(1).count()
        drop_checkpoint(edges)
        edges = following
        if not moved:
            break
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots).distinct()
