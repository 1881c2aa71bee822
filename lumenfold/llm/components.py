"""Connected components of a link table by label propagation with pointer jumping.

All state stays in DataFrames.  Every round takes the smallest label among a node's neighbours and then the
label of that label, so the labels of a chain of n links settle in about log n rounds.  Lineage is cut by a
checkpoint each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import checkpointed


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the smallest node reachable, for every node in a link.

    Links go both ways, may repeat and may join a node to itself; rows with a null end are not links.  No links, no rows.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = checkpointed(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("m"))
        near = labels.join(seen, labels["node"] == seen["u"]).select("node", F.least("label", "m").alias("next"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        moved = checkpointed(near.join(jump, F.col("next") == F.col("at"), "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"), "old"))
        changed = not moved.where("label <> old").isEmpty()
        labels = moved.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")


def starred(links: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect the same nodes, fewer where neighbours are linked to each other: of each node's smaller neighbours the least is linked to the others and to it.

    A node's links to smaller ones meet in one task, so no node should have more of them than a task can read.
    """
    u, v = F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")
    least = links.select(u, v).where("u <> v").distinct().withColumn("m", F.min("u").over(Window.partitionBy("v")))
    ends = F.array(F.struct(F.col("m").alias("a"), F.col("u").alias("b")), F.struct(F.col("m").alias("a"), F.col("v").alias("b")))
    return least.select(F.explode(ends).alias("e")).select("e.a", "e.b").where("a <> b").distinct()


def contracted_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """As :func:`components`, for links that are many for their nodes: each round joins nodes with their smallest neighbours and keeps links between the groups only."""
    u, v = F.least(a, b), F.greatest(a, b)
    edges = checkpointed(links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(u.alias("u"), v.alias("v")).distinct())
    labels = checkpointed(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("label", F.col("node")))
    edges = edges.where("u <> v")
    while not edges.isEmpty():
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e")).select("e.*")
        hook = checkpointed(ends.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("up")))
        parent = hook
        while True:  # up to the top: twice as far each time
            over = parent.select(F.col("x").alias("at"), F.col("up").alias("top"))
            jumped = checkpointed(parent.join(over, F.col("up") == F.col("at")).select("x", F.col("top").alias("up"), (F.col("top") < F.col("up")).alias("moved")))
            parent = jumped.select("x", "up")
            if jumped.where("moved").isEmpty():
                break
        of = lambda name: parent.select(F.col("x").alias(f"{name}x"), F.col("up").alias(f"{name}up"))
        moved = edges.join(of("u"), F.col("u") == F.col("ux")).join(of("v"), F.col("v") == F.col("vx"))
        fewer = checkpointed(moved.where("uup <> vup").select(F.least("uup", "vup").alias("u"), F.greatest("uup", "vup").alias("v")).distinct())
        labels = checkpointed(labels.join(of("l"), F.col("label") == F.col("lx"), "left").select("node", F.coalesce("lup", "label").alias("label")))
        edges = fewer
    return labels.withColumnRenamed("label", "component")
