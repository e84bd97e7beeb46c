"""Connected components by contraction, in joins that AQE can split.

In each round every node points at the smallest node among itself and its
neighbours; edges are then rewritten to those smaller nodes and the ones that
became loops fall away.  Each round is written to the shared folder, so lineage
stays short and a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.sources.staging import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node reachable.

    Edges with a null end and loops are ignored; an empty table gives no rows.
    """
    edges = stage(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
        parent = stage(
            both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")).toDF("a", "p"), "parent"
        )
        if labels is None:
            labels = parent.toDF("node", "component")
        else:
            # a root of the last round that has no edge left keeps its label
            moved = labels.join(parent, F.col("component") == F.col("a"), "left")
            labels = stage(
                moved.select("node", F.coalesce("p", "component").alias("component")), "labels"
            )
        to_a = parent.toDF("a", "pa")
        to_b = parent.toDF("b", "pb")
        edges = stage(
            edges.join(to_a, "a").join(to_b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
            .filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
            "edges",
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
