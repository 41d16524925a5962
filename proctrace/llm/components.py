"""Connected components of a graph given as an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proctrace.llm.common import discard, stage


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root), root being the component's smallest node; nodes with edges only.

    Each round every node hooks to its smallest neighbour, chains are shortened by pointer
    jumping, and edges are redrawn between the roots. Rounds and jumps grow with the logarithm
    of the graph; what is counted on the driver is numbers of rows. A staged table goes when the
    next one is there.
    """
    edges = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "cc-edges")
    roots = None
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "cc-parent")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = parent.select("node", "root").join(up, "root", "left")
            jumped = stage(jumped.select("node", F.coalesce("top", "root").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "cc-jump")
            discard(parent)
            parent = jumped
            if not jumped.where("moved").limit(1).count():
                break
        left = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        redrawn = edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        redrawn = stage(redrawn, "cc-edges")
        discard(edges)
        edges = redrawn
        if roots is None:
            roots = parent
        else:
            step = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
            joined = stage(roots.select("node", "root").join(step, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "cc-roots")
            discard(roots, parent)
            roots = joined
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.select("node", "root")
