"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.session import merged, persist_table


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) of all nodes with an edge ``a``, ``b``.

    Each step is a grouped minimum and a join on the same key: no group is gathered in one task, and Spark splits
    a skewed key of the join. The edges of a step are written to the shared folder, which cuts the lineage. Repeated
    edges, both directions of one, and edges from a node to itself change nothing; a node whose only edges lead to itself
    is left out, as are edges with a null end. No edges give no rows.
    """
    ours = persist_table(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = ours.union(ours.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(merged(low), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = persist_table(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(merged(least), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ours = persist_table(rest.union(least).filter("u <> v").distinct(), "small-star")
        # done when only stars are left: no node has two edges down, none has edges both ways
        ends = ours.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(ours.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down + up > 1 and down > 0").isEmpty():
            break
    roots = ours.select(F.col("v").alias("node")).distinct()
    return ours.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots.select("node", F.col("node").alias("label")))
