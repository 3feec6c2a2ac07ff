"""Connected components of an edge table, by rounds of smallest labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm import common


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each node's component, from rows of (a, b).

    Every round points each node at its smallest neighbour, follows the pointers to
    their ends and contracts the edges to these; what is left between different
    ends goes on to the next round. Each round is written to the shared folder;
    only flags come to the driver.
    """
    edges = common.materialize(edges.select("a", "b").distinct(), "edges")
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.toDF("node", "other").union(edges.select("b", "a"))
        roots = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("component"))
        roots = common.materialize(roots, "roots")
        while True:
            jump = roots.select(F.col("node").alias("component"), F.col("component").alias("next"))
            step = common.materialize(roots.join(jump, "component").select("node", F.col("next").alias("component"), (F.col("next") != F.col("component")).alias("moved")), "roots")
            roots = step.drop("moved")
            if step.filter("moved").isEmpty():
                break
        ends = roots.toDF("a", "ra")
        edges = edges.join(ends, "a").join(ends.toDF("b", "rb"), "b").filter(F.col("ra") != F.col("rb"))
        edges = common.materialize(edges.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
        if labels is None:
            labels = roots
        else:
            labels = labels.join(roots.toDF("component", "end"), "component", "left").select("node", F.coalesce("end", "component").alias("component"))
            labels = common.materialize(labels, "labels")
    return labels
