"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.sources import stage_table


def connected_components(edges: DataFrame, a: str, b: str, *, most: int = 500) -> DataFrame:
    """``node, component`` of every node of an edge, the component named by its least node.

    Alternates the large-star and small-star steps: each node hangs its larger neighbours on its least one, then
    itself and its smaller neighbours on the least. The graph after each round goes to the shared folder. No node's neighbours are
    gathered, only their minimum, so that a node with very many of them costs no task more than its share after partial aggregation. It ends when every edge leads from a node
    with one edge to a root, which is no node with an edge of its own: then no step changes anything. If that is not so after ``most`` rounds (the number grows with
    the logarithm of the nodes, squared at worst), it raises.
    """
    start = edges.selectExpr(f"cast(`{a}` as long) as u", f"cast(`{b}` as long) as v").where("u is not null and v is not null and u != v").distinct()
    now = stage_table(start, "edges")
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small_least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(small_least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        now = stage_table(small, "edges")
        if now.groupBy("u").count().where("count > 1").isEmpty() and now.join(now.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"the components have not come to rest after {most} rounds")
    top = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return top.unionByName(top.select(F.col("component").alias("node"), "component").distinct())
