"""Connected components of edge tables by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanforge.tables import drop, written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in a link (a, b); roots are least nodes.  Each round is two joins on narrow rows."""
    edges = written(links.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u <> v").distinct(), "stars")
    for _ in range(most_rounds):
        ends = edges.selectExpr("u AS node", "1 AS up", "0 AS down").unionByName(edges.selectExpr("v AS node", "0 AS up", "1 AS down"))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty():
            break  # every node is a root or hangs from one
        # large star: a node's larger neighbours go to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(both.where("v > u").join(least, "u").selectExpr("v AS u", "m AS v").where("u <> v").distinct(), "stars")
        drop(edges)
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("v AS u", "m AS v").where("u <> v").unionByName(least.selectExpr("u", "m AS v"))
        edges = written(small.distinct(), "stars")
        drop(large)
    else:
        raise RuntimeError(f"components are not stars after {most_rounds} rounds")
    roots = edges.selectExpr("u AS node", "v AS root")
    return roots.unionByName(edges.selectExpr("v AS node", "v AS root").distinct())
