"""Consistent normals along a minimum spanning forest of the neighbour graph.

An edge between neighbours weighs 1 - |cos| of their normals; along the forest each normal is turned to the side of
its tree neighbour, so orientation spreads over flat parts first and crosses edges of the surface last.

The forest comes from Boruvka rounds.  Each round every component picks its lightest edge out (ties by the points' ids, so picks
never form a cycle but a mutual pair), components hang from the one they picked, pointer doubling brings
each to its root with the parity of turns on the way, and the graph shrinks to one edge between any two components left.  So there are
about log n rounds, each a few equi-joins of narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanforge.tables import drop, join_groups, join_on, written

NORMAL = ("nx", "ny", "nz")


def _differ(a: Column, b: Column) -> Column:
    """Exclusive or."""
    return a != b


def spanning_parities(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, root, turned) of every node in an edge (a, b, w, turn): the parity of ``turn`` along the forest's path to the root of its tree."""
    graph = edges.select("a", "b", F.struct("w", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).alias("key"), "turn").where("a <> b")
    graph = written(graph, "forest-edges")
    state = written(graph.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root"), F.lit(False).alias("turned")), "forest-nodes")
    for _ in range(most_rounds):
        if graph.isEmpty():
            return state
        both = graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "key", "turn"))
        picked = written(both.groupBy("a").agg(F.min_by(F.struct("b", "turn"), "key").alias("p")).select("a", "p.b", "p.turn"), "forest-picks")
        back = picked.select(F.col("a").alias("x"), F.col("b").alias("y"))
        mutual = picked.join(back, (F.col("b") == F.col("x")) & (F.col("a") == F.col("y")) & (F.col("a") < F.col("b")), "left_semi").select(F.col("a").alias("r"))
        hung = picked.join(mutual, F.col("a") == F.col("r"), "left")
        top = F.col("r").isNotNull()  # the smaller of a pair that picked each other is a root
        hung = written(hung.select("a", F.when(top, F.col("a")).otherwise(F.col("b")).alias("b"), F.when(top, False).otherwise(F.col("turn")).alias("turn")), "forest-hung")
        while True:
            above = hung.select(F.col("a").alias("x"), F.col("b").alias("up"), F.col("turn").alias("up_turn"))
            raised = hung.join(above, F.col("b") == F.col("x")).select("a", F.col("up").alias("b"), _differ(F.col("turn"), F.col("up_turn")).alias("turn"), (F.col("up") != F.col("b")).alias("moved"))
            raised = written(raised, "forest-hung")
            drop(hung)
            hung = raised
            if hung.where("moved").isEmpty():
                break
        to = hung.select(F.col("a").alias("root"), F.col("b").alias("to"), F.col("turn").alias("to_turn"))
        moved = written(state.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root"), _differ(F.col("turned"), F.coalesce("to_turn", F.lit(False))).alias("turned")), "forest-nodes")
        ends = graph
        for end in ("a", "b"):
            ends = ends.join(to.withColumnRenamed("root", end), end).withColumn("turn", _differ(F.col("turn"), F.col("to_turn"))).withColumn(end, F.col("to")).drop("to", "to_turn")
        ends = ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "key", "turn")
        smaller = written(ends.groupBy("a", "b").agg(F.min_by(F.struct("key", "turn"), "key").alias("e")).select("a", "b", "e.key", "e.turn"), "forest-edges")
        drop(graph, state, picked, hung)
        graph, state = smaller, moved
    raise RuntimeError(f"the forest has more than {most_rounds} rounds")


def along_forest(normals: DataFrame, neighbours: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``normals`` (by.., point_id, X, Y, Z, nx, ny, nz) turned alike along the minimum spanning forest of ``neighbours`` (by.., point_id, nbr_id).

    The highest point of each tree (the smaller id on a tie) looks up; a point without neighbours does, too.
    """
    keys, node = [*by, "point_id"], F.struct(*by, "point_id")
    own = written(normals.select(*keys, "Z", *NORMAL), "forest-normals")
    # each pair once, as it may be listed by either point
    pairs = neighbours.where("point_id <> nbr_id").select(*by, F.least("point_id", "nbr_id").alias("point_id"), F.greatest("point_id", "nbr_id").alias("nbr_id")).distinct()
    other = own.select(*by, F.col("point_id").alias("nbr_id"), *[F.col(n).alias(f"o{n}") for n in NORMAL])
    met = join_on(join_on(pairs, own, keys), other, [*by, "nbr_id"])
    cosine = F.col("nx") * F.col("onx") + F.col("ny") * F.col("ony") + F.col("nz") * F.col("onz")
    edges = met.select(node.alias("a"), F.struct(*by, F.col("nbr_id").alias("point_id")).alias("b"), (1 - F.abs(cosine)).alias("w"), (cosine < 0).alias("turn")).where("w is not null")
    trees = spanning_parities(edges)
    placed = own.withColumn("node", node).join(trees, "node", "left").select(*keys, F.coalesce("root", "node").alias("root"), F.coalesce("turned", F.lit(False)).alias("turned"), "Z", "nz")
    looks_down = _differ(F.col("nz") < 0, F.col("turned"))
    seeds = placed.groupBy("root").agg(F.max_by(looks_down, F.struct("Z", -F.col("point_id"))).alias("flip"))
    signs = join_groups(placed, seeds, ["root"], nulls=False).select(*keys, _differ(F.col("turned"), F.coalesce("flip", F.lit(False))).alias("_turn"))
    return join_on(normals, signs, keys).withColumns({n: F.when(F.col("_turn"), -F.col(n)).otherwise(F.col(n)) for n in NORMAL}).drop("_turn")
