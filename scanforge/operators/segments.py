"""Planes and clusters of point clouds."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanforge.operators.graph import components
from scanforge.operators.sample import draw, exact_sample
from scanforge.operators.spatial import AXES, cells, nearest_within
from scanforge.tables import join_on, written


def fit_plane(points: DataFrame, threshold: float, trials: int = 1000, seed: int = 42) -> tuple[float, float, float, float] | None:
    """(a, b, c, d) of the plane ax + by + cz + d = 0 with the most points within ``threshold``; None without three points off a line.

    Each trial's plane goes through three drawn points; one pass counts all trials' points.
    """
    drawn = exact_sample(points.select("point_id", "X", "Y", "Z"), 3 * trials, ["point_id"], seed).orderBy(draw(seed, "point_id"), "point_id").collect()  # three points a trial
    rng = np.random.default_rng(seed)
    planes = []
    for _ in range(trials if len(drawn) >= 3 else 0):
        p = np.array([[drawn[i][a] for a in "XYZ"] for i in rng.choice(len(drawn), 3, replace=False)])
        normal = np.cross(p[1] - p[0], p[2] - p[0])
        if (length := float(np.linalg.norm(normal))) > 1e-12:
            normal = normal / length
            planes.append((*map(float, normal), float(-normal @ p[0])))
    best, most = None, -1
    for at in range(0, len(planes), 200):  # wide aggregates, a few hundred trials at once
        some = planes[at : at + 200]
        row = points.agg(*[F.count_if(F.abs(F.col("X") * a + F.col("Y") * b + F.col("Z") * c + d) <= threshold).alias(f"n{k}") for k, (a, b, c, d) in enumerate(some)]).first()
        k = max(range(len(some)), key=lambda i: (row[f"n{i}"], -i))
        if row[f"n{k}"] > most:
            best, most = some[k], row[f"n{k}"]
    return best


def planes(points: DataFrame, n_planes: int, threshold: float, trials: int = 1000, seed: int = 42) -> DataFrame:
    """``points`` with ``plane``: 1 for those on the largest plane, 2 on the largest of the rest, and so on; 0 for no plane."""
    label = F.lit(0)
    left = F.lit(True)
    for k in range(n_planes):
        found = fit_plane(points.where(left), threshold, trials, seed + k)
        if found is None:
            break
        a, b, c, d = found
        near = F.abs(F.col("X") * a + F.col("Y") * b + F.col("Z") * c + d) <= threshold
        label = F.when(left & near & (label == 0), F.lit(k + 1)).otherwise(label)
        left = left & ~near
    return points.withColumn("plane", label)


def clusters(points: DataFrame, eps: float, least: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """``points`` with ``cluster``, the least point_id of the core points linked within ``eps``; -1 for noise.  Scans (``by``) have clusters of their own.

    A core point has ``least`` points within ``eps``, itself included; another point within ``eps`` of a core joins the
    cluster of the nearest one (the smaller id on a tie).

    No list of all pairs: each point brings its ``least`` nearest from its tile.  The cores of a cell with a diagonal of ``eps`` are one
    cluster; links to near ones join most cells.  What is left are neighbouring cells of different clusters: their cores' boxes settle most
    of them, and only cores near the other box are compared.
    """
    keys, node = [*by, "point_id"], F.struct(*by, "point_id")
    near = written(nearest_within(points, least, eps, by).select(*keys, "nbr_id", "dist"), "cluster-near")
    core = near.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    cell, side = [f"_c{a}" for a in AXES], eps / math.sqrt(3) * (1 - 1e-9)
    cores = written(join_on(points.select(*keys, *AXES, *cells(side)), core, keys, "left_semi").withColumn("node", node), "cluster-cores")
    ids = cores.select(*keys)
    firsts = cores.groupBy(*by, *cell).agg(F.min("point_id").alias("_first"))
    in_cell = join_on(cores, firsts, [*by, *cell]).select("node", F.struct(*by, F.col("_first").alias("point_id")).alias("other"))
    to_near = join_on(join_on(near, ids, keys, "left_semi"), ids.withColumnRenamed("point_id", "nbr_id"), [*by, "nbr_id"], "left_semi")
    to_near = to_near.select(node.alias("node"), F.struct(*by, F.col("nbr_id").alias("point_id")).alias("other"))
    pairs = in_cell.unionByName(to_near).where("node <> other")
    roots = components(pairs.select(F.col("node").alias("a"), F.col("other").alias("b")))
    cores = written(cores.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "cluster-roots")
    bridges = components(_bridges(cores, eps, by, cell)).select(F.col("node").alias("root"), F.col("root").alias("to"))
    cores = written(cores.join(bridges, "root", "left").select(*keys, F.coalesce("to", "root")["point_id"].alias("cluster")), "cluster-cores")
    edge = join_on(join_on(near, ids, keys, "left_anti"), ids.withColumnRenamed("point_id", "nbr_id"), [*by, "nbr_id"], "left_semi")
    best = edge.groupBy(*keys).agg(F.min_by("nbr_id", F.struct("dist", "nbr_id")).alias("nbr_id"))
    joined = join_on(best, cores.withColumnRenamed("point_id", "nbr_id"), [*by, "nbr_id"]).select(*keys, "cluster")
    return join_on(points, cores.unionByName(joined), keys, "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1).cast("long")))


def _bridges(cores: DataFrame, eps: float, by: tuple[str, ...], cell: list[str]) -> DataFrame:
    """(a, b): roots of cores within ``eps`` of each other in neighbouring cells."""
    boxes = cores.groupBy(*by, *cell).agg(F.first("root").alias("root"), *[fn(a).alias(f"{k}{a}") for a in AXES for k, fn in (("lo", F.min), ("hi", F.max))])
    boxes = written(boxes, "cluster-boxes")  # a cell's cores have one root
    far = range(-2, 3)
    after = [(i, j, k) for i in far for j in far for k in far if (i, j, k) > (0, 0, 0)]
    moved = boxes.withColumn("_o", F.explode(F.array(*[F.struct(*[F.lit(v).alias(a) for a, v in zip(AXES, o, strict=True)]) for o in after])))
    moved = moved.select(*by, *[(F.col(f"_c{a}") + F.col(f"_o.{a}")).alias(f"_c{a}") for a in AXES], *[F.col(f"_c{a}").alias(f"_a{a}") for a in AXES], F.col("root").alias("a"), *[F.col(f"{k}{a}").alias(f"a{k}{a}") for a in AXES for k in ("lo", "hi")])
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"lo{a}") - F.col(f"ahi{a}"), F.col(f"alo{a}") - F.col(f"hi{a}")), 2) for a in AXES), F.lit(0.0))
    span = sum((F.pow(F.greatest(F.col(f"hi{a}") - F.col(f"alo{a}"), F.col(f"ahi{a}") - F.col(f"lo{a}")), 2) for a in AXES), F.lit(0.0))
    close = join_on(moved, boxes, [*by, *cell]).where(F.col("a") != F.col("root")).withColumn("gap", F.sqrt(gap)).where(F.col("gap") <= eps * (1 + 1e-9))
    close = written(close.withColumn("sure", F.sqrt(span) <= eps * (1 - 1e-9)), "cluster-cells")
    asked = close.where("not sure")
    # of either cell only the cores near the other's box
    x = cores.select(*by, *[F.col(f"_c{a}").alias(f"_a{a}") for a in AXES], *[F.col(a).alias(f"x{a}") for a in AXES])
    y = cores.select(*by, *cell, *[F.col(a).alias(f"y{a}") for a in AXES])
    reach = lambda p, lo, hi: sum((F.pow(F.greatest(F.lit(0.0), F.col(f"{lo}{a}") - F.col(f"{p}{a}"), F.col(f"{p}{a}") - F.col(f"{hi}{a}")), 2) for a in AXES), F.lit(0.0)) <= eps * eps * (1 + 1e-6)
    left = join_on(asked, x, [*by, *[f"_a{a}" for a in AXES]]).where(reach("x", "lo", "hi"))
    both = join_on(left, y, [*by, *cell]).where(reach("y", "alo", "ahi"))
    deltas = [F.col(f"x{a}") - F.col(f"y{a}") for a in AXES]
    met = both.where(F.sqrt(deltas[0] * deltas[0] + deltas[1] * deltas[1] + deltas[2] * deltas[2]) <= eps)
    return close.where("sure").select("a", F.col("root").alias("b")).unionByName(met.select("a", F.col("root").alias("b"))).distinct()
