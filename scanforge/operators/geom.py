"""Neighbourhood geometry: covariance, closed-form eigenvalues, features, normals, batching keys."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanforge.functions import geometry as g
from scanforge.operators.orient import along_forest
from scanforge.operators.points import with_stats
from scanforge.operators.spatial import hybrid_neighbours, neighbour_covariances
from scanforge.tables import join_on, written


def covariances(edges: DataFrame, by: tuple[str, ...] = (), ddof: int = 1) -> DataFrame:
    """n and the six covariances of each point's neighbours, from differences to the point: one partial aggregate."""
    fn = F.covar_samp if ddof else F.covar_pop
    pairs = (("cxx", "dX", "dX"), ("cyy", "dY", "dY"), ("czz", "dZ", "dZ"), ("cxy", "dX", "dY"), ("cyz", "dY", "dZ"), ("cxz", "dX", "dZ"))
    return edges.groupBy(*by, "point_id").agg(F.count("*").alias("n_nbrs"), *[fn(a, b).alias(n) for n, a, b in pairs])


def eigen_features(cov: DataFrame, fill: bool = True) -> DataFrame:
    """curvature, anisotropy, planarity, roughness (root of the largest eigenvalue) and roughness_plane (of the smallest).

    With ``fill`` missing curvature, anisotropy and planarity are 0.
    """
    c = [F.col(n) for n in ("cxx", "cyy", "czz", "cxy", "cyz", "cxz")]
    low, mid, top = g.eigenvalues(*c)
    df = cov.withColumns({"l1": low, "l2": mid, "l3": top})
    width = F.greatest(F.col("l3"), F.lit(1e-9))
    made = {
        "curvature": F.col("l1") / F.nullif(F.col("l1") + F.col("l2") + F.col("l3"), F.lit(0.0)),
        "anisotropy": (F.col("l3") - F.col("l2")) / width,
        "planarity": (F.col("l2") - F.col("l1")) / width,
    }
    if fill:
        made = {k: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)) for k, v in made.items()}
    return df.withColumns(made | {"roughness": F.sqrt(F.greatest("l3", F.lit(0.0))), "roughness_plane": F.sqrt(F.greatest("l1", F.lit(0.0)))})


def normals(features: DataFrame, points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """nx, ny, nz: the direction of least spread, turned towards the origin."""
    df = features.join(points.select(*by, "point_id", "X", "Y", "Z"), [*by, "point_id"])
    c = [F.col(n) for n in ("cxx", "cyy", "czz", "cxy", "cyz", "cxz")]
    vector = g.smallest_eigenvector(*c, F.col("l1"))
    df = df.withColumns(dict(zip(("_nx", "_ny", "_nz"), vector, strict=True)))
    away = F.col("_nx") * F.col("X") + F.col("_ny") * F.col("Y") + F.col("_nz") * F.col("Z") > 0
    return df.withColumns({n: F.when(away, -F.col(f"_{n}")).otherwise(F.col(f"_{n}")) for n in ("nx", "ny", "nz")}).drop("_nx", "_ny", "_nz", "X", "Y", "Z")


def geometric_features(points: DataFrame, base_radius: float = 0.05, max_radius: float = 0.2, max_neighbours: int = 50, by: tuple[str, ...] = ()) -> DataFrame:
    """All features and normals of every point; tiles carry a halo, so there are no batch borders."""
    return normals(eigen_features(neighbour_covariances(points, base_radius, max_radius, max_neighbours, by=by)), points, by)


def hybrid_features(points: DataFrame, radius: float = 0.03, max_neighbours: int = 30, by: tuple[str, ...] = (), least: float = 1e-10) -> DataFrame:
    """Curvature, anisotropy and planarity of an older search: the point itself left out, at least three neighbours or the nearest ten; 0 where the largest eigenvalue is below ``least``."""
    features = eigen_features(covariances(hybrid_neighbours(points, radius, max_neighbours, by=by), by))
    flat = (F.col("l3") <= least) | (F.col("n_nbrs") < 3)
    return features.withColumns({c: F.when(flat, 0.0).otherwise(F.col(c)) for c in ("curvature", "anisotropy", "planarity")})


def hybrid_normals(points: DataFrame, radius: float = 0.1, max_neighbours: int = 30, by: tuple[str, ...] = (), orient: str = "origin") -> DataFrame:
    """by.., point_id, nx, ny, nz of the nearest ``max_neighbours`` within a radius, the point itself included.

    ``orient``: "origin" turns each normal towards the origin, so any layout of the data gives the same signs; "forest" turns
    neighbours alike along a minimum spanning forest of the neighbour graph (see ``orient.along_forest``).
    """
    edges = hybrid_neighbours(points, radius, max_neighbours, least=2, by=by, include_self=True)
    if orient == "forest":
        edges = written(edges, "hybrid-edges")
    made = normals(eigen_features(covariances(edges, by)), points, by).select(*by, "point_id", "nx", "ny", "nz")
    if orient != "forest":
        return made
    placed = join_on(made, points.select(*by, "point_id", "X", "Y", "Z"), [*by, "point_id"])
    return along_forest(placed, edges, by).select(*by, "point_id", "nx", "ny", "nz")


def population_features(points: DataFrame, radius: float = 0.05, max_radius: float = 0.2, max_neighbours: int = 50, by: tuple[str, ...] = ()) -> DataFrame:
    """Features whose covariances are divided by the number of neighbours, as another older variant has them."""
    return eigen_features(neighbour_covariances(points, radius, max_radius, max_neighbours, by=by, ddof=0))


def roughness(points: DataFrame, radius: float = 0.05, max_neighbours: int = 30, by: tuple[str, ...] = ()) -> DataFrame:
    return eigen_features(neighbour_covariances(points, radius, max(radius, 0.2), max_neighbours, by=by), fill=False).select(*by, "point_id", "roughness")


def spatial_batches(df: DataFrame, per_batch: int, most: int = 12_000, by: tuple[str, ...] = ()) -> DataFrame:
    """batch_x, batch_y, batch_z: half-open bins of a grid divided in proportion to the scan's extents; batch_path: the bins of further splits.

    Batches of more than ``most`` points are divided again, level by level, until only points within 1e-6 share a larger one.
    Where the scaling leaves such a batch whole, its widest axis is halved.
    """
    df = df.withColumn("_batch", F.array().cast("array<int>"))
    level = 0
    while True:
        boxes = df.groupBy(*by, "_batch").agg(F.count("*").alias("_n"), *[(F.max(a) - F.min(a)).alias(f"_r{a}") for a in "XYZ"], *[F.min(a).alias(f"_m{a}") for a in "XYZ"])
        total = F.col("_rX") + F.col("_rY") + F.col("_rZ")
        if level:
            boxes = boxes.where((F.col("_n") > most) & (F.greatest("_rX", "_rY", "_rZ") > 1e-6))
        boxes = boxes.withColumn("_target", F.ceil(F.col("_n") / (max(1, most // 2) if level else per_batch)))
        base = F.greatest(F.lit(1), F.ceil(F.pow("_target", F.lit(1 / 3))))
        boxes = boxes.withColumns({f"_d{a}": F.coalesce(F.greatest(F.lit(1), F.ceil(base * (F.col(f"_r{a}") / F.nullif(total, F.lit(0.0))) * 3)), F.lit(1)) for a in "XYZ"})
        whole = F.col("_dX") * F.col("_dY") * F.col("_dZ")
        scale = F.when(whole > 2 * F.col("_target"), F.pow(2 * F.col("_target") / whole, F.lit(1 / 3))).otherwise(1.0)
        boxes = boxes.withColumns({f"_d{a}": F.greatest(F.lit(1), F.floor(F.col(f"_d{a}") * scale)) for a in "XYZ"})
        if level:
            widest = F.greatest("_rX", "_rY", "_rZ")
            kept = F.greatest("_dX", "_dY", "_dZ") > 1
            boxes = boxes.withColumns({f"_d{a}": F.when(kept | (F.col(f"_r{a}") < widest), F.col(f"_d{a}")).otherwise(2) for a in "XYZ"})
        boxes = written(boxes, "batch-boxes")
        if level and boxes.isEmpty():
            break
        bins = [F.floor((F.col(a) - F.col(f"_m{a}")) / ((F.col(f"_r{a}") + 1e-6) / F.col(f"_d{a}"))).cast("int") for a in "XYZ"]
        cell = F.when(F.col("_n").isNotNull(), F.concat("_batch", F.array(*bins))).otherwise(F.col("_batch"))
        df = written(join_on(df, boxes, [*by, "_batch"], "left").withColumn("_batch", cell).select(*df.columns), "batches")
        level += 1
    made = {f"batch_{a}": F.get("_batch", F.lit(k)) for k, a in enumerate("xyz")}
    return df.withColumns(made | {"batch_path": F.slice("_batch", F.lit(4), F.greatest(F.size("_batch") - 3, F.lit(0)))}).drop("_batch")


def angular_batches(df: DataFrame, n_azimuth: int, n_elevation: int, by: tuple[str, ...] = ()) -> DataFrame:
    """batch_az, batch_el: right-closed equal-width bins of the scan's extents; the lowest value falls in the first."""
    df = with_stats(df, by, _a0=F.min("azimuth"), _a1=F.max("azimuth"), _e0=F.min("elevation"), _e1=F.max("elevation"))
    closed = lambda v, lo, hi, k: F.greatest(F.ceil((F.col(v) - F.col(lo)) / F.nullif((F.col(hi) - F.col(lo)) / k, F.lit(0.0))) - 1, F.lit(0)).cast("int")
    return df.withColumns({"batch_az": closed("azimuth", "_a0", "_a1", n_azimuth), "batch_el": closed("elevation", "_e0", "_e1", n_elevation)}).drop("_a0", "_a1", "_e0", "_e1")


def convex_hull(df: DataFrame) -> list[tuple[float, float]]:
    """Planar hull: hulls of Arrow batches in the executors, then the hull of their corners."""
    import pandas as pd

    def chain(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
        points = sorted(set(points))
        half: list[list[tuple[float, float]]] = []
        for run in (points, points[::-1]):
            out: list[tuple[float, float]] = []
            for p in run:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                    out.pop()
                out.append(p)
            half.append(out[:-1])
        return half[0] + half[1] if len(points) > 2 else points

    def corners(frames):
        kept: list[tuple[float, float]] = []
        for f in frames:
            kept = chain([*kept, *zip(f["X"].tolist(), f["Y"].tolist(), strict=True)])
        if kept:
            yield pd.DataFrame(kept, columns=["X", "Y"])

    rows = df.select("X", "Y").dropna().mapInPandas(corners, "X double, Y double").collect()  # hull corners of each task only
    return chain([(r["X"], r["Y"]) for r in rows])


def plot_rotation(df: DataFrame) -> tuple[tuple[float, float], tuple[float, float]]:
    """The rotation that lays the minimum-area bounding rectangle's edge along Y."""
    hull = convex_hull(df)
    best, angle = math.inf, 0.0
    for (x0, y0), (x1, y1) in zip(hull, hull[1:] + hull[:1], strict=False):
        theta = math.atan2(y1 - y0, x1 - x0)
        c, s = math.cos(-theta), math.sin(-theta)
        u, v = [x * c - y * s for x, y in hull], [x * s + y * c for x, y in hull]
        if (area := (max(u) - min(u)) * (max(v) - min(v))) < best:
            best, angle = area, theta
    turn = math.pi / 2 - angle
    return (math.cos(turn), -math.sin(turn)), (math.sin(turn), math.cos(turn))
