"""Neighbour searches.

Nearest neighbours, of a cloud's own points or of queries of another table, come from tiles: no pair but the
wanted ones leaves a task.  ``radius_pairs`` returns every pair within a radius: points are hashed to grid
cells as wide as the radius; the query side is sent to the 27 cells around its own, and an
equi-join on (scan, cell) leaves only near pairs to measure.  Crowded cells are ordinary skewed
join keys, which adaptive execution splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanforge.operators import tiles
from scanforge.operators.points import with_stats
from scanforge.tables import join_groups, join_on, written

AXES = ("X", "Y", "Z")


def cells(size: Column | float, axes: tuple[str, ...] = AXES) -> list[Column]:
    return [F.floor(F.col(a) / size).alias(f"_c{a}") for a in axes]


def around(df: DataFrame, size: float, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Each row once for its own and each neighbouring cell."""
    for a in axes:
        own = F.floor(F.col(a) / size)
        df = df.withColumn(f"_c{a}", F.explode(F.array(own - 1, own, own + 1)))
    return df


def radius_pairs(queries: DataFrame, points: DataFrame, radius: float, by: tuple[str, ...] = (), axes: tuple[str, ...] = AXES) -> DataFrame:
    """(by.., point_id, nbr_id, dist, d<axis>..): every point within the radius of each query, itself included."""
    q = around(queries.select(*by, "point_id", *axes), radius, axes)
    p = points.select(*by, F.col("point_id").alias("nbr_id"), *[F.col(a).alias(f"n{a}") for a in axes], *[F.floor(F.col(a) / radius).alias(f"_c{a}") for a in axes])
    met = join_on(q, p, [*by, *[f"_c{a}" for a in axes]])
    deltas = {f"d{a}": F.col(f"n{a}") - F.col(a) for a in axes}
    met = met.withColumns(deltas)
    square = sum((F.col(d) * F.col(d) for d in list(deltas)[1:]), F.col(list(deltas)[0]) * F.col(list(deltas)[0]))
    return met.withColumn("dist", F.sqrt(square)).where(F.col("dist") <= radius).select(*by, "point_id", "nbr_id", "dist", *deltas)


def _flat(df: DataFrame, by: tuple[str, ...], axes: tuple[str, ...]) -> DataFrame:
    """by.., point_id, X, Y, Z; axes that don't count are 0."""
    return df.select(*by, "point_id", *[(F.col(a) if a in axes else F.lit(0.0)).cast("double").alias(a) for a in AXES])


#: Points of a cell that one task compares with its queries.
CHUNK = 20_000


def _knn_in_chunks(queries: DataFrame, points: DataFrame, k: int, radius: float, by: tuple[str, ...]) -> DataFrame:
    """(by.., point_id, nbr_id, dist): the k nearest within the radius, for queries that tiles leave open.

    Cells as wide as the radius, however crowded: a cell's points are dealt into chunks, and of each chunk near a query only the k
    nearest leave the task.
    """
    cell = [f"_c{a}" for a in AXES]
    p = points.select("*", *cells(radius))
    sizes = p.groupBy(*by, *cell).agg(F.ceil(F.count("*") / CHUNK).alias("_chunks"))
    held = join_on(p, sizes, [*by, *cell]).withColumn("_chunk", F.pmod(F.xxhash64("point_id"), F.col("_chunks"))).withColumn("_there", F.lit(True))
    asked = join_on(around(queries, radius), sizes, [*by, *cell])
    asked = asked.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1))).withColumn("_there", F.lit(False))
    both = held.unionByName(asked).drop("_chunks")

    def nearest(table: pa.Table) -> pa.Table:
        ids, there = table.column("point_id").to_numpy(), table.column("_there").to_numpy(zero_copy_only=False)
        xyz = np.stack([table.column(a).to_numpy() for a in AXES], axis=1)
        rows = [tiles.edge_rows(ids, xyz, own, found, far, found >= 0).select(["point_id", "nbr_id", "dist"]) for own, found, far in tiles.nearest_by_leaves(xyz, ids, ~there, k, radius, there)]
        out = pa.concat_tables(rows) if rows else pa.table({"point_id": pa.array([], pa.int64()), "nbr_id": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        for name in reversed(by):
            out = out.add_column(0, table.schema.field(name), pa.array([table.column(name)[0].as_py()] * out.num_rows, table.schema.field(name).type))
        return out

    kinds = dict(points.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "point_id long, nbr_id long, dist double"])
    return both.groupBy(*by, *cell, "_chunk").applyInArrow(nearest, schema)


def knn(queries: DataFrame, points: DataFrame, k: int, cell: float, by: tuple[str, ...] = (), axes: tuple[str, ...] = AXES, longest: float | None = None) -> DataFrame:
    """(by.., point_id, rank, nbr_id, dist): the k nearest points of each query, ties to the smaller id, a point itself included.

    Exact: a query is finished once its k-th neighbour lies within the searched radius.  The rest
    goes on with four times the radius, until the radius spans all points or is ``longest``, beyond which no point counts.
    Each radius is one pass over tiles that hold queries and points; at most k pairs of a query leave a task.
    """
    spans = points.agg(*[F.max(a).alias(f"hi{a}") for a in axes], *[F.min(a).alias(f"lo{a}") for a in axes])
    reach = queries.agg(*[F.max(a).alias(f"qhi{a}") for a in axes], *[F.min(a).alias(f"qlo{a}") for a in axes]).crossJoin(spans).first()
    if reach is None or any(v is None for v in reach):
        empty = queries.sparkSession.createDataFrame([], queries.select(*by, F.col("point_id").cast("long"), F.lit(1).alias("rank")).schema)
        return empty.withColumns({"nbr_id": F.lit(None).cast("long"), "dist": F.lit(None).cast("double")})
    extent = sum((max(reach[f"hi{a}"], reach[f"qhi{a}"]) - min(reach[f"lo{a}"], reach[f"qlo{a}"])) ** 2 for a in axes) ** 0.5
    found, radius, left, there = None, cell, _flat(queries, by, axes), _flat(points, by, axes)
    order = Window.partitionBy(*by, "point_id").orderBy("dist", "nbr_id")
    while True:
        radius = radius if longest is None else min(radius, longest)
        last = radius > extent or radius == longest
        rows, open_ = tiles.by_tiles(there, k, radius, lambda ids, xyz, own, found, far: tiles.edge_rows(ids, xyz, own, found, far, found >= 0), tiles.EDGES, by, queries=left)
        rows = rows.select(*by, "point_id", "nbr_id", "dist")
        if open_ is not None and not open_.isEmpty():
            rows = rows.unionByName(_knn_in_chunks(open_, there.withColumn("point_id", F.col("point_id").cast("long")), k, radius, by))
        ranked = written(rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*by, "point_id", "rank", "nbr_id", "dist"), "knn")
        if last:
            return ranked if found is None else found.unionByName(ranked)
        whole = ranked.where(F.col("rank") == k).select(*by, "point_id")
        part = join_on(ranked, whole, [*by, "point_id"], "left_semi")
        found = part if found is None else found.unionByName(part)
        left = written(join_on(left, whole, [*by, "point_id"], "left_anti"), "knn-open")
        if left.isEmpty():
            return found
        radius *= 4


def knn_among(points: DataFrame, k: int, cell: float, by: tuple[str, ...] = (), asking: str | None = None) -> DataFrame:
    """``knn`` of a cloud's own points (those with ``asking``, a boolean column) among all of them.

    Tiles answer for all that have k points within four cells; the others go on with growing radii.
    """
    most = 4 * cell
    rows, _ = tiles.by_tiles(points, k, most, lambda ids, xyz, own, found, far: tiles.edge_rows(ids, xyz, own, found, far, found >= 0), tiles.EDGES, by, asking)
    order = Window.partitionBy(*by, "point_id").orderBy("dist", "nbr_id")  # k rows
    ranked = rows.withColumn("rank", F.row_number().over(order)).select(*by, "point_id", "rank", "nbr_id", "dist")
    whole = ranked.where(F.col("rank") == k).select(*by, "point_id")
    asks = points if asking is None else points.where(asking)
    left = written(join_on(asks.select(*by, "point_id", *AXES), whole, [*by, "point_id"], "left_anti"), "knn-left")
    if left.isEmpty():
        return ranked
    return join_on(ranked, whole, [*by, "point_id"], "left_semi").unionByName(knn(left, points, k, most, by))


def _by_size(points: DataFrame, nth: int, by: tuple[str, ...]) -> tuple[DataFrame | None, DataFrame | None]:
    """(points of groups that hold ``nth`` or more, points of the others); None where there are no such groups."""
    sizes = points.groupBy(*by).agg(F.count("*").alias("n"))  # one row a group
    least, most = sizes.agg(F.min("n"), F.max("n")).first()
    if least is None or least >= nth:
        return points, None
    if most < nth:
        return None, points
    few = written(sizes.where(F.col("n") < nth).drop("n"), "small-groups")
    return join_groups(points, few, list(by), "left_anti"), join_groups(points, few, list(by), "left_semi")


def _radius_of(points: DataFrame, edges: DataFrame, base: float, most: float, k: int, nth: int, factor: float, by: tuple[str, ...], cap: str) -> DataFrame:
    """The edges within each point's radius, at most k of them."""
    group = Window.partitionBy(*by, "point_id")
    total = points.groupBy(*by).agg(F.count("*").alias("_all")) if by else points.agg(F.count("*").alias("_all"))
    near = edges.withColumn("_k", F.row_number().over(group.orderBy("dist", "nbr_id"))).withColumn("_nth", F.max(F.when(F.col("_k") == nth, F.col("dist"))).over(group))
    near = join_groups(near, total, list(by)) if by else near.crossJoin(F.broadcast(total))  # one row
    radius = F.when(F.col("_all") < nth, F.lit(base)).when(F.col("_nth").isNull(), F.lit(most)).otherwise(F.least(F.greatest(factor * F.col("_nth"), F.lit(base)), F.lit(most)))
    within = near.where(F.col("dist") <= radius)
    rank = F.col("_k") if cap == "distance" else F.row_number().over(group.orderBy("nbr_id"))
    return within.withColumn("_r", rank).where(F.col("_r") <= k).select(*by, "point_id", "nbr_id", "dist", "dX", "dY", "dZ")


def _knn_edges(asking: DataFrame, points: DataFrame, k: int, most: float, by: tuple[str, ...]) -> DataFrame:
    """(by.., point_id, nbr_id, dist, dX, dY, dZ): the k nearest within ``most`` of a few asking points, through growing radii."""
    near = knn(asking, points, k, most / 64, by, longest=most)
    q = points.select(*by, "point_id", *AXES)
    p = points.select(*by, F.col("point_id").alias("nbr_id"), *[F.col(a).alias(f"n{a}") for a in AXES])
    met = join_on(join_on(near, q, [*by, "point_id"]), p, [*by, "nbr_id"])
    return met.select(*by, "point_id", "nbr_id", "dist", *[(F.col(f"n{a}") - F.col(a)).alias(f"d{a}") for a in AXES])


def _of_few(few: DataFrame, base: float, k: int, by: tuple[str, ...], cap: str = "distance") -> DataFrame:
    """Neighbours within ``base`` in groups of fewer points than the radius is measured by: few pairs each."""
    pairs = radius_pairs(few, few, base, by)
    order = Window.partitionBy(*by, "point_id").orderBy(*(("dist", "nbr_id") if cap == "distance" else ("nbr_id",)))
    return pairs.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def adaptive_neighbours(points: DataFrame, base: float, most: float = 0.2, k: int = 50, nth: int = 21, factor: float = 1.5, by: tuple[str, ...] = (), cap: str = "distance") -> DataFrame:
    """(by.., point_id, nbr_id, dist, dX, dY, dZ): neighbours within clamp(factor * distance of the nth, base, most), at most k.

    The radius never exceeds ``most``.  With fewer than ``nth`` points in reach it is ``base`` if the group has no more at all, else
    ``most``.  ``cap``: keep the k nearest, or the first k by id.  The k nearest come from tiles, so a dense cloud costs
    no more pairs than are kept; the first k by id need every pair within ``most``.
    """
    if cap != "distance":
        return _radius_of(points, radius_pairs(points, points, most, by), base, most, k, nth, factor, by, cap)
    large, few = _by_size(points, nth, by)
    rows = None if few is None else _of_few(few, base, k, by)
    if large is None:
        return rows

    def made(ids, xyz, own, found, far):  # noqa: ANN001, ANN202
        reach = far <= tiles.adaptive_radius_of(far, most=most, base=base, nth=nth, factor=factor)[:, None]
        reach[:, k:] = False
        return tiles.edge_rows(ids, xyz, own, found, far, reach)

    edges, open_ = tiles.by_tiles(large, max(k, nth), most, made, tiles.EDGES, by)
    rows = edges if rows is None else rows.unionByName(edges)
    if open_ is None or open_.isEmpty():
        return rows
    return rows.unionByName(_radius_of(large, _knn_edges(open_, large, max(k, nth), most, by), base, most, k, nth, factor, by, cap))


def neighbour_covariances(points: DataFrame, base: float, most: float = 0.2, k: int = 50, nth: int = 21, factor: float = 1.5, by: tuple[str, ...] = (), ddof: int = 1) -> DataFrame:
    """(by.., point_id, n_nbrs, covariances) of ``adaptive_neighbours``, summed up within the tiles: no edge leaves a task."""
    from scanforge.operators.geom import covariances

    large, few = _by_size(points, nth, by)
    rows = None if few is None else covariances(_of_few(few, base, k, by), by, ddof)
    if large is None:
        return rows

    def made(ids, xyz, own, found, far):  # noqa: ANN001, ANN202
        reach = far <= tiles.adaptive_radius_of(far, most=most, base=base, nth=nth, factor=factor)[:, None]
        reach[:, k:] = False
        return tiles.covariance_rows(ids, xyz, own, found, reach, ddof)

    sums, open_ = tiles.by_tiles(large, max(k, nth), most, made, tiles.COVARIANCES, by)
    rows = sums if rows is None else rows.unionByName(sums)
    if open_ is None or open_.isEmpty():
        return rows
    rest = _radius_of(large, _knn_edges(open_, large, max(k, nth), most, by), base, most, k, nth, factor, by, "distance")
    return rows.unionByName(covariances(rest, by, ddof))


def nearest_within(points: DataFrame, k: int, radius: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., point_id, nbr_id, dist, dX, dY, dZ): the at most k nearest points within a radius of each point, itself included."""
    rows, open_ = tiles.by_tiles(points, k, radius, lambda ids, xyz, own, found, far: tiles.edge_rows(ids, xyz, own, found, far, found >= 0), tiles.EDGES, by)
    return rows if open_ is None or open_.isEmpty() else rows.unionByName(_knn_edges(open_, points, k, radius, by))


def hybrid_neighbours(points: DataFrame, radius: float, k: int = 30, least: int = 3, fallback: int = 10, by: tuple[str, ...] = (), include_self: bool = False) -> DataFrame:
    """Edges to the k - 1 nearest others within the radius; a point with fewer than ``least`` such takes its ``fallback`` - 1 nearest, however far.

    Counts include the point itself, as the older search does.
    """
    near = written(nearest_within(points, k, radius, by), "hybrid")
    enough = near.groupBy(*by, "point_id").agg(F.count("*").alias("n")).where(F.col("n") > least)
    whole = join_on(near, enough, [*by, "point_id"], "left_semi")
    lonely = join_on(points, enough, [*by, "point_id"], "left_anti")
    if not lonely.isEmpty():
        nearest = knn(lonely, points, fallback, radius, by)
        q = points.select(*by, "point_id", *AXES)
        p = points.select(*by, F.col("point_id").alias("nbr_id"), *[F.col(a).alias(f"n{a}") for a in AXES])
        met = join_on(join_on(nearest, q, [*by, "point_id"]), p, [*by, "nbr_id"])
        whole = whole.unionByName(met.select(*by, "point_id", "nbr_id", "dist", *[(F.col(f"n{a}") - F.col(a)).alias(f"d{a}") for a in AXES]))
    return whole if include_self else whole.where("point_id <> nbr_id")


def in_circles(points: DataFrame, centres: DataFrame, radius: float) -> DataFrame:
    """Points with each centre (centre_id, cx, cy) within a planar radius; regions may overlap."""
    c = centres.select("centre_id", "cx", "cy", F.col("cx").alias("X"), F.col("cy").alias("Y"))
    c = around(c, radius, ("X", "Y")).drop("X", "Y")
    p = points.withColumns({"_cX": F.floor(F.col("X") / radius), "_cY": F.floor(F.col("Y") / radius)})
    near = F.sqrt((F.col("X") - F.col("cx")) * (F.col("X") - F.col("cx")) + (F.col("Y") - F.col("cy")) * (F.col("Y") - F.col("cy"))) <= radius
    return p.join(c, ["_cX", "_cY"]).where(near).drop("_cX", "_cY", "cx", "cy")


def voxel_means(points: DataFrame, size: float, anchor: str = "origin", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean point and count of each voxel; ``anchor``: voxels from the origin, or from half a voxel under the scan's minimum."""
    shift = {a: F.lit(0.0) for a in AXES}
    if anchor == "minimum":
        points = with_stats(points, by, **{f"_m{a}": F.min(a) for a in AXES})
        shift = {a: F.col(f"_m{a}") - size / 2 for a in AXES}
    keys = [F.floor((F.col(a) - shift[a]) / size).alias(f"v{a.lower()}") for a in AXES]
    return points.groupBy(*by, *keys).agg(*[F.avg(a).alias(a) for a in AXES], F.count("*").alias("n"))


def voxel_sample(points: DataFrame, size: float, anchor: str = "origin", by: tuple[str, ...] = ()) -> DataFrame:
    """The point nearest to each voxel's mean, once each."""
    means = voxel_means(points, size, anchor, by).withColumn("point_id", F.xxhash64("vx", "vy", "vz"))
    nearest = knn(means, points, 1, size, by)
    return join_on(points, nearest.select(*by, F.col("nbr_id").alias("point_id")).distinct(), [*by, "point_id"], "left_semi")


def core_rows(batch: DataFrame, core: DataFrame, keys: tuple[str, ...] = ("point_id",)) -> DataFrame:
    return batch.join(core.select(*keys), list(keys), "left_semi")


def buffered_batch(points: DataFrame, core: DataFrame, k: int = 30, cell: float = 0.2, by: tuple[str, ...] = ()) -> DataFrame:
    """The points of a batch with its buffer: its own (``core``: by.., point_id) and the k nearest of each of them; ``is_core`` tells them apart."""
    keys = [*by, "point_id"]
    own = join_on(points, core.select(*keys).distinct(), keys, "left_semi")
    near = knn(own, points, k, cell, by).select(*by, F.col("nbr_id").alias("point_id"))
    marked = core.select(*keys).distinct().withColumn("is_core", F.lit(True))
    wanted = join_on(near.unionByName(core.select(*keys)).distinct(), marked, keys, "left").withColumn("is_core", F.coalesce("is_core", F.lit(False)))
    return join_on(points, wanted, keys)
