"""Neighbourhoods by tiles: each tile of the cloud, with a halo, is one Arrow group.

A point goes to the tile it lies in and, as halo, to each tile within reach; a tile answers for its own
points.  Tiles are cubes; one with more than ``MOST_POINTS`` points is divided into eight, level by
level, and its halo shrinks with it.  Within a tile the points are cut by medians into leaves of
``LEAF``; a leaf's points are measured against the leaves near enough to hold their nearest ones.  So
the work is about points times neighbours wanted, however dense the cloud, and no pair is shuffled.
The points that ask and those that are found may be two clouds.  A point whose neighbours may lie beyond a shrunken halo is left open for a growing-radius search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanforge.tables import join_on, written

AXES = ("X", "Y", "Z")
MOST_POINTS, MOST_LEVELS = 60_000, 16
LEAF = 96
#: Tile side as a multiple of the largest radius.
SIDE = 8


def leaves(xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the points and the bounds of its leaves: halves at the median of the widest axis."""
    order = np.arange(len(xyz))
    open_, bounds = [(0, len(xyz))], []
    while open_:
        a, b = open_.pop()
        if b - a <= LEAF:
            bounds.append((a, b))
            continue
        part = xyz[order[a:b]]
        axis = int(np.argmax(part.max(0) - part.min(0)))
        middle = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, axis], middle)]
        open_ += [(a, a + middle), (a + middle, b)]
    return order, np.array(sorted(bounds)).reshape(-1, 2)


def nearest_by_leaves(xyz: np.ndarray, ids: np.ndarray, asks: np.ndarray, k: int, most: float, there: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(asking points, their nearest points, distances) leaf by leaf: at most k within ``most``, by distance and then id; -1 and infinity where there are fewer.

    ``there``: the points that can be found, where that isn't all.
    """
    held = np.arange(len(xyz)) if there is None else np.flatnonzero(there)
    order, bounds = leaves(xyz[held])
    order = held[order]
    if there is None:
        groups = [order[a:b][asks[order[a:b]]] for a, b in bounds]
    else:
        asking = np.flatnonzero(asks)
        own_order, own_bounds = leaves(xyz[asking])
        groups = [asking[own_order[a:b]] for a, b in own_bounds]
    if not len(held):
        for queries in groups:
            yield queries, np.full((len(queries), k), -1), np.full((len(queries), k), np.inf)
        return
    lows = np.array([xyz[order[a:b]].min(0) for a, b in bounds])
    highs = np.array([xyz[order[a:b]].max(0) for a, b in bounds])
    for queries in groups:
        if not len(queries):
            continue
        gap = np.maximum(0, np.maximum(lows - xyz[queries].max(0), xyz[queries].min(0) - highs))
        away = np.sqrt((gap * gap).sum(1))
        near_first = np.argsort(away, kind="stable")
        sizes = np.cumsum((bounds[:, 1] - bounds[:, 0])[near_first])
        # enough leaves to hold k points, then all within the k-th distance found there
        reach = away[near_first[min(int(np.searchsorted(sizes, k)), len(near_first) - 1)]]
        while len(queries):
            chosen = near_first[: int(np.searchsorted(away[near_first], min(reach, most), side="right"))]
            others = np.concatenate([order[bounds[c, 0] : bounds[c, 1]] for c in chosen]) if len(chosen) else held[:0]
            step = max(1, 2_000_000 // max(len(others), 1))
            undone, farthest = [], 0.0
            for i in range(0, len(queries), step):
                own = queries[i : i + step]
                delta = xyz[own][:, None, :] - xyz[others][None, :, :]
                dist = np.sqrt(delta[..., 0] * delta[..., 0] + delta[..., 1] * delta[..., 1] + delta[..., 2] * delta[..., 2])
                dist[dist > most] = np.inf
                kth = np.partition(dist, k - 1, axis=1)[:, k - 1] if len(others) >= k else np.full(len(own), np.inf)
                whole = (kth <= reach) | (reach >= most) | (len(chosen) == len(bounds))
                if not whole.all():
                    undone.append(own[~whole])
                    farthest = max(farthest, float(kth[~whole].max()))
                if whole.any():
                    dist, kth, own = dist[whole], kth[whole], own[whole]
                    row, column = np.nonzero(dist <= np.minimum(kth, most)[:, None])
                    by = np.lexsort((ids[others[column]], dist[row, column], row))
                    row, column = row[by], column[by]
                    place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(own)))[row]
                    keep = place < k
                    found, far = np.full((len(own), k), -1), np.full((len(own), k), np.inf)
                    found[row[keep], place[keep]] = others[column[keep]]
                    far[row[keep], place[keep]] = dist[row[keep], column[keep]]
                    yield own, found, far
            queries = np.concatenate(undone) if undone else np.empty(0, np.int64)
            reach = min(most, max(farthest, 2 * reach) if np.isfinite(farthest) else most)


def _levels(points: DataFrame, by: tuple[str, ...], side: float) -> list[tuple[int, DataFrame]]:
    """The rows by the level of their tile: those of crowded tiles go one level down."""
    done, rest, level = [], points, 0
    while True:
        names = [*by, *[f"_c{a}" for a in AXES]]
        placed = rest.select("*", *[F.floor(F.col(a) / (side / 2**level)).alias(f"_c{a}") for a in AXES])
        crowded = placed.groupBy(*names).agg(F.count("*").alias("n")).where(F.col("n") > MOST_POINTS).drop("n")
        if level == MOST_LEVELS or crowded.isEmpty():
            return [*done, (level, rest)]
        crowded = written(crowded, "crowded")
        done.append((level, join_on(placed, crowded, names, "left_anti").select(*points.columns)))
        rest = written(join_on(placed, crowded, names, "left_semi").select(*points.columns), "crowded-points")
        level += 1


def by_tiles(points: DataFrame, k: int, most: float, made: Callable, schema: str, by: tuple[str, ...] = (), asking: str | None = None, queries: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows, open): what ``made`` returns for every point (those with ``asking``, a boolean column), and the points whose neighbours a tile could not tell (None: none).

    With ``queries``, a frame of its own with ids of its own, its points ask and those of ``points`` are found; only tiles with queries get points.
    ``made(ids, xyz, own, found, far)`` gives a table of ``schema`` without the ``by`` columns; ``own`` are the asking points'
    places in ``ids`` and ``xyz``, ``found`` and ``far`` their at most k nearest places (-1: none) and distances within ``most``.
    """
    side, apart = SIDE * most, queries is not None

    def narrowed(df: DataFrame, asks: Column, there: bool) -> DataFrame:
        places = [F.col(a).cast("double").alias(a) for a in AXES]
        return df.select(*by, F.col("point_id").cast("long").alias("point_id"), *places, asks.alias("_asks"), F.lit(there).alias("_there")).where("X = X AND Y = Y AND Z = Z")

    narrow = narrowed(points, F.col(asking) if asking else F.lit(not apart), True)
    if apart:
        narrow = narrow.unionByName(narrowed(queries, F.lit(True), False))
    narrow = written(narrow, "tile-points")
    levels = _levels(narrow, by, side)
    every = reduce(DataFrame.unionByName, [rows.withColumn("_at", F.lit(level)) for level, rows in levels])
    sent = None
    for level, rows in levels:
        width = side / 2**level
        halo = min(most, width / 2)
        own = [F.floor(F.col(a) / width) for a in AXES]
        reach = F.when(F.col("_there"), halo).otherwise(0.0)  # what only asks stays in its tile
        spread = every
        for a in AXES:
            spread = spread.withColumn(f"_t{a}", F.explode(F.sequence(F.floor((F.col(a) - reach) / width), F.floor((F.col(a) + reach) / width))))
        mine = (F.col("_at") == level) & (F.col("_tX") == own[0]) & (F.col("_tY") == own[1]) & (F.col("_tZ") == own[2])  # a point asks at its own level only
        spread = spread.select(*by, "point_id", *AXES, "_there", F.lit(level).alias("level"), "_tX", "_tY", "_tZ", (F.col("_asks") & mine).alias("core"))
        if len(levels) > 1 or apart:  # only tiles that are asked at this level
            asked = rows.where("_asks").select(*by, *[c.alias(f"_t{a}") for a, c in zip(AXES, own, strict=True)]).distinct()
            spread = join_on(spread, asked, [*by, "_tX", "_tY", "_tZ"], "left_semi").where("_there or core")
        sent = spread if sent is None else sent.unionByName(spread)
    keys = [*by, "level", "_tX", "_tY", "_tZ"]

    def handled(table: pa.Table) -> pa.Table:
        level = table.column("level")[0].as_py()
        width = side / 2**level
        halo = min(most, width / 2)
        corner = np.array([table.column(f"_t{a}")[0].as_py() for a in AXES]) * width
        ids, asks = table.column("point_id").to_numpy(), table.column("core").to_numpy(zero_copy_only=False)
        there = table.column("_there").to_numpy(zero_copy_only=False) if apart else None
        xyz = np.stack([table.column(a).to_numpy() for a in AXES], axis=1)
        out = []
        if asks.any():
            border = np.minimum(xyz - (corner - halo), corner + width + halo - xyz).min(1)
            for own, found, far in nearest_by_leaves(xyz, ids, asks, k, most, there):
                kth = np.minimum(far[:, k - 1], most)
                sure = (kth <= border[own]) | (halo >= most)
                if sure.any():
                    out.append(_marked(made(ids, xyz, own[sure], found[sure], far[sure]), False))
                if not sure.all():
                    out.append(_marked(_empty(target, ids[own[~sure]]), True))
        whole = pa.concat_tables(out).select(target.names + ["open"]) if out else _marked(target.empty_table(), False)
        for name in reversed(by):
            whole = whole.add_column(0, table.schema.field(name), pa.array([table.column(name)[0].as_py()] * whole.num_rows, table.schema.field(name).type))
        return whole

    target = _arrow_schema(points, schema)
    kinds = dict(narrow.dtypes)
    full = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), schema, "open boolean"])
    rows = written(sent.groupBy(*keys).applyInArrow(handled, full), "tile-rows")
    if all(side / 2**level / 2 >= most for level, _ in levels):  # no halo had to shrink
        return rows.drop("open"), None
    left = rows.where("open").select(*by, "point_id").distinct()
    return rows.where("not open").drop("open"), join_on(narrow.where("_asks").drop("_asks", "_there"), left, [*by, "point_id"], "left_semi")


def _marked(table: pa.Table, open_: bool) -> pa.Table:
    return table.append_column("open", pa.array(np.full(table.num_rows, open_)))


def _empty(schema: pa.Schema, ids: np.ndarray) -> pa.Table:
    """Rows of nothing but their point's id."""
    return pa.table([pa.array(ids, pa.int64()) if f.name == "point_id" else pa.nulls(len(ids), f.type) for f in schema], schema=schema)


def _arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)


def adaptive_radius_of(far: np.ndarray, base: float, most: float, nth: int, factor: float) -> np.ndarray:
    """Each point's radius from its distances in order: factor * the nth within [base, most]; ``most`` if there are fewer in reach."""
    at = far[:, nth - 1]
    return np.where(np.isfinite(at), np.minimum(np.maximum(factor * np.where(np.isfinite(at), at, 0.0), base), most), most)


def covariance_rows(ids: np.ndarray, xyz: np.ndarray, own: np.ndarray, found: np.ndarray, inside: np.ndarray, ddof: int) -> pa.Table:
    """point_id, n_nbrs and the six covariances of each point's neighbours, from differences to the point."""
    delta = np.where(inside[..., None], xyz[np.maximum(found, 0)] - xyz[own][:, None, :], 0.0)
    n = inside.sum(1)
    centred = np.where(inside[..., None], delta - (delta.sum(1) / np.maximum(n, 1)[:, None])[:, None, :], 0.0)
    weight = n - ddof
    columns = {"point_id": pa.array(ids[own]), "n_nbrs": pa.array(n.astype(np.int64))}
    for name, i, j in (("cxx", 0, 0), ("cyy", 1, 1), ("czz", 2, 2), ("cxy", 0, 1), ("cyz", 1, 2), ("cxz", 0, 2)):
        value = (centred[..., i] * centred[..., j]).sum(1) / np.maximum(weight, 1)
        columns[name] = pa.array(value, mask=weight <= 0)
    return pa.table(columns)


COVARIANCES = "point_id long, n_nbrs long, cxx double, cyy double, czz double, cxy double, cyz double, cxz double"
EDGES = "point_id long, nbr_id long, dist double, dX double, dY double, dZ double"


def edge_rows(ids: np.ndarray, xyz: np.ndarray, own: np.ndarray, found: np.ndarray, far: np.ndarray, inside: np.ndarray) -> pa.Table:
    row, column = np.nonzero(inside)
    a, b = own[row], found[row, column]
    delta = xyz[b] - xyz[a]
    return pa.table({"point_id": pa.array(ids[a]), "nbr_id": pa.array(ids[b]), "dist": pa.array(far[row, column]), **{f"d{c}": pa.array(np.ascontiguousarray(delta[:, i])) for i, c in enumerate(AXES)}})
