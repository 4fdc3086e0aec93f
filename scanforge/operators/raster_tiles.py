"""Filters of rasters by tiles: each tile of an image, with a halo as wide as the filter reaches, is one Arrow group.

Only pixels near a tile's border travel twice, whatever the filter's width; an image of any size is as many
groups as it has tiles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pixels along a tile's side.
SIDE = 256


@dataclass
class Tile:
    """A tile's pixels with its halo."""

    values: dict[str, np.ndarray]  # NaN where there is no pixel or no value
    there: np.ndarray  # where there are pixels
    y0: int  # the image's row and column of the arrays' first pixel
    x0: int
    halo: int

    @property
    def own(self) -> tuple[slice, slice]:
        """The tile without its halo."""
        return (slice(self.halo, self.there.shape[0] - self.halo),) * 2

    def rows(self, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """y_pix and x_pix of the own pixels where ``at``, a mask of the own part, is set."""
        y, x = np.nonzero(at)
        return pa.array((y + self.y0 + self.halo).astype(np.int32)), pa.array((x + self.x0 + self.halo).astype(np.int32))


def by_raster_tiles(pixels: DataFrame, values: list[str], halo: int, made: Callable[[Tile], pa.Table], schema: str, keys: tuple[str, ...] = (), side: int = SIDE) -> DataFrame:
    """(keys.., schema): what ``made`` returns for the tiles of each image (y_pix, x_pix, values); images are told apart by ``keys``."""
    spread = pixels.select(*keys, *[F.col(c).cast("int").alias(c) for c in ("y_pix", "x_pix")], *[F.col(v).cast("double").alias(v) for v in values])
    for t, c in (("_ty", "y_pix"), ("_tx", "x_pix")):
        spread = spread.withColumn(t, F.explode(F.sequence(F.floor((F.col(c) - halo) / side), F.floor((F.col(c) + halo) / side))))

    def handled(table: pa.Table) -> pa.Table:
        y0, x0 = (table.column(c)[0].as_py() * side - halo for c in ("_ty", "_tx"))
        at = tuple(table.column(c).to_numpy() - first for c, first in (("y_pix", y0), ("x_pix", x0)))
        there = np.zeros((side + 2 * halo,) * 2, bool)
        there[at] = True
        arrays = {}
        for v in values:
            arrays[v] = np.full(there.shape, np.nan)
            arrays[v][at] = table.column(v).to_numpy()
        tile = Tile(arrays, there, y0, x0, halo)
        out = made(tile) if there[tile.own].any() else None
        n = 0 if out is None else out.num_rows
        names = {c: pa.array([table.column(c)[0].as_py()] * n, table.schema.field(c).type) for c in keys}
        return pa.table(names | ({c: out.column(c) for c in columns} if out is not None else {c: pa.nulls(0, t) for c, t in columns.items()}))

    from pyspark.sql.pandas.types import to_arrow_schema

    columns = {f.name: f.type for f in to_arrow_schema(pixels.sparkSession.createDataFrame([], schema).schema)}
    kinds = dict(pixels.dtypes)
    return spread.groupBy(*keys, "_ty", "_tx").applyInArrow(handled, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), schema]))


def median(pixels: DataFrame, value: str, radius: int, keys: tuple[str, ...] = (), side: int = SIDE) -> DataFrame:
    """keys, y_pix, x_pix and the median of the values that are there in each pixel's square neighbourhood."""

    def made(tile: Tile) -> pa.Table:
        array, there, out = tile.values[value], tile.there[tile.own], np.empty((side, side))
        step = max(1, 2_000_000 // ((2 * radius + 1) ** 2 * side))
        for first in range(0, side, step):
            n = min(step, side - first)
            around = np.stack([array[first + dy : first + dy + n, dx : dx + side] for dy in range(2 * radius + 1) for dx in range(2 * radius + 1)])
            around.sort(axis=0)  # NaN last
            known = (~np.isnan(around)).sum(0)
            low, high = (np.take_along_axis(around, np.maximum(i, 0)[None], 0)[0] for i in ((known - 1) // 2, known // 2))  # the same place if the number is odd
            out[first : first + n] = np.where(known > 0, (low + high) / 2, np.nan)
        y, x = tile.rows(there)
        found = out[there]
        return pa.table({"y_pix": y, "x_pix": x, value: pa.array(found, mask=np.isnan(found))})

    return by_raster_tiles(pixels, [value], radius, made, f"y_pix int, x_pix int, `{value}` double", keys, side)
