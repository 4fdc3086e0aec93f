"""Scanner positions as bright blobs of an inverted density image.

The image's cells go to tiles with a halo as wide as the widest filter reaches, so each tile filters and searches its
own part at all sizes, and its maxima are the image's.  Only the blobs found meet again, scan by scan, where
those that overlap a larger one are left out; a scan has fewer blobs than its grid has cells.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanforge.operators import raster_tiles
from scanforge.operators.histogram import grid_counts, inverted_grid
from scanforge.tables import join_on

TRUNCATE = 4.0


def gauss_kernels(sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """(Gaussian, its second derivative), cut off at ``TRUNCATE`` sigmas."""
    radius = int(TRUNCATE * sigma + 0.5)
    x = np.arange(-radius, radius + 1)
    g = np.exp(-x * x / (2 * sigma * sigma))
    g /= g.sum()
    return g, g * (x * x - sigma * sigma) / sigma**4


def _bands(kernel: np.ndarray, n: int, reach: int) -> np.ndarray:
    """The n x (n + 2 * reach) matrix that applies a kernel to a line with ``reach`` cells more at either end."""
    out, radius = np.zeros((n, n + 2 * reach)), len(kernel) // 2
    for i in range(n):
        out[i, i + reach - radius : i + reach + radius + 1] = kernel
    return out


def _mirrored(places: np.ndarray, n: int) -> np.ndarray:
    """Places beyond an image of n cells, mirrored into it with the border repeated."""
    at = places % (2 * n)
    return np.where(at < n, at, 2 * n - 1 - at)


def log_maxima(grey: DataFrame, bins: int, least_sigma: float = 8, most_sigma: float = 16, steps: int = 10, threshold: float = 0.1, by: tuple[str, ...] = (), side: int = raster_tiles.SIDE) -> DataFrame:
    """(by.., y_pix, x_pix, sigma, strength): maxima over place and size of the scaled negative Laplacian of Gaussian, for images (gx, gy, grey) of bins x bins."""
    sigmas = np.linspace(least_sigma, most_sigma, steps)
    reach = int(TRUNCATE * most_sigma + 0.5)

    def made(tile: raster_tiles.Tile) -> pa.Table:
        # the own part and one cell around it, as far as the image goes
        lows, highs = ([max(0, first + tile.halo - 1) for first in (tile.y0, tile.x0)], [min(bins, first + tile.halo + side + 1) for first in (tile.y0, tile.x0)])
        rows, columns = (_mirrored(np.arange(lo - reach, hi + reach), bins) - first for lo, hi, first in zip(lows, highs, (tile.y0, tile.x0), strict=True))
        image = tile.values["grey"][np.ix_(rows, columns)] / 255
        cube = np.empty((highs[0] - lows[0], highs[1] - lows[1], steps))
        for k, sigma in enumerate(sigmas):
            (sy, dy), (sx, dx) = ([_bands(kernel, n, reach) for kernel in gauss_kernels(sigma)] for n in cube.shape[:2])
            cube[..., k] = -(dy @ image @ sx.T + sy @ image @ dx.T) * sigma * sigma
        padded = np.pad(cube, 1, constant_values=-np.inf)
        highest = np.full(cube.shape, -np.inf)
        for i in range(3):
            for j in range(3):
                for k in range(3):
                    highest = np.maximum(highest, padded[i : i + cube.shape[0], j : j + cube.shape[1], k : k + steps])
        y, x, k = np.nonzero((cube == highest) & (cube > threshold))
        strength, y, x = cube[y, x, k], y + lows[0], x + lows[1]
        own = (y >= tile.y0 + tile.halo) & (y < tile.y0 + tile.halo + side) & (x >= tile.x0 + tile.halo) & (x < tile.x0 + tile.halo + side)
        return pa.table({"y_pix": pa.array(y[own].astype(np.int32)), "x_pix": pa.array(x[own].astype(np.int32)), "sigma": pa.array(sigmas[k[own]]), "strength": pa.array(strength[own])})

    pixels = grey.select(*by, F.col("gy").alias("y_pix"), F.col("gx").alias("x_pix"), "grey")
    return raster_tiles.by_raster_tiles(pixels, ["grey"], reach + 1, made, "y_pix int, x_pix int, sigma double, strength double", by, side)


def without_overlaps(found: list[tuple[int, int, float]], overlap: float = 0.5) -> list[int]:
    """Places of the blobs (row, column, sigma), strongest first, that stay: of two that overlap by more than a share the larger one does."""
    gone: set[int] = set()
    for i, a in enumerate(found):
        for j in range(i + 1, len(found)):
            b = found[j]
            if i not in gone and j not in gone and shared_area(a, b) > overlap:
                gone.add(i if a[2] < b[2] else j)
    return [k for k in range(len(found)) if k not in gone]


def shared_area(a: tuple[int, int, float], b: tuple[int, int, float]) -> float:
    """Area that two discs of radius sigma * sqrt(2) share, as a share of the smaller one."""
    r, q = a[2] * math.sqrt(2), b[2] * math.sqrt(2)
    d = math.hypot(a[0] - b[0], a[1] - b[1])
    if d >= r + q:
        return 0.0
    if d <= abs(r - q):
        return 1.0
    lens = r * r * math.acos((d * d + r * r - q * q) / (2 * d * r)) + q * q * math.acos((d * d + q * q - r * r) / (2 * d * q))
    lens -= math.sqrt((-d + r + q) * (d + r - q) * (d - r + q) * (d + r + q)) / 2
    return lens / (math.pi * min(r, q) ** 2)


def scanner_positions(points: DataFrame, bins: int = 512, least_sigma: float = 8, most_sigma: float = 16, steps: int = 10, threshold: float = 0.1, by: tuple[str, ...] = (), side: int = raster_tiles.SIDE) -> DataFrame:
    """(by.., position_id, X, Y, sigma): centres of the grid cells of the blobs in the inverted density of each scan's points, brightest first."""
    grey = inverted_grid(grid_counts(points, bins, by=by), bins, by)
    maxima = log_maxima(grey, bins, least_sigma, most_sigma, steps, threshold, by, side)

    def kept(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["strength", "y_pix", "x_pix", "sigma"], ascending=[False, True, True, True])
        stay = without_overlaps(list(zip(frame["y_pix"].tolist(), frame["x_pix"].tolist(), frame["sigma"].tolist(), strict=True)))
        return frame.iloc[stay].assign(position_id=range(len(stay)))[[*by, "position_id", "y_pix", "x_pix", "sigma"]]

    kinds = dict(points.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "position_id int, y_pix int, x_pix int, sigma double"])
    blobs = maxima.groupBy(*by).applyInPandas(kept, schema)  # a scan's blobs
    box = points.groupBy(*by).agg(*[fn(a).cast("double").alias(f"_{k}{a}") for a in "XY" for k, fn in (("lo", F.min), ("hi", F.max))])
    placed = join_on(blobs, box, list(by)) if by else blobs.crossJoin(F.broadcast(box))  # one row
    centre = lambda a, c: (F.col(f"_lo{a}") + (F.col(f"_hi{a}") - F.col(f"_lo{a}")) * (F.col(c) + 0.5) / bins).alias(a)
    return placed.select(*by, "position_id", centre("X", "x_pix"), centre("Y", "y_pix"), "sigma")
