"""Operators between points and angular pixels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanforge.operators import raster_tiles
from scanforge.operators.points import scans_of, with_stats
from scanforge.tables import join_groups

PIXEL = ("scan_id", "y_pix", "x_pix")


def nearest_per_pixel(df: DataFrame, values: list[str], tie: list[str], keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Of each pixel's return with the least range (then least ``tie``): ``values``; and ``density``, the number of returns.

    One partial aggregate serves nearest values, masks, colours and density at once.  NaN and
    NULL ranges never win over a number, but count.
    """
    rank = F.struct(F.coalesce(F.nanvl("rangemeter", F.lit(None).cast("double")), F.lit(float("inf"))), *tie)
    best = F.min_by(F.struct(*values), rank).alias("_v")
    return df.groupBy(*keys).agg(best, F.count("*").alias("density")).select(*keys, "_v.*", "density")


def mode_per_pixel(df: DataFrame, label: str, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """The most frequent label of each pixel, the least on a tie."""
    return df.groupBy(*keys).agg(F.mode(label, True).alias(label))


def mean_per_pixel(df: DataFrame, values: list[str], keys: tuple[str, ...] = PIXEL) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("density"))


def last_writer_per_pixel(df: DataFrame, values: list[str], order: str, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_v")).select(*keys, "_v.*")


def wrapped_mean(df: DataFrame, height: int, width: int, value: str = "Intensity", skip: Column | None = None) -> DataFrame:
    """Mean of a value on the 1-based legacy grid: indexes one lower, negative ones wrapped around."""
    if skip is not None:
        df = df.where(~skip)
    y, x = F.pmod(F.col("y_pix") - 1, F.lit(height)), F.pmod(F.col("x_pix") - 1, F.lit(width))
    return df.groupBy(y.alias("y_pix"), x.alias("x_pix")).agg(F.avg(value).alias(value))


def canvas(df: DataFrame, height: int, width: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every pixel of the canvas, for each key combination of ``df``."""
    cells = df.sparkSession.range(height * width).select((F.col("id") / width).cast("int").alias("y_pix"), (F.col("id") % width).cast("int").alias("x_pix"))
    return df.select(*keys).distinct().crossJoin(cells) if keys else cells


def densify(df: DataFrame, height: int, width: int, fills: dict[str, object], keys: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """All pixels, with fill values where nothing was seen.  Only whole-image statistics need this."""
    joined = canvas(df, height, width, keys).join(df, [*keys, "y_pix", "x_pix"], "left")
    return joined.select(*keys, "y_pix", "x_pix", *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in fills.items()])


def look_up_pixels(points: DataFrame, raster: DataFrame, values: dict[str, object], keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Points with their pixel's values, or the given defaults outside the raster."""
    found = join_groups(points, raster.select(*keys, *values), list(keys), "left", nulls=False)
    return found.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def attach_labels(points: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("scan_id", "point_id")) -> DataFrame:
    """Points with the label of the same position, or an error if any is without its partner."""
    joined = points.withColumn("_p", F.lit(True)).join(labels.withColumn("_l", F.lit(True)), list(keys), "full")
    if not joined.where("_p is null or _l is null").isEmpty():
        raise ValueError("points and labels differ in length")
    return joined.drop("_p", "_l")


def look_up_dimension(df: DataFrame, dimension: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """A left join with defaults; label dimensions are small tables that Spark broadcasts by size."""
    return df.join(dimension, key, "left").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def match_palette(pixels: DataFrame, palette: list[tuple[int, int, int, int]], tolerance: int = 3) -> DataFrame:
    """class_id of the last palette entry (r, g, b, class) with every channel within the tolerance, else 0.

    A palette is a literal of a few entries, so the theta join is one CASE in the projection.
    """
    found = F.lit(0)
    for r, g, b, k in palette:
        near = (F.abs(F.col("r") - r) <= tolerance) & (F.abs(F.col("g") - g) <= tolerance) & (F.abs(F.col("b") - b) <= tolerance)
        found = F.when(near, F.lit(k)).otherwise(found)
    return pixels.withColumn("class_id", found)


def mask_difference(before: DataFrame, after: DataFrame, label: str = "class_id", keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """255 where two masks differ, else 0."""
    other = after.select(*keys, F.col(label).alias("_after"))
    return before.join(other, list(keys)).select(*keys, F.when(F.col(label) == F.col("_after"), 0).otherwise(255).alias("difference"))


def refined_pixels(points: DataFrame, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Pixels of points whose label was refined: both labels."""
    return points.where(F.col("label") != F.col("label_refined")).select(*keys, "label", "label_refined").distinct()


def median_blur(df: DataFrame, value: str, radius: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """Median over a square neighbourhood of each pixel, of the pixels that are there."""
    return raster_tiles.median(df, value, radius, keys)


def fill_from_nearest(pixels: DataFrame, label: str = "class_id", by: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """NULL labels take the label of the scan's nearest labelled pixel, the upper left one on a tie; a scan without labels keeps NULL."""
    from scanforge.operators.spatial import knn

    keys = [c for c in by if c in pixels.columns]
    known, open_ = pixels.where(F.col(label).isNotNull()), pixels.where(F.col(label).isNull())
    numbered = lambda df: df.select(*keys, (F.col("y_pix").cast("long") * (1 << 31) + F.col("x_pix")).alias("point_id"), F.col("x_pix").cast("double").alias("X"), F.col("y_pix").cast("double").alias("Y"))
    asked = numbered(open_)
    if keys:  # a scan without any label has nobody to ask
        asked = join_groups(asked, known.select(*keys).distinct(), keys, "left_semi", nulls=False)
    near = knn(asked, numbered(known), 1, 2.0, tuple(keys), ("X", "Y")).select(*keys, F.col("point_id").alias("_p"), F.col("nbr_id").alias("_n"))
    place = F.col("y_pix").cast("long") * (1 << 31) + F.col("x_pix")
    labels = known.select(*keys, place.alias("_n"), F.col(label).alias("_found"))
    found = near.join(labels, [*keys, "_n"]).drop("_n")
    filled = open_.withColumn("_p", place).join(found, [*keys, "_p"], "left")
    return known.unionByName(filled.withColumn(label, F.col("_found")).select(*pixels.columns))


def resample(raster: DataFrame, height: int, width: int, new_height: int, new_width: int, values: list[str], keys: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """A dense raster on another canvas: each new pixel takes the old one under its centre."""
    have = [k for k in keys if k in raster.columns]
    spots = canvas(raster, new_height, new_width, tuple(have)).withColumnsRenamed({"y_pix": "_y", "x_pix": "_x"})
    at = lambda c, n, m: F.least(F.floor((F.col(c) + 0.5) * n / m), F.lit(n - 1)).cast("int")
    asked = spots.withColumns({"y_pix": at("_y", height, new_height), "x_pix": at("_x", width, new_width)})
    joined = asked.join(raster.select(*have, "y_pix", "x_pix", *values), [*have, "y_pix", "x_pix"], "left")
    return joined.select(*have, F.col("_y").alias("y_pix"), F.col("_x").alias("x_pix"), *values)


#: Of each filter: how far it reaches in old (or if they are finer, new) pixels, and its weight at a distance.
FILTERS = {
    "bilinear": (1.0, lambda x: F.greatest(F.lit(0.0), 1 - x)),
    "bicubic": (2.0, lambda x: F.when(x < 1, 1 + x * x * (1.5 * x - 2.5)).when(x < 2, 2 + x * (-4 + x * (2.5 - 0.5 * x))).otherwise(0.0)),
}


def filter_weights(spark: SparkSession, old: int, new: int, kind: str = "bilinear") -> DataFrame:
    """(place, source, weight): how much each old pixel of a line adds to each new one; a new pixel's weights add up to 1."""
    support, weight = FILTERS[kind]
    scale = old / new
    wide = max(1.0, scale)
    centre = (F.col("id") + 0.5) * scale
    first, last = F.greatest(F.floor(centre - support * wide + 0.5), F.lit(0)), F.least(F.floor(centre + support * wide + 0.5), F.lit(old)) - 1
    rows = spark.range(new).select(F.col("id").cast("int").alias("place"), centre.alias("c"), F.explode(F.sequence(first, last)).alias("source"))
    rows = rows.select("place", F.col("source").cast("int").alias("source"), weight(F.abs((F.col("source") + 0.5 - F.col("c")) / wide)).alias("w"))
    return rows.select("place", "source", (F.col("w") / F.sum("w").over(Window.partitionBy("place"))).alias("weight"))  # a window holds one pixel's sources


def resize(raster: DataFrame, height: int, width: int, new_height: int, new_width: int, values: list[str], keys: tuple[str, ...] = ("scan_id",), kind: str = "bilinear", as_bytes: bool = False) -> DataFrame:
    """A dense raster on another canvas, smoothed by a separable filter as wide as the coarser pixels: rows first, then columns, one aggregate each.

    ``as_bytes``: round to 0-255 after each of the two, as images of bytes do.
    """
    have = [k for k in keys if k in raster.columns]
    out = raster.select(*have, "y_pix", "x_pix", *[F.col(v).cast("double").alias(v) for v in values])
    for line, kept, old, new in (("x_pix", "y_pix", width, new_width), ("y_pix", "x_pix", height, new_height)):
        weights = filter_weights(raster.sparkSession, old, new, kind)
        joined = out.join(F.broadcast(weights) if new + old < 100_000 else weights, F.col(line) == F.col("source"))  # some pixels of one line
        total = lambda v: F.sum(F.col(v) * F.col("weight"))
        made = (lambda v: F.least(F.greatest(F.floor(total(v) + 0.5), F.lit(0)), F.lit(255)).cast("double")) if as_bytes else total
        out = joined.groupBy(*have, kept, "place").agg(*[made(v).alias(v) for v in values]).withColumnRenamed("place", line)
    return out.select(*have, "y_pix", "x_pix", *values)


def unit_image(raster: DataFrame, values: list[str]) -> DataFrame:
    """An image's values in 0-1: bytes by 255, anything else by the image's own extremes where they lie outside."""
    kinds = dict(raster.dtypes)
    if all(kinds[v] in ("tinyint", "smallint", "int", "bigint") for v in values):
        return raster.withColumns({v: F.col(v) / 255 for v in values})
    both = raster.agg(F.min(F.least(*values) if len(values) > 1 else F.col(values[0])).alias("_lo"), F.max(F.greatest(*values) if len(values) > 1 else F.col(values[0])).alias("_hi"))
    spread = raster.crossJoin(F.broadcast(both))  # one row
    outside = (F.col("_lo") < 0) | (F.col("_hi") > 1)
    return spread.withColumns({v: F.when(outside, (F.col(v) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))).otherwise(F.col(v)) for v in values}).drop("_lo", "_hi")


def colour_ball(ball: DataFrame, image: DataFrame, height: int, width: int, zenith: tuple[float, float] = (0.0, 135.0), step: float = 0.5, upside_down: bool = False) -> DataFrame:
    """A ball's points (azimuth, zenith) with r, g, b in 0-1 of an image that is laid over it; ``image`` is dense, of ``height`` x ``width``.

    Images of bytes are resized by the bilinear filter; others are brought to 0-1, made bytes and resized by the bicubic one.
    """
    h, w = math.ceil((zenith[1] - zenith[0]) / step), math.ceil(360 / step)
    rgb, kinds = ["r", "g", "b"], dict(image.dtypes)
    whole = all(kinds[c] in ("tinyint", "smallint", "int", "bigint") for c in rgb)
    data = image if whole else unit_image(image, rgb).withColumns({c: F.floor(F.col(c) * 255) for c in rgb})
    sized = resize(data, height, width, h, w, rgb, (), "bilinear" if whole else "bicubic", True).withColumns({c: F.col(c) / 255 for c in rgb})
    low = ball.agg(F.min("zenith").alias("_low"))
    row = F.least(F.greatest(((F.col("zenith") - F.col("_low")) / step).cast("int"), F.lit(0)), F.lit(h - 1))
    placed = ball.drop("r", "g", "b").crossJoin(F.broadcast(low))  # one row
    placed = placed.withColumns({"y_pix": F.lit(h - 1) - row if upside_down else row, "x_pix": F.least(F.greatest((F.col("azimuth") / step).cast("int"), F.lit(0)), F.lit(w - 1))})
    return placed.join(sized, ["y_pix", "x_pix"], "left").drop("y_pix", "x_pix", "_low")


def align(foreign: DataFrame, like: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """A foreign frame with the columns and types of another; what it lacks takes its default, or 0."""
    have = set(foreign.columns)
    return foreign.select(*[(F.col(c) if c in have else F.lit(defaults.get(c, 0))).cast(t).alias(c) for c, t in like.dtypes])


def pseudo_rgb(df: DataFrame, channels: tuple[str, str, str], by: str | None = "scan_id") -> DataFrame:
    """Three channels, each scaled to 0-1 over the scan's image."""
    stats = {f"_{k}{i}": fn(c) for i, c in enumerate(channels) for k, fn in (("lo", F.min), ("hi", F.max))}
    scaled = {n: (F.col(c) - F.col(f"_lo{i}")) / (F.col(f"_hi{i}") - F.col(f"_lo{i}") + 1e-8) for i, (n, c) in enumerate(zip(("red", "green", "blue"), channels, strict=True))}
    return with_stats(df, scans_of(df, by), **stats).withColumns(scaled).drop(*stats)
