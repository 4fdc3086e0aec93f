"""Counts, shares, histograms and other whole-frame summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanforge.functions import geometry as g
from scanforge.operators.points import with_stats
from scanforge.tables import join_on, written


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def class_shares(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and shares of the total (of each ``by`` group); the window runs over the aggregated classes."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def rare_and_major(df: DataFrame, label: str, threshold: float) -> DataFrame:
    return class_shares(df, label).withColumn("kind", F.when(F.col("share") < threshold, "rare").otherwise("major"))


def before_after(df: DataFrame, before: str, after: str) -> DataFrame:
    """Counts of each label of either column before and after, the difference and the change in percent."""
    both = df.select(F.explode(F.array(F.struct(F.lit(0).alias("w"), F.col(before).alias("label")), F.struct(F.lit(1).alias("w"), F.col(after).alias("label")))).alias("x"))
    counts = both.groupBy(F.col("x.label").alias("label")).agg(F.count_if(F.col("x.w") == 0).alias("original"), F.count_if(F.col("x.w") == 1).alias("refined"))
    difference = F.col("refined") - F.col("original")
    return counts.select("*", difference.alias("difference"), (difference * 100 / F.nullif("original", F.lit(0))).alias("percent"))


def histogram(df: DataFrame, value: str, bins: int = 20, by: str | None = None) -> DataFrame:
    """bin, low edge (4 digits) and count; empty bins included."""
    known = df.where(F.col(value).isNotNull())
    known = with_stats(known, by, _lo=F.min(value).cast("double"), _hi=F.max(value).cast("double"))
    keys = [by] if by else []
    counts = known.groupBy(*keys, "_lo", "_hi", g.bin_of(F.col(value), F.col("_lo"), F.col("_hi"), bins).alias("bin")).agg(F.count("*").alias("n"))
    frames = counts.groupBy(*keys, "_lo", "_hi").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))  # as many entries as bins
    full = frames.select(*keys, "_lo", "_hi", "m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    edge = F.round(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("bin") / bins, 4)
    return full.select(*keys, "bin", edge.alias("edge"), F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0)).alias("n"))


def exact_or_binned(df: DataFrame, value: str, most: int = 20) -> DataFrame:
    """Counts and shares by value if there are at most ``most`` values, else by ``most`` equal bins."""
    few = df.select(value).distinct().limit(most + 1).count() <= most
    counts = df.groupBy(F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n")) if few else histogram(df, value, most).select(F.col("edge").alias("value"), "n")
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def top_and_other(df: DataFrame, value: str, top: int = 9) -> DataFrame:
    """The most frequent values and "Other", if there are more than ``top`` + 1: a top-n and a subtraction, no ranking of all values."""
    counts = written(df.groupBy(F.col(value).cast("string").alias("value")).agg(F.count("*").alias("n")), "value-counts")
    few = counts.limit(top + 2).count() <= top + 1
    if few:
        return counts
    best = counts.orderBy(F.col("n").desc(), "value").limit(top)
    both = counts.agg(F.sum("n").alias("_n")).crossJoin(best.agg(F.sum("n").alias("_top")))  # one row each
    return best.unionByName(both.select(F.lit("Other").alias("value"), (F.col("_n") - F.col("_top")).alias("n")))


def density_classes(pixels: DataFrame, density: str = "density") -> DataFrame:
    """Pixels with 0, 1, 2 and more returns."""
    return pixels.groupBy(F.least(F.col(density), F.lit(3)).cast("int").alias("density_class")).agg(F.count("*").alias("n"))


def grid_counts(df: DataFrame, bins: int = 512, x: str = "X", y: str = "Y", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts on a square grid of equal-width bins over the extent of the frame, or of each group."""
    df = with_stats(df, by, _x0=F.min(x), _x1=F.max(x), _y0=F.min(y), _y1=F.max(y))
    return df.groupBy(*by, g.bin_of(F.col(x), F.col("_x0"), F.col("_x1"), bins).alias("gx"), g.bin_of(F.col(y), F.col("_y0"), F.col("_y1"), bins).alias("gy")).agg(F.count("*").alias("n"))


def inverted_grid(counts: DataFrame, bins: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The dense grid (of each group) inverted and scaled to 0-255: empty cells are brightest."""
    cells = counts.sparkSession.range(bins * bins).select((F.col("id") / bins).cast("int").alias("gx"), (F.col("id") % bins).cast("int").alias("gy"))
    if by:
        cells = counts.select(*by).distinct().crossJoin(F.broadcast(cells))  # bins * bins rows for each group, as wanted
    dense = join_on(cells, counts, [*by, "gx", "gy"], "left").select(*by, "gx", "gy", F.coalesce("n", F.lit(0)).alias("n"))
    dense = with_stats(dense, by, _hi=F.max("n"), _lo=F.min("n"))
    grey = F.floor((F.col("_hi") - F.col("n")) * 255 / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0)))
    return dense.select(*by, "gx", "gy", F.coalesce(grey, F.lit(0)).cast("int").alias("grey"))


def channel_values(df: DataFrame, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """How often each value occurs in any channel."""
    return df.select(F.explode(F.array(*channels)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def colour_domain(df: DataFrame, value: str, keys: list[int]) -> DataFrame:
    """(value, n, n_colours) for the image's values and the map's keys together, keys that do not occur with 0; n_colours is the size of the colour table."""
    known = df.sparkSession.createDataFrame([(k,) for k in keys], "value long")
    counts = df.groupBy(F.col(value).cast("long").alias("value")).agg(F.count("*").alias("n"))
    both = known.join(counts, "value", "full").select("value", F.coalesce("n", F.lit(0)).alias("n"))
    return both.crossJoin(F.broadcast(both.agg((F.max("value") + 1).alias("n_colours"))))  # one row


def bounding_box(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*[fn(c).alias(f"{n}_{c.lower()}") for c in "XYZ" for n, fn in (("min", F.min), ("max", F.max))])


def adaptive_radius(df: DataFrame, target: int = 30) -> DataFrame:
    """One row: the radius of a ball that holds ``target`` points at the bounding box's mean density."""
    box = df.agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in "XYZ"])
    volume = F.greatest(F.col("X") * F.col("Y") * F.col("Z"), F.lit(1e-9))
    return box.select("n", F.pow(F.lit(3.0 * target) / (4 * g.PI) * volume / F.col("n"), F.lit(1 / 3)).alias("radius"))


def counts_by_kind(df: DataFrame, *keys: str) -> DataFrame:
    """Counts for every combination of keys and every subtotal (NULL keys)."""
    return df.cube(*keys).agg(F.count("*").alias("n"))


def region_totals(df: DataFrame, region: str) -> DataFrame:
    """Points by region, and in total (NULL region)."""
    return df.rollup(region).agg(F.count("*").alias("n"))


def changed(before: str, after: str) -> Column:
    """Number of rows whose label changed."""
    return F.count_if(~F.col(before).eqNullSafe(F.col(after)))
