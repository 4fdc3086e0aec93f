"""Density and roughness profiles of scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanforge.functions.geometry import PI
from scanforge.operators import quantile
from scanforge.operators.points import range_from_centre, with_stats
from scanforge.operators.quantile import known, quantiles, quantiles_of
from scanforge.operators.spatial import knn_among
from scanforge.tables import join_groups, join_on, numbered_within, written


def local_density(k: Column, radius: Column, volumetric: bool = True) -> Column:
    """k points within the ball (or disc) out to the k-th neighbour; NULL at distance 0."""
    space = 4 / 3 * PI * radius * radius * radius if volumetric else PI * radius * radius
    return k / F.nullif(space, F.lit(0.0))


def range_bins(df: DataFrame, width: float, merge: float, value: str = "range", by: tuple[str, ...] = ()) -> DataFrame:
    """bin and bin_centre: equal bins up to ``merge`` (a multiple of the width), one for all beyond, which ends at the scan's greatest value."""
    if abs(merge / width - round(merge / width)) > 1e-9:
        raise ValueError("the merge threshold must be a multiple of the bin width")
    last = round(merge / width)
    bin_ = F.least(F.floor(F.col(value) / width), F.lit(last)).cast("int")
    df = with_stats(df.withColumn("bin", bin_), by, _top=F.max(value))
    centre = F.when(F.col("bin") == last, (merge + F.col("_top")) / 2).otherwise((F.col("bin") + 0.5) * width)
    return df.withColumn("bin_centre", centre).drop("_top")


def binned_density(df: DataFrame, groups: tuple[str, ...], cell: float, k: Column, least_points: int = 10, least_k: int = 5, stride: Column | None = None, volumetric: bool = True) -> DataFrame:
    """(groups.., point_id, density) of sampled points, neighbours taken within the group.

    ``k`` and ``stride`` are expressions of ``n``, the group's size.  Points are numbered by id within
    their group; those whose number is divisible by the stride are sampled.
    """
    sized = join_groups(df.select(*groups, "point_id", "X", "Y", "Z"), df.groupBy(*groups).agg(F.count("*").alias("n")), list(groups))
    sized = sized.withColumn("k", k.cast("int")).where((F.col("n") >= least_points) & (F.col("k") >= least_k))
    placed = numbered_within(sized, list(groups), ["point_id"], row="i")
    sampled = F.lit(True) if stride is None else F.col("i") % stride == 0
    sized = written(placed.select(*groups, "point_id", "X", "Y", "Z", "n", "k", sampled.alias("sampled")), "density-bins")
    most = sized.agg(F.max("k")).first()[0]
    if most is None:
        return df.select(*groups, "point_id", F.lit(0.0).alias("density")).limit(0)
    near = knn_among(sized, most, cell, groups, "sampled")
    met = join_on(near, sized.select(*groups, "point_id", "k"), [*groups, "point_id"]).where(F.col("rank") == F.col("k"))
    return met.select(*groups, "point_id", local_density(F.col("k"), F.col("dist"), volumetric).alias("density"))


QUARTILES = {"median": 0.5, "q25": 0.25, "q75": 0.75}


def _quartiles(density: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    return quantiles(density, {n: (F.col("density"), p) for n, p in QUARTILES.items()}, groups)


def density_by_range(df: DataFrame, width: float, merge: float, cell: float, by: tuple[str, ...] = (), volumetric: bool = True, centre: tuple[float, float, float] | None = None) -> DataFrame:
    """median, q25, q75 of local density and the number of points in each range bin; NULL where bins are too small."""
    binned = range_bins(range_from_centre(df, centre, by), width, merge, by=by)
    groups = (*by, "bin")
    n = F.col("n")
    density = binned_density(binned, groups, cell, F.least(F.lit(50), F.floor(n / 2)), stride=F.greatest(F.lit(1), F.floor(n / 100)), volumetric=volumetric)
    counts = binned.groupBy(*groups).agg(F.count("*").alias("points"), F.max("bin_centre").alias("bin_centre"))
    return join_on(counts, _quartiles(density, groups), list(groups), "left")


def density_across_scans(per_scan: DataFrame, first_scan: str, scan: str = "scan_id") -> DataFrame:
    """Median and quartiles over scans of their medians, for the bins of the first scan and with their centres."""
    bins = per_scan.where(F.col(scan) == first_scan).select("bin", "bin_centre").distinct()
    wanted = {n: (F.col("median"), p) for n, p in QUARTILES.items()} | {"points": (F.col("points"), 0.5)}
    return quantiles(per_scan.join(bins, "bin", "left_semi"), wanted, ("bin",)).join(bins, "bin")


def density_by_height(df: DataFrame, width: float, cell: float, by: tuple[str, ...] = (), volumetric: bool = True) -> DataFrame:
    """by.., point_id, bin, label ("0.50m") and density of every point; bins start at the scan's least Z."""
    df = with_stats(df, by, _z=F.min("Z"))
    df = df.withColumn("bin", F.floor((F.col("Z") - F.col("_z")) / width).cast("int"))
    label = F.format_string("%.2fm", F.col("_z") + F.col("bin") * width)
    labels = df.select(*by, "bin", label.alias("label")).distinct()
    n = F.col("n")
    density = binned_density(df, (*by, "bin"), cell, F.least(F.lit(50), F.floor(n / 2)), volumetric=volumetric)
    return join_groups(density, labels, [*by, "bin"])


def density_by_height_sampled(df: DataFrame, cell: float, sample: int = 50_000, by: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """Density of about ``sample`` points of each scan, with k = min(50, n / 20)."""
    n = F.col("n")
    stride = F.greatest(F.lit(1), F.floor(n / sample))
    return binned_density(df, by, cell, F.least(F.lit(50), F.floor(n / 20)), stride=stride).join(df.select(*by, "point_id", "Z"), [*by, "point_id"])


def density_summary(df: DataFrame, density: str = "density") -> DataFrame:
    """One row: quartiles and extremes of the values that are there."""
    values = written(df.select(known(F.col(density)).alias("_d")), "densities")
    spans = values.agg(F.min("_d").alias("lowest"), F.max("_d").alias("highest"))
    return quantiles_of(values, {n: (F.col("_d"), p) for n, p in QUARTILES.items()}).crossJoin(spans)  # one row each


def value_by_label(df: DataFrame, value: str, label: str, scan: str) -> DataFrame:
    """Quartiles, IQR, p95, valid and NaN counts by label, for each scan and over all scans (NULL scan).

    The values are written once; if there are few enough for the built-in percentile one aggregate over both groupings gives all, else
    each grouping narrows its quantiles.
    """
    v = F.col(value).cast("double")
    rows = written(df.select(scan, label, known(v).alias("_v"), F.isnan(v).alias("_nan")), "label-values")
    shares = QUARTILES | {"p95": 0.95}
    counts = [F.count("_v").alias("valid"), F.count_if("_nan").alias("nan_count")]
    if rows.count() <= quantile.DIRECT:
        exact = [F.percentile("_v", F.lit(p)).alias(k) for k, p in shares.items()]
        both = rows.groupingSets([[scan, label], [label]], scan, label).agg(*exact, *counts)
    else:
        both = None
        for keys in ((scan, label), (label,)):
            q = quantiles_of(rows, {k: (F.col("_v"), p) for k, p in shares.items()}, keys)
            part = join_on(rows.groupBy(*keys).agg(*counts), q, list(keys), "left")
            part = part if scan in keys else part.withColumn(scan, F.lit(None).cast(dict(df.dtypes)[scan]))
            both = part if both is None else both.unionByName(part)
    return both.select(F.col(scan).cast("string").alias(scan), label, "median", (F.col("q75") - F.col("q25")).alias("iqr"), "p95", "q25", "q75", "valid", "nan_count")
