"""Operators on point tables: angles, cleaning, pixels, colours, rigid motions.

A frame holds one scan or many.  Minima, percentiles and means that belong to a scan are taken for each
value of ``by`` (scan_id where the frame has one), by one aggregate, and joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanforge.functions import geometry as g
from scanforge.operators.quantile import with_quantiles
from scanforge.tables import join_groups

ANGLES = ("azimuth", "zenith", "elevation", "rangemeter")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df``, or an error that names what is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def scans_of(df: DataFrame, by: str | None = "scan_id") -> str | None:
    """``by``, if the frame has such a column."""
    return by if by in df.columns else None


def with_stats(df: DataFrame, by: str | tuple[str, ...] | None = None, **stats: Column) -> DataFrame:
    """Adds aggregates of the whole frame, or of each ``by`` group (NULL is one), as columns."""
    aggs = [c.alias(n) for n, c in stats.items()]
    keys = [by] if isinstance(by, str) else list(by or ())
    if not keys:
        return df.crossJoin(F.broadcast(df.agg(*aggs)))  # one row
    return join_groups(df, df.groupBy(*keys).agg(*aggs), keys)


def add_angles(df: DataFrame) -> DataFrame:
    """Azimuth in [0, 360), zenith, elevation and range of Cartesian points."""
    require_columns(df, "X", "Y", "Z")
    if all(a in df.columns for a in ANGLES):
        raise ValueError("all angle columns are there already")
    x, y, z = F.col("X"), F.col("Y"), F.col("Z")
    df = df.withColumn("rangemeter", g.norm(x, y, z))
    df = df.withColumns({"azimuth": g.azimuth(x, y), "zenith": g.zenith(z, F.col("rangemeter"))})
    return df.withColumn("elevation", 90 - F.col("zenith"))


def flip_upside_down(df: DataFrame, flip: bool = True) -> DataFrame:
    """A hanging scanner: Z and elevation change sign."""
    if not flip:
        return df.withColumn("elevation", 90 - F.col("zenith"))
    return df.withColumns({"Z": -F.col("Z"), "elevation": F.col("zenith") - 90})


def cut_outliers(df: DataFrame, cut_percent: float, lows: dict[str, float] | None = None, by: str | None = "scan_id") -> DataFrame:
    """Rows with every named column between its low and its upper percentile of the uncut scan, both included."""
    lows = lows or {"rangemeter": 0.01, "Intensity": 0.001}
    scan = scans_of(df, by)
    tops = {f"_top_{c}": (F.col(c), 1 - cut_percent / 100) for c in lows}
    keep = reduce(lambda a, b: a & b, [F.col(c).between(F.lit(low), F.col(f"_top_{c}")) for c, low in lows.items()])
    return with_quantiles(df, tops, (scan,) if scan else ()).where(keep).drop(*tops)


def normalise_intensity(df: DataFrame, col: str = "Intensity", by: str | None = "scan_id") -> DataFrame:
    """Min-max over the scan's rows that are not missing."""
    value = F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))
    df = with_stats(df.withColumn(col, value), scans_of(df, by), _lo=F.min(col), _hi=F.max(col))
    return df.withColumn(col, g.min_max(F.col(col), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Rows without NULL or NaN in any column."""
    numbers = [c for c, t in df.dtypes if t in ("double", "float")]
    df = df.dropna("any")
    return df.where(reduce(lambda a, b: a & b, [~F.isnan(c) for c in numbers])) if numbers else df


def to_float(df: DataFrame) -> DataFrame:
    """Measured columns in single precision, as older exports have them; computing stays in double precision before."""
    return df.withColumns({c: F.col(c).cast("float") for c, t in df.dtypes if t == "double"})


def clean(df: DataFrame, cut_percent: float, by: str | None = "scan_id") -> DataFrame:
    """Outlier cut, return number dropped, intensity to 0-1, incomplete rows dropped; each scan by its own statistics."""
    kept = cut_outliers(df, cut_percent, by=by).drop("Return Number", "return_number")
    return kept.transform(normalise_intensity, by=by).transform(drop_incomplete)


def to_pixels(df: DataFrame, height: int, width: int, v_res: float, h_res: float, by: str | None = "scan_id") -> DataFrame:
    """x_pix and y_pix on the angular canvas; rows are counted from each scan's lowest elevation."""
    df = with_stats(df, by, _low=F.min("elevation"))
    pixels = {"x_pix": g.pixel_x(F.col("azimuth"), h_res, width), "y_pix": g.pixel_y(F.col("elevation"), F.col("_low"), v_res, height)}
    return df.withColumns(pixels).drop("_low")


def to_pixels_legacy(df: DataFrame, height: int, width: int, upside_down: bool = False, low: float = 0.0, high: float = float("inf")) -> DataFrame:
    """The older map: shares of 360 and 135 degrees, after a range filter."""
    y = F.col("zenith") / 135 * (height - 1)
    y = F.lit(height - 1) - y if upside_down else y
    df = df.where(F.col("rangemeter").between(low, high))
    return df.withColumns({"x_pix": g.clip((F.col("azimuth") / 360 * (width - 1)).cast("int"), 0, width - 1), "y_pix": g.clip(y.cast("int"), 0, height - 1)})


def polar_pixels(df: DataFrame) -> DataFrame:
    """Fish-eye map: zenith is the radius around (180, 180); rounds half to even."""
    az = F.radians("azimuth")
    return df.withColumns({"row": F.bround(F.col("zenith") * F.cos(az) * 2 + 180).cast("int"), "column": F.bround(F.col("zenith") * F.sin(az) * 2 + 180).cast("int")})


def invert_height(df: DataFrame, floor: float = 0.01, by: str | None = "scan_id") -> DataFrame:
    """Z becomes its depth under the scan's lowest point; then Z and Intensity are scaled to floor .. 1."""
    df = with_stats(df, scans_of(df, by), _z0=F.min("Z"), _z1=F.max("Z"), _i0=F.min("Intensity"), _i1=F.max("Intensity"))
    depth = F.col("_z0") - F.col("Z")  # its extremes follow from those of Z, so one pass serves
    z = floor + (1 - floor) * g.min_max(depth, F.col("_z0") - F.col("_z1"), F.lit(0.0))
    i = floor + (1 - floor) * g.min_max(F.col("Intensity"), F.col("_i0"), F.col("_i1"))
    return df.withColumns({"Z": z, "Intensity": i}).drop("_z0", "_z1", "_i0", "_i1")


def invalid_counts(df: DataFrame, names: tuple[str, ...] = ("Intensity", "azimuth", "zenith", "rangemeter")) -> DataFrame:
    """One row: how many values of each column are missing or negative."""
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.col(c) < 0)
    return df.agg(*[F.count_if(bad(c)).alias(f"bad_{c}") for c in names])


def assert_valid(df: DataFrame) -> DataFrame:
    """``df``, or an error if a needed value is missing or negative."""
    found = {k: v for k, v in invalid_counts(df).first().asDict().items() if v}
    if found:
        raise ValueError(f"invalid values: {found}")
    return df


def drop_class(df: DataFrame, class_id: int = 7, col: str = "class_id") -> DataFrame:
    """For use after ``to_pixels``, whose lowest elevation still sees the class."""
    return df.where(F.col(col) != class_id)


def unit_rgb(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c) / 255 for c in "rgb"})


def normal_colours(df: DataFrame, by: str | None = "scan_id") -> DataFrame:
    """n_r, n_g, n_b from nx, ny, nz: direction as hue, tilt as value; a scan is flipped if its mean nz is negative."""
    rounded = df.withColumns({c: F.round(c, 5) for c in ("nx", "ny", "nz")})
    rounded = with_stats(rounded, scans_of(df, by), _up=F.avg("nz"))
    nz = F.when(F.col("_up") < 0, -F.col("nz")).otherwise(F.col("nz"))
    hue = (F.atan2("ny", "nx") + g.PI) / (2 * g.PI)
    value = (F.asin(nz) + g.PI / 2) / g.PI
    colours = g.hsv_to_rgb(hue, F.lit(0.6), value)
    return rounded.withColumns(dict(zip(("n_r", "n_g", "n_b"), colours, strict=True))).drop("_up")


def check_normals(df: DataFrame) -> DataFrame:
    """``df``, or an error if a component is missing or outside -1 .. 1."""
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(c) | (F.abs(F.round(c, 5)) > 1) for c in ("nx", "ny", "nz")])
    if not df.where(bad).isEmpty():
        raise ValueError("normals with missing components or components outside -1 .. 1")
    return df


def range_from_centre(df: DataFrame, centre: tuple[float, float, float] | None = None, by: str | tuple[str, ...] | None = "scan_id") -> DataFrame:
    """``range`` to a point, by default the scan's centroid."""
    if centre is None:
        df = with_stats(df, scans_of(df, by) if isinstance(by, str) else by, _x=F.avg("X"), _y=F.avg("Y"), _z=F.avg("Z"))
        c = (F.col("_x"), F.col("_y"), F.col("_z"))
    else:
        c = tuple(map(F.lit, centre))
    return df.withColumn("range", g.norm(F.col("X") - c[0], F.col("Y") - c[1], F.col("Z") - c[2])).drop("_x", "_y", "_z")


def rotate_xy(df: DataFrame, matrix: tuple[tuple[float, float], tuple[float, float]]) -> DataFrame:
    """The upper 2 x 2 of a rotation about Z."""
    (a, b), (c, d) = matrix
    return df.withColumns({"X": F.col("X") * a + F.col("Y") * b, "Y": F.col("X") * c + F.col("Y") * d})


def replace_ground(df: DataFrame, ground: DataFrame, matrix: tuple, ground_class: int = 1, col: str = "class_id") -> DataFrame:
    """Another sample of the ground in place of this frame's, then rotated."""
    return rotate_xy(df.where(F.col(col) != ground_class).unionByName(ground, allowMissingColumns=True), matrix)


def recentre(df: DataFrame, positions: DataFrame, z_shift: float | None = None, by: str | None = None) -> DataFrame:
    """A copy of the frame around each position (position_id, tx, ty); Z from its mean, or by ``z_shift``.

    Scanner positions are a handful; more than 10 000 are refused rather than broadcast.
    """
    if positions.limit(10_001).count() > 10_000:
        raise ValueError("more than 10 000 positions")
    shift = F.lit(z_shift) if z_shift is not None else F.col("_z")
    frame = df if z_shift is not None else with_stats(df, by, _z=F.avg("Z"))
    moved = frame.crossJoin(F.broadcast(positions))
    return moved.withColumns({"X": F.col("X") - F.col("tx"), "Y": F.col("Y") - F.col("ty"), "Z": F.col("Z") - shift}).drop("tx", "ty", "_z")


def to_uint16(df: DataFrame, col: str = "Intensity", by: str | None = "scan_id") -> DataFrame:
    """Integer intensity, times 65535 in scans where none exceeds 1."""
    df = with_stats(df, scans_of(df, by), _top=F.max(col))
    return df.withColumn(col, F.when(F.col("_top") <= 1, F.col(col) * 65535).otherwise(F.col(col)).cast("int")).drop("_top")


def rename(df: DataFrame, names: dict[str, str], order: list[str] | None = None) -> DataFrame:
    df = df.withColumnsRenamed(names)
    return df.select(*order) if order else df


def select_channels(df: DataFrame, channels: list[str], keys: tuple[str, ...] = ("scan_id", "y_pix", "x_pix")) -> DataFrame:
    """Keys and channels, or an error that lists what there is."""
    missing = [c for c in channels if c not in df.columns]
    if missing:
        raise ValueError(f"no channels {missing}; there are {list_channels(df, keys)}")
    return df.select(*[k for k in keys if k in df.columns], *channels)


def list_channels(df: DataFrame, keys: tuple[str, ...] = ("scan_id", "y_pix", "x_pix")) -> list[str]:
    return [c for c in df.columns if c not in keys]


COLOUR_GROUPS = {
    "izr": ("intensity_adjusted", "z_inv_adjusted", "range_adjusted"),
    "normals": ("n_r", "n_g", "n_b"),
    "pca": ("PCA1", "PCA2", "PCA3"),
    "true_rgb": ("r", "g", "b"),
}


def colour_group(df: DataFrame, group: str) -> list[str]:
    """The three channels of a named group."""
    if group not in COLOUR_GROUPS:
        raise ValueError(f"unknown colour group {group!r}; there are {sorted(COLOUR_GROUPS)}")
    return select_channels(df, list(COLOUR_GROUPS[group]), ()).columns


def column_profile(df: DataFrame, names: list[str]) -> DataFrame:
    """column, n, lowest, highest and mean of numeric columns, from one pass."""
    stats = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.min(F.col(c).cast("double")).alias("lowest"), F.max(F.col(c).cast("double")).alias("highest"), F.avg(c).alias("mean")) for c in names]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def spherical(df: DataFrame) -> DataFrame:
    """rho, theta (radians from the plane Z = 0) and phi of Cartesian points, as older scripts have them."""
    flat = F.col("X") * F.col("X") + F.col("Y") * F.col("Y")
    return df.withColumns({"rho": F.sqrt(flat + F.col("Z") * F.col("Z")), "theta": F.atan2(F.col("Z"), F.sqrt(flat)), "phi": F.atan2("Y", "X")})


def polar_cut(df: DataFrame, radius: float) -> DataFrame:
    """``spherical`` points within a distance of the scanner."""
    return spherical(df).where(F.col("rho") <= radius)


def cylinder(df: DataFrame, radius: float, half: bool = False) -> DataFrame:
    """Cylindrical coordinates rho, phi within a radius; with ``half``, of Y >= 0."""
    df = df.withColumns({"rho": F.sqrt(F.col("X") * F.col("X") + F.col("Y") * F.col("Y")), "phi": F.atan2("Y", "X")})
    return df.where((F.col("rho") <= radius) & (F.col("Y") >= 0 if half else F.lit(True)))


def first_returns(df: DataFrame, low: float = 50, high: float = 1000) -> DataFrame:
    """First returns with an intensity between two bounds, both left out."""
    return df.where((F.col("return_number") == 1) & (F.col("Intensity") > low) & (F.col("Intensity") < high))
