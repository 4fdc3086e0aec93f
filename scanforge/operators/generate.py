"""Synthetic shapes with known answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanforge.tables import join_groups


def ball(spark: SparkSession, step: int = 5, zenith: tuple[int, int] = (0, 180), line_every: int = 30) -> DataFrame:
    """Unit ball on an angular grid, one point each ``step`` degrees, with red parallels and blue meridians."""
    n_az, n_zen = 360 // step, (zenith[1] - zenith[0]) // step + 1
    grid = spark.range(n_az * n_zen).select(((F.col("id") % n_az) * step).cast("double").alias("azimuth"), (F.floor(F.col("id") / n_az) * step + zenith[0]).cast("double").alias("zenith"))
    a, z = F.radians("azimuth"), F.radians("zenith")
    near = lambda c: F.least(F.pmod(F.col(c), F.lit(float(line_every))), line_every - F.pmod(F.col(c), F.lit(float(line_every)))) <= 0.2
    return grid.select(
        "azimuth", "zenith", (F.sin(z) * F.cos(a)).alias("X"), (F.sin(z) * F.sin(a)).alias("Y"), F.cos(z).alias("Z"),
        F.when(near("zenith"), 255).otherwise(0).alias("r"), F.lit(0).alias("g"), F.when(near("azimuth"), 255).otherwise(0).alias("b"),
    )


def balls(points: DataFrame, by: tuple[str, ...] = ("scan_id",), step: int = 5, zenith: tuple[int, int] = (0, 180), line_every: int = 30) -> DataFrame:
    """by.. and ``ball``'s columns: a ball around each scan's centroid, as far out as the scan's points are on average."""
    centre = points.groupBy(*by).agg(*[F.avg(a).alias(f"_c{a}") for a in "XYZ"])
    placed = join_groups(points, centre, list(by))
    far = F.sqrt(sum((F.pow(F.col(a) - F.col(f"_c{a}"), 2) for a in "XYZ"), F.lit(0.0)))
    spans = placed.groupBy(*by).agg(*[F.first(f"_c{a}").alias(f"_c{a}") for a in "XYZ"], F.avg(far).alias("_far"))  # one row a scan
    shape = ball(points.sparkSession, step, zenith, line_every)
    return spans.crossJoin(F.broadcast(shape)).select(*by, "azimuth", "zenith", *[(F.col(f"_c{a}") + F.col("_far") * F.col(a)).alias(a) for a in "XYZ"], "r", "g", "b")  # a fixed grid for each scan


def cubes(points: DataFrame, by: tuple[str, ...] = ("scan_id",), samples: int = 10) -> DataFrame:
    """by.. and ``cube``'s columns: the faces of each scan's bounding box."""
    box = points.groupBy(*by).agg(*[fn(a).alias(f"_{k}{a}") for a in "XYZ" for k, fn in (("lo", F.min), ("hi", F.max))])  # one row a scan
    shape = cube(points.sparkSession, samples)
    middle = lambda a: (F.col(f"_lo{a}") + F.col(f"_hi{a}")) / 2
    return box.crossJoin(F.broadcast(shape)).select(*by, *[(middle(a) + (F.col(f"_hi{a}") - F.col(f"_lo{a}")) / 2 * F.col(a)).alias(a) for a in "XYZ"], "r", "g", "b")  # fixed faces for each scan


FACES = ((0, 1.0, 255, 0, 0), (0, -1.0, 0, 255, 0), (1, 1.0, 0, 0, 255), (1, -1.0, 255, 255, 0), (2, 1.0, 255, 0, 255), (2, -1.0, 0, 255, 255))


def cube(spark: SparkSession, samples: int = 10, half: float = 1.0) -> DataFrame:
    """Six coloured faces of samples x samples points."""
    rows = ", ".join(f"({axis}, {sign}D, {r}, {g}, {b})" for axis, sign, r, g, b in FACES)
    faces = spark.sql(f"SELECT * FROM VALUES {rows} AS f(axis, sign, r, g, b)")
    at = lambda c: (F.lit(-half) + c * (2 * half / (samples - 1)))
    grid = spark.range(samples * samples).select(at(F.col("id") % samples).alias("u"), at(F.floor(F.col("id") / samples)).alias("v"))
    pts = grid.crossJoin(F.broadcast(faces))  # six rows
    face, u, v = F.col("sign") * half, F.col("u"), F.col("v")
    return pts.select(
        F.when(F.col("axis") == 0, face).otherwise(u).alias("X"), F.when(F.col("axis") == 1, face).when(F.col("axis") == 0, u).otherwise(v).alias("Y"), F.when(F.col("axis") == 2, face).otherwise(v).alias("Z"), "r", "g", "b"
    )
