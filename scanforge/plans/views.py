"""Point views over the relational test tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as returns of three scans."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("scan_id"), F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"),
        (F.col("l_quantity") - 25.5).alias("X"), (F.col("l_extendedprice") / 1000 - 50).alias("Y"), ((F.col("l_partkey") % 100) / 10.0 - 4.95).alias("Z"),
        F.col("l_extendedprice").alias("Intensity"), F.col("l_linenumber").alias("class_id"),
    )


POINTS = """v1 AS (
  SELECT l_returnflag AS scan_id, l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_quantity - 25.5::DOUBLE AS X,
         l_extendedprice / 1000 - 50 AS Y, (l_partkey % 100) / 10.0::DOUBLE - 4.95::DOUBLE AS Z, l_extendedprice AS Intensity, l_linenumber AS class_id FROM lineitem)"""

#: With angles: rng, az, zen, el.
ANGLES = POINTS + """,
va AS (
  SELECT *, CASE WHEN az0 < 0 THEN az0 + 360 ELSE az0 END AS az, 90 - zen AS el FROM (
    SELECT *, degrees(atan2(Y, X)) AS az0, CASE WHEN rng > 0 THEN degrees(acos(greatest(-1, least(1, Z / rng)))) ELSE 0 END AS zen
    FROM (SELECT *, sqrt(X * X + Y * Y + Z * Z) AS rng FROM v1)))"""


def pixel_sql(height: int = 36, width: int = 72, res: float = 5.0) -> str:
    """With pixels: xp, yp."""
    return ANGLES + f""",
vp AS (
  SELECT *, least(greatest(trunc(az / {res}::DOUBLE)::INT, 0), {width - 1}) AS xp,
         least(greatest({height} - trunc((el - min(el) OVER (PARTITION BY scan_id)) / {res}::DOUBLE)::INT, 0), {height - 1}) AS yp FROM va)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points in the first three dimensions."""
    e = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("point_id"), *[F.get(e, i).cast("double").alias(c) for i, c in enumerate("XYZ")], (F.col("label") % 6).alias("class_id"), e
    )


VECTORS = """v2 AS (
  SELECT vec_id AS point_id, embedding[1]::DOUBLE AS X, embedding[2]::DOUBLE AS Y, embedding[3]::DOUBLE AS Z, label % 6 AS class_id, embedding FROM embeddings)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as returns: time of day is the azimuth, the user the elevation, the value the range."""
    return read(spark, sf_dir, "events").select(
        "event_id", ((F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")) / 240.0).alias("azimuth"), (F.col("user_id") % 90).cast("double").alias("elevation"),
        F.col("value").alias("rangemeter"), F.col("event_type"), "ts", "user_id",
    )


EVENTS = """v3 AS (
  SELECT event_id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 240.0::DOUBLE AS azimuth, (user_id % 90)::DOUBLE AS elevation, value AS rangemeter, event_type, ts, user_id FROM events)"""
