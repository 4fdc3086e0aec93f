"""Source schemas by data set, and label maps as dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of each data set, in the order of its files; nothing is inferred.
SCHEMAS = {
    "MANGROVE": "X double, Y double, Z double, zenith double, azimuth double, rangemeter double, Intensity int, `Return Number` int",
    "FORESTSEMANTIC": "X double, Y double, Z double, Intensity int, Classification int",
    "SEMANTIC3D": "X float, Y float, Z float, Intensity long, r short, g short, b short",
    "SEMANTICKITTI": "X float, Y float, Z float, Intensity float",
    "INLUT3D": "X double, Y double, Z double, r int, g int, b int, class_id int, instance_id int",
}

#: Fixed values: (vertical field of view, horizontal field of view, vertical and horizontal resolution) in degrees.
CANVASES = {
    "MANGROVE": ((0.0, 135.0), (0.0, 360.0), 0.25, 0.25),
    "FORESTSEMANTIC": ((10.0, 178.0), (0.0, 360.0), 0.2, 0.1),
    "SEMANTIC3D": ((45.0, 136.0), (0.0, 360.0), 0.2, 0.2),
    "INLUT3D": ((0.0, 150.0), (0.0, 360.0), 0.2929, 0.17578125),
}


def canvas_size(v_fov: tuple[float, float], h_fov: tuple[float, float], v_res: float, h_res: float) -> tuple[int, int]:
    """(height, width) in whole pixels."""
    return int((v_fov[1] - v_fov[0]) / v_res), int((h_fov[1] - h_fov[0]) / h_res)


def label_map(spark: SparkSession, path: str, dataset: str) -> tuple[DataFrame, DataFrame]:
    """(r, g, b, class_id) and (class_id, name) of one data set in a nested JSON label map."""
    maps = "map<string, struct<COLOR_TO_INDEX: map<string, int>, CLASS_NAMES: map<string, string>>>"
    entry = spark.read.schema(f"DATASETS {maps}").option("multiLine", True).json(path).select(F.col("DATASETS").getItem(dataset).alias("d"))
    colours = entry.select(F.explode("d.COLOR_TO_INDEX").alias("key", "class_id"))
    parts = F.transform(F.split("key", r"\s*,\s*"), lambda x: F.regexp_replace(x, r"[()\[\]]", "").cast("double"))
    scaled = F.when(F.array_max(parts) <= 1, F.transform(parts, lambda x: x * 255)).otherwise(parts)
    colours = colours.select(*[F.round(F.get(scaled, i)).cast("int").alias(c) for i, c in enumerate("rgb")], "class_id")
    names = entry.select(F.explode("d.CLASS_NAMES").alias("key", "name")).select(F.col("key").cast("int").alias("class_id"), "name")
    return colours, names


def colour_map(spark: SparkSession, path: str, below: int = 18) -> DataFrame:
    """(code, r, g, b) with colours in 0-1: codes under ``below``, divided by 255 if any value exceeds 1."""
    rows = spark.read.schema("code int, color array<double>").option("multiLine", True).json(path).where(F.col("code") < below)
    top = rows.agg(F.max(F.array_max("color")).alias("top"))
    scale = F.when(F.col("top") > 1, F.lit(255.0)).otherwise(F.lit(1.0))
    return rows.crossJoin(F.broadcast(top)).select("code", *[(F.get("color", i) / scale).alias(c) for i, c in enumerate("rgb")])
