"""Line-oriented scans, label vectors and reports.

Rows get their place in their file as ``point_id``: lines are numbered within each split and the
splits of a file are offset by their line counts, so no window spans a file.
"""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanforge.operators.points import add_angles, to_float
from scanforge.operators.raster import attach_labels
from scanforge.schema import SCHEMAS


def scan_name(spark: SparkSession, path: str | list[str]) -> Column:
    """A file's path below the folder that was read, so that files of one name in two folders stay apart; the name alone for a file."""
    jvm, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    roots = []
    for one in [path] if isinstance(path, str) else path:
        fixed = re.split(r"[*?\[{]", one)[0]
        fixed = one if fixed == one else fixed.rsplit("/", 1)[0] or "/"
        target = jvm.Path(fixed)
        system = target.getFileSystem(conf)
        uri = system.makeQualified(target).toUri().toString().rstrip("/")
        roots.append(uri if system.exists(target) and system.getFileStatus(target).isDirectory() else uri.rsplit("/", 1)[0])
    root = re.sub(r"^file:/+", "file:///", os.path.commonpath([r.replace("://", ":/") for r in roots]).replace(":/", "://", 1) if len(roots) > 1 else roots[0])
    full = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:///")
    below = F.when(full.startswith(root + "/"), F.substr(full, F.lit(len(root) + 2))).otherwise(F.col("_metadata.file_name"))
    return F.url_decode(F.replace(below, F.lit("+"), F.lit("%2B"))).alias("scan_id")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """scan_id (path below what was read), point_id (from 0) and value of every line."""
    meta = "_metadata"
    lines = spark.read.text(path).select(
        scan_name(spark, path), F.col(f"{meta}.file_path").alias("_f"), F.col(f"{meta}.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"), "value"
    )
    blocks = lines.groupBy("_f", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = lines.join(blocks, ["_f", "_b"])
    place = F.col("_o") + F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_i")) - 1
    return placed.select("scan_id", place.cast("long").alias("point_id"), "value")


def _parsed(field: Column, kind: str, name: str) -> Column:
    """A field's value; an empty one is NULL, whole-number decimals are whole numbers, anything else stops the job by name."""
    text = F.nullif(F.trim(F.replace(field, F.lit('"'), F.lit(""))), F.lit(""))
    number = text.try_cast("double")
    if kind in ("int", "long", "short"):
        value = F.coalesce(text.try_cast(kind), F.when(number == F.floor(number), number).try_cast(kind))
    else:
        value = number.cast(kind)
    wrong = text.isNotNull() & value.isNull() & ~F.lower(text).isin("nan", "null", "na")
    return F.when(wrong, F.raise_error(F.concat(F.lit(f"column {name}: not a {kind}: "), text)).cast(kind)).otherwise(value).alias(name)


def _columns(schema: str) -> list[tuple[str, str]]:
    return [(n.strip("`"), t) for n, t in (c.strip().rsplit(" ", 1) for c in schema.split(","))]


def _fields(lines: DataFrame, schema: str, separator: str) -> DataFrame:
    parts = F.split(F.trim("value"), separator)
    return lines.select("scan_id", "point_id", *[_parsed(F.get(parts, i), t, n) for i, (n, t) in enumerate(_columns(schema))])


def _named_fields(lines: DataFrame, columns: list[tuple[str, str]], header: Column, separator: str = r"\s*,\s*", needed: bool = True) -> DataFrame:
    """Fields by the names in each file's first line, in any order and case, and by position in files without such a line.

    ``header``: whether a first line is one.  Point numbers leave the header out.  With ``needed`` a file without a header, or
    whose header lacks a column, stops the job.
    """
    first = (F.col("point_id") == 0) & header
    names = lines.where(first).select("scan_id", F.transform(F.split(F.trim("value"), separator), lambda x: F.lower(F.trim(F.replace(x, F.lit('"'), F.lit(""))))).alias("_names"))
    rows = lines.where(~first).join(names, "scan_id", "left")
    parts = F.split(F.trim("value"), separator)

    def field(i: int, name: str, kind: str) -> Column:
        at = F.array_position("_names", F.lit(name.lower())) - 1
        missing = F.raise_error(F.concat(F.lit(f"missing columns: ['{name}'] in "), F.col("scan_id"))).cast("string")
        found = F.when(at >= 0, F.get(parts, at)).otherwise(missing)
        return _parsed(F.when(F.col("_names").isNull(), missing if needed else F.get(parts, i)).otherwise(found), kind, name)

    number = F.col("point_id") - F.when(F.col("_names").isNull(), 0).otherwise(1)
    return rows.select("scan_id", number.cast("long").alias("point_id"), *[field(i, n, t) for i, (n, t) in enumerate(columns)])


_LETTERS = r"[A-Za-z_]{2}|^[^0-9.+-]*[A-Za-z_]\s*,"


def read_mangrove(spark: SparkSession, path: str | list[str], flip: bool = False, header_row_lost: bool = False) -> DataFrame:
    """Comma-separated scans with or without a header, whose order counts; elevation is derived.

    A header is a first line with letters.  ``header_row_lost`` drops the first row of files
    without one, as older tools did.
    """
    header = F.col("value").rlike(_LETTERS) & ~F.lower("value").rlike("nan")
    lines = numbered_lines(spark, path)
    lines = lines.where(F.lit(not header_row_lost) | (F.col("point_id") > 0) | header)
    df = _named_fields(lines, _columns(SCHEMAS["MANGROVE"]), header, needed=False)
    if flip:
        return df.withColumns({"Z": -F.col("Z"), "elevation": F.col("zenith") - 90})
    return df.withColumn("elevation", 90 - F.col("zenith"))


def read_forest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Five columns of comma-separated files with headers; the class is class_id, as in every other frame."""
    df = _named_fields(numbered_lines(spark, path), _columns(SCHEMAS["FORESTSEMANTIC"]), F.lit(True))
    return df.withColumnRenamed("Classification", "class_id")


def read_pts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """White-space separated points after a count line; Intensity is the mean colour."""
    df = _fields(numbered_lines(spark, path).where("point_id > 0"), SCHEMAS["INLUT3D"], r"\s+")
    return df.withColumns({"point_id": F.col("point_id") - 1, "Intensity": (F.col("r") + F.col("g") + F.col("b")) / 3 / 255})


def read_labels(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One integer a line."""
    return numbered_lines(spark, path).select("scan_id", "point_id", _parsed(F.col("value"), "int", "label"))


def read_semantic3d(spark: SparkSession, path: str | list[str], labels: str | None = None) -> DataFrame:
    """White-space separated points, with the labels of the file of the same stem."""
    df = _fields(numbered_lines(spark, path), SCHEMAS["SEMANTIC3D"], r"\s+")
    if labels is None:
        return df
    stem = F.regexp_replace("scan_id", r"\.[^./]*$", "")
    return attach_labels(df.withColumn("scan_id", stem), read_labels(spark, labels).withColumn("scan_id", stem))


def read_features(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """Row numbers and named numeric columns of comma-separated files with headers, in any case; an error names the missing ones."""
    first = spark.read.text(path).where("_metadata.file_block_start = 0").limit(1).first()  # some file's first line
    have = [] if first is None else [c.strip().strip('"').lower() for c in first["value"].split(",")]
    missing = [c for c in columns if c.lower() not in have]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return _named_fields(numbered_lines(spark, path), [(c, "double") for c in columns], F.lit(True))


def read_xyz(spark: SparkSession, path: str | list[str], x: str = "X", y: str = "Y", z: str = "Z") -> DataFrame:
    """Points of comma-separated files whose coordinates go by other names."""
    return read_features(spark, path, [x, y, z]).select("scan_id", "point_id", F.col(x).alias("X"), F.col(y).alias("Y"), F.col(z).alias("Z"))


def read_labelled(spark: SparkSession, path: str, labels: str, columns: list[str]) -> DataFrame:
    """Features with the label vector of the same stem; an error if lengths differ."""
    stem = F.regexp_replace("scan_id", r"\.[^./]*$", "")
    points = read_features(spark, path, columns).withColumn("scan_id", stem)
    return attach_labels(points, read_labels(spark, labels).withColumn("scan_id", stem))


def read_class_ids(spark: SparkSession, paths: list[str], column: str = "class_id") -> DataFrame:
    """(scan_id, point_id, class_id) of comma-separated files and of label vectors together, told apart by their ending."""
    vectors = [p for p in paths if p.endswith(".label") or p.endswith(".labels")]
    tables = [p for p in paths if p not in vectors]
    parts = [read_features(spark, tables, [column]).select("scan_id", "point_id", F.col(column).cast("int").alias("class_id"))] if tables else []
    if vectors:
        parts.append(read_labels(spark, vectors).withColumnRenamed("label", "class_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_raw_scans(spark: SparkSession, path: str) -> DataFrame:
    """(scan_id, value) of raw scanner files, for ``operators.decode``."""
    return spark.read.text(path, wholetext=True).select(scan_name(spark, path), "value")


READERS = {"MANGROVE": read_mangrove, "FORESTSEMANTIC": read_forest, "INLUT3D": read_pts, "SEMANTIC3D": read_semantic3d}


def read_points(spark: SparkSession, path: str | list[str], dataset: str) -> DataFrame:
    """Reader by data set, with angles where the file has none."""
    from scanforge.sources import binary

    readers = READERS | {"SEMANTICKITTI": binary.read_kitti, "HARVARD_FOREST": binary.read_las}
    if dataset.upper() not in readers:
        raise ValueError(f"unknown data set {dataset!r}; there are {sorted(readers)}")
    df = readers[dataset.upper()](spark, path)
    return df if "zenith" in df.columns else add_angles(df)


def write_points(df: DataFrame, path: str, single: bool = True) -> None:
    """Comma-separated with a header, a folder for each scan; measured columns in single precision, unless ``single`` is off."""
    (to_float(df) if single else df).write.mode("overwrite").partitionBy("scan_id").option("header", True).csv(path)


def write_labels(df: DataFrame, path: str, label: str = "label") -> None:
    """One integer a line in row order: range-partitioned, so parts follow each other by name."""
    ordered = df.repartitionByRange(max(1, df.sparkSession.sparkContext.defaultParallelism), "scan_id", "point_id").sortWithinPartitions("scan_id", "point_id")
    ordered.select("scan_id", F.col(label).cast("string").alias("value")).write.mode("overwrite").partitionBy("scan_id").text(path)


def write_formatted(df: DataFrame, path: str, pattern: str = "%.6f %.6f %.6f %d %d %d %d", columns: tuple[str, ...] = ("X", "Y", "Z", "Intensity", "r", "g", "b")) -> None:
    df.select(F.format_string(pattern, *columns).alias("value")).write.mode("overwrite").text(path)


def write_ascii_pcd(df: DataFrame, path: str, columns: tuple[str, ...] = ("X", "Y", "Z", "Intensity")) -> None:
    """ASCII PCD: the header comes first because it is the first range."""
    n = df.count()
    names = " ".join(c.lower() for c in columns)
    k = len(columns)
    head = ["# .PCD v0.7 - Point Cloud Data file format", "VERSION 0.7", f"FIELDS {names}", "SIZE" + " 4" * k, "TYPE" + " F" * k, "COUNT" + " 1" * k, f"WIDTH {n}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {n}", "DATA ascii"]
    rows = df.select(F.format_string(" ".join(["%.6f"] * k), *[F.col(c).cast("double") for c in columns]).alias("value"))
    first = df.sparkSession.createDataFrame([("\n".join(head),)], "value string")
    first.coalesce(1).unionByName(rows).write.mode("overwrite").text(path)


def write_profile(path: str, by_range: DataFrame, per_scan: DataFrame | None = None, vertical: DataFrame | None = None, **metadata: object) -> None:
    """Density profiles as CSV folders: medians and quartiles by range; (scan_id, bin_centre, density); (scan_id, height, density); and their metadata as JSON."""
    tables = {"density_vs_range": by_range, "density_vs_range_per_scan": per_scan, "vertical_density": vertical}
    tables = {k: t for k, t in tables.items() if t is not None}
    for name, table in tables.items():
        table.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    scans = per_scan.select("scan_id").distinct().count() if per_scan is not None else 1
    about = {"mode": "single" if per_scan is None else "aggregate", "n_scans": scans, "tables": {k: ", ".join(f"`{c}` {kind}" for c, kind in t.dtypes) for k, t in tables.items()}} | metadata
    by_range.sparkSession.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def read_profile(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict[str, object]]:
    """The tables by name, and the metadata."""
    about = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    return {k: spark.read.schema(schema).option("header", True).csv(f"{path}/{k}") for k, schema in about["tables"].items()}, about


def write_decoded(returns: DataFrame, path: str) -> None:
    """Decoded returns as comma-separated lines X, Y, Z, zenith, azimuth, range, intensity, return number, a folder for each scan."""
    line = F.concat_ws(",", "X", "Y", "Z", "zenith", "azimuth", "rangemeter", "Intensity", "return_number")
    ordered = returns.repartitionByRange("scan_id", "line").sortWithinPartitions("scan_id", "line", "pulse", "return_number")
    ordered.select("scan_id", line.alias("value")).write.mode("overwrite").partitionBy("scan_id").option("lineSep", "\r\n").text(path)


def write_matrix(spark: SparkSession, matrix: tuple[tuple[float, ...], ...], path: str) -> None:
    """A small matrix as lines of numbers."""
    lines = [(k, " ".join(repr(float(v)) for v in row)) for k, row in enumerate(matrix)]
    spark.createDataFrame(lines, "k int, value string").coalesce(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)


def write_positions(positions: DataFrame, path: str) -> None:
    """Scanner positions X, Y as one comma-separated file; they are a handful."""
    positions.select("X", "Y").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """(kind, split, place, path) as one document {kind: {split: [paths in order]}}, JSON and so YAML too."""
    lists = manifest.groupBy("kind", "split").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("paths"))
    kinds = lists.groupBy("kind").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("split", "paths")))).alias("splits"))
    by_kind = lambda a, b: F.when(a["kind"] < b["kind"], -1).otherwise(1)  # noqa: E731 - maps have no order of their own
    whole = kinds.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "splits")), by_kind)).alias("m"))
    whole.select(F.to_json("m").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_report(stats: DataFrame, path: str, names: DataFrame | None = None) -> None:
    """Roughness by label as text, in centimetres."""
    df = stats if names is None else stats.join(names, "class_id", "left")
    name = F.coalesce(F.col("name"), F.concat(F.lit("Label "), F.col("class_id"))) if names is not None else F.concat(F.lit("Label "), F.col("class_id"))
    line = F.format_string("%s: median %.2f cm, IQR %.2f cm, p95 %.2f cm (%d points, %d without value)", name, F.col("median") * 100, F.col("iqr") * 100, F.col("p95") * 100, F.col("valid"), F.col("nan_count"))
    df.select(line.alias("value")).write.mode("overwrite").text(path)
