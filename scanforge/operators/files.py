"""File listings as tables: which files belong together, and which split they are in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kind of file: (name's ending, folder it lies in, mark that follows its id in the name).
MANIFEST_KINDS = {"img": (".npy", "img", "image"), "img_metadata": (".yaml", "img", "image"), "mask": ("_mask.png", "img", "mask"), "pcd": ("_color.csv", "pcd", "color")}


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path) of all files below a folder that hold anything; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


def split_manifest(files: DataFrame, ids: DataFrame, kinds: dict[str, tuple[str, str, str]] = MANIFEST_KINDS, id_length: int = 5) -> DataFrame:
    """(kind, split, place, id, path): the file of each id of (split, place, id) and kind, where there is one.

    A file's id is the last ``id_length`` characters before its kind's mark.  An id in several splits is in the first by
    name order of train, val, test; of several files of one id and kind the last by path counts.
    """
    name, parent = file_name(F.col("path")), parent_name(F.col("path"))
    found = F.array(*[
        F.when(name.endswith(ending) & (parent == folder), F.struct(F.lit(kind).alias("kind"), F.right(F.split_part(name, F.lit(mark), F.lit(1)), F.lit(id_length)).alias("id"))) for kind, (ending, folder, mark) in kinds.items()
    ])
    keyed = files.select("path", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("x.*", "path")
    last = keyed.groupBy("kind", "id").agg(F.max("path").alias("path"))
    rank = F.array_position(F.array(*map(F.lit, ("train", "val", "test"))), F.col("split"))
    once = ids.groupBy("id").agg(F.min_by(F.struct("split", "place"), F.struct(rank, "place")).alias("s")).select("id", "s.split", "s.place")
    return once.join(last, "id").select("kind", "split", "place", "id", "path")


#: How a label file's path follows from its scan's: replacements in the folder and in the stem, and the ending.
PAIRING = (("/pcd/", "/label/"), ("_color", "_refined"), ".label")


def pair_files(points: DataFrame, labels: DataFrame, folders: tuple[str, str] = PAIRING[0], stems: tuple[str, str] = PAIRING[1], ending: str = PAIRING[2]) -> DataFrame:
    """(path, label_path) of the files of ``points`` whose label file, by its rewritten path, is among ``labels``."""
    path = F.col("path")
    folder = F.replace(F.regexp_replace(path, r"[^/]*$", ""), F.lit(folders[0]), F.lit(folders[1]))
    stem = F.replace(F.regexp_replace(file_name(path), r"\.[^.]*$", ""), F.lit(stems[0]), F.lit(stems[1]))
    rewritten = points.select("path", F.concat(folder, stem, F.lit(ending)).alias("label_path"))
    return rewritten.join(labels.select(F.col("path").alias("label_path")).distinct(), "label_path").select("path", "label_path")


def chosen_inputs(files: DataFrame, suffix: str = "", first: int | None = 0, last: int | None = None, numeric: bool = False) -> list[str]:
    """The inputs of a run: paths with a suffix in order of name, or of the number after the first underscore of their folder, cut as [first:last].

    They name the driver's own jobs, so they are a list; at most a folder listing of one run.
    """
    key = F.regexp_extract(parent_name(F.col("path")), r"^[^_]*_(\d+)", 1).try_cast("long") if numeric else F.col("path")
    rows = files.where(F.col("path").endswith(suffix)).orderBy(key, "path").collect()
    return [r["path"] for r in rows][first:last]
