"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []
_paths: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder, else a new local one if the session itself is local."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="scanforge-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when the process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/scanforge/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_all)
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file system layer."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_all() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session may have ended first
            return


#: The shuffle files of a write go with its end; what is read later is the table.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """``df`` as a table written once to the shared folder: its lineage is cut and lost executors cost nothing.

    ``batch``: the most rows of an Arrow batch while it is computed, for wide rows.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    settings = {_CLEAN: "true"} | ({_BATCH: str(batch)} if batch else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[id(table)] = path
    weakref.finalize(table, _paths.pop, id(table), None)
    return table


def drop(*tables: DataFrame) -> None:
    """Removes tables that ``written`` returned and nothing will read again."""
    for table in tables:
        if path := _paths.pop(id(table), None):
            remove(table.sparkSession, path)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on equal keys, where NULL equals NULL; the keys are ``left``'s."""
    named = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`__r_{k}`")) for k in keys], F.lit(True))
    return left.join(named, same, how).drop(*[f"__r_{k}" for k in keys])


#: Rows and bytes (as stored) of a table that is sent to all tasks, at most.
SENT_ROWS, SENT_BYTES = 200_000, 8 << 20


def join_groups(left: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner", nulls: bool = True) -> DataFrame:
    """``left`` joined with one row a group, which is written once; NULL is a group unless ``nulls`` is false.

    While the groups are few they are sent to all tasks, so no group of ``left`` becomes one task's; beyond that both
    sides are dealt by key, and adaptive execution divides a large group.
    """
    held = groups if id(groups) in _paths else written(groups, "groups")
    if held.count() <= SENT_ROWS and _stored_bytes(held) <= SENT_BYTES:
        held = F.broadcast(held)
    return join_on(left, held, keys, how) if nulls else left.join(held, keys, how)


#: Rows and bytes (as stored) of one range where rows are numbered, at most; fewer where there are workers to spare, but no fewer than ``LEAST_ROWS``.
RANGE_ROWS, RANGE_BYTES, LEAST_ROWS = 2_000_000, 32 << 20, 50_000


def _stored_bytes(table: DataFrame) -> int:
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_paths[id(table)])
    return path.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def _offsets(totals: DataFrame, names: list[str]) -> DataFrame:
    """One row for each ``__range``: sums over the ranges before it, first within blocks of a thousand ranges and then over the blocks."""
    sums = lambda w: [F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in names]
    blocked = totals.withColumn("__block", F.floor(F.col("__range") / 1000))
    earlier = blocked.groupBy("__block").agg(*[F.sum(c).alias(c) for c in names])
    earlier = earlier.select("__block", *sums(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each thousand ranges
    inside = blocked.select("__block", "__range", *sums(Window.partitionBy("__block").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)))
    both = inside.join(earlier.withColumnsRenamed({c: f"{c}_" for c in names}), "__block")
    return both.select("__range", *[(F.col(c) + F.col(f"{c}_")).alias(c) for c in names])


def in_ranges(rows: DataFrame, order: list[str | Column]) -> DataFrame:
    """``rows`` written in ranges of ``order``, with ``__range`` and ``__tie``, a number that tells equal rows apart; a range is bounded in rows and bytes."""
    held = rows if id(rows) in _paths else written(rows, "to-number")
    n = held.count()
    wanted = max(-(-n // RANGE_ROWS), -(-_stored_bytes(held) // RANGE_BYTES))
    n_parts = max(1, wanted, min(-(-n // LEAST_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    tied = held.withColumn("__tie", F.monotonically_increasing_id())
    ranged = written(tied.repartitionByRange(n_parts, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    if held is not rows:
        drop(held)
    return ranged


def numbered(rows: DataFrame, order: list[str | Column], sums: dict[str, str] | None = None, row: str = "row", deal: list[str | Column] | None = None) -> DataFrame:
    """``rows`` with ``row`` (place in ``order``, from 0) and, for each of ``sums`` (name: column), the column's sum before the row.

    The rows are written (if they aren't a written table), dealt by range and written again; one total for each range becomes the
    range's offset, so no window holds more than a range.  Equal rows are told apart by their position; names with a leading ``__`` are the function's own.
    ``deal``: what the ranges are cut by, if that is less than the whole order (long texts would go to the driver as bounds);
    it must never decrease along the order.
    """
    sums = sums or {}
    keys = [*order, F.col("__tie")]
    ranged = in_ranges(rows, deal or keys)
    totals = ranged.groupBy("__range").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__of_{k}") for k, c in sums.items()])
    offsets = written(_offsets(totals, ["__n", *[f"__of_{k}" for k in sums]]), "range-offsets")
    within = Window.partitionBy("__range").orderBy(*keys)
    return ranged.join(offsets, "__range").select(
        *[f"`{c}`" for c in rows.columns],
        (F.col("__n") + F.row_number().over(within) - 1).cast("long").alias(row),
        *[(F.col(f"__of_{k}") + F.sum(c).over(within) - F.col(c)).alias(k) for k, c in sums.items()],
    )


def numbered_within(rows: DataFrame, by: list[str], order: list[str | Column], sums: dict[str, str] | None = None, row: str = "row") -> DataFrame:
    """Like ``numbered``, but places and sums begin anew in each group; a group may span many ranges.

    Also adds ``<row>_count``, the group's rows.
    """
    sums = sums or {}
    placed = written(numbered(rows, [*by, *order], sums, "__place"), "placed")
    totals = placed.groupBy(*by).agg(F.min("__place").alias("__first"), F.count("*").alias(f"{row}_count"), *[F.min_by(k, "__place").alias(f"__from_{k}") for k in sums])
    joined = join_groups(placed, totals, by) if by else placed.crossJoin(F.broadcast(totals))  # one row
    names = [F.col(f"`{c}`") for c in rows.columns]
    return joined.select(*names, (F.col("__place") - F.col("__first")).alias(row), f"{row}_count", *[(F.col(k) - F.col(f"__from_{k}")).alias(k) for k in sums])
