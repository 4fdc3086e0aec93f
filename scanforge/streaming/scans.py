"""Incremental statistics over arriving scans and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scanforge.operators.profile import value_by_label
from scanforge.tables import new_path


def scan_stream(spark: SparkSession, path: str, schema: str, header: bool = True, files_per_batch: int = 1) -> DataFrame:
    """Comma-separated scans as they arrive, a few files a micro-batch."""
    return spark.readStream.schema(schema).option("header", header).option("maxFilesPerTrigger", files_per_batch).csv(path)


def running_stats(stream: DataFrame, value: str, label: str) -> DataFrame:
    """Counts, NaN counts, mean, extremes and approximate quartiles by label over all scans so far."""
    known = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    q = F.percentile_approx(known, F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.95))), F.lit(10_000))
    return stream.groupBy(label).agg(F.count(known).alias("valid"), F.count_if(F.isnan(F.col(value).cast("double"))).alias("nan_count"), F.avg(known).alias("mean"), F.min(known).alias("lowest"), F.max(known).alias("highest"), q.alias("quartiles"))


class LabelStatistics:
    """``profile.value_by_label`` over all scans that have arrived, exact after any order of files and after a restart.

    Each micro-batch adds its narrow rows (scan, label, value) to the state's folder, under its own number: a batch that runs
    again replaces its rows, and the stream's checkpoint beside them tells a new start which files are in.
    """

    def __init__(self, stream: DataFrame, value: str, label: str, path: str, scan: str = "scan_id") -> None:
        self.spark, self.path, self.names = stream.sparkSession, path.rstrip("/"), (value, label, scan)
        self.rows = stream.select(scan, label, F.col(value).cast("double").alias(value))

    def advance(self) -> None:
        """Takes in what has arrived since."""
        keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{self.path}/rows/batch={number}")
        self.rows.writeStream.foreachBatch(keep).option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start().awaitTermination()

    def result(self) -> DataFrame:
        value, label, scan = self.names
        return value_by_label(self.spark.read.schema(self.rows.schema).parquet(f"{self.path}/rows/batch=*"), value, label, scan)


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes", by: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums in tumbling windows; events later than the watermark are left out."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    return stamped.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def drain(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what there is now, to its end, and returns its result as a table in the shared folder.

    Every batch writes a folder of its own: in complete mode the last one is the result, else all of them; a batch that is run again
    replaces its folder.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    batches: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        batches.append(number)

    query: StreamingQuery = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not batches:
        return spark.createDataFrame([], df.schema)
    wanted = batches[-1:] if mode == "complete" else sorted(set(batches))
    return spark.read.schema(df.schema).parquet(*[f"{path}/batch={k}" for k in wanted])
