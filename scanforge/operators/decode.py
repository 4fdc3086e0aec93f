"""Decoding of raw scanner text, from scan lines to returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanforge.tables import in_ranges, join_groups, join_on, numbered_within, written

#: Fixed values of the format.
RECORD_END = "\x03"
BLOCKS = r"DIST1|RSSI1|DIST2|RSSI2"
ENCODER_TOP = 0x3FFF
ENCODER_TOKEN, ERROR_TOKENS = 19, (5, 6)
FIRST_VALUE_TOKEN = 5
COUNTS_PER_DEGREE = 250
TAIL_ROWS = 5


def scan_lines(files: DataFrame) -> DataFrame:
    """(scan_id, line, header, b1 .. b4) of the complete lines of files (scan_id, value), or of pieces of them that bring the number of their ``first_line``.

    The blocks stand in the order ranges 1, ranges 2, intensities 1, intensities 2; a line without all four is left out.
    """
    pieces = ["first_line"] if "first_line" in files.columns else []
    lines = files.select("scan_id", *pieces, F.posexplode(F.split("value", RECORD_END)).alias("line", "text"))
    if pieces:
        lines = lines.withColumn("line", F.col("first_line") + F.col("line"))
    parts = lines.withColumn("p", F.split("text", BLOCKS)).where(F.size("p") == 5)
    return parts.select("scan_id", "line", *[F.get("p", i).alias(n) for i, n in enumerate(("header", "b1", "b2", "b3", "b4"))])


def _hex(token):
    return F.conv(token, 16, 10).cast("long")


def _values(block: str):
    tokens = F.split(F.trim(block), r"\s+")
    return F.transform(F.slice(tokens, FIRST_VALUE_TOKEN + 1, F.greatest(F.size(tokens) - FIRST_VALUE_TOKEN, F.lit(0))), _hex)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Encoder, errors, angular step and the four value arrays (mm and counts), blocks in the order of the file."""
    head = F.split(F.trim("header"), r"\s+")
    return lines.select(
        "scan_id", "line", _hex(F.get(head, ENCODER_TOKEN)).alias("encoder"), *[_hex(F.get(head, t)).alias(f"error{t}") for t in ERROR_TOKENS],
        (_hex(F.get(F.split(F.trim("b1"), r"\s+"), 3)) / 1e4).alias("step"),
        _values("b1").alias("r1"), _values("b2").alias("r2"), _values("b3").alias("i1"), _values("b4").alias("i2"),
    )


def encoder_steps(df: DataFrame, order: str = "line", by: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """``increment``: encoder counts since the line before, over the wrap at its top; 0 on the first line.

    In the last five lines a decrease isn't a wrap: the increment before it is repeated.  ``order`` tells a scan's lines apart.

    The lines' keys and encoders go to ranges; windows run within a range, and one border row of each range carries the last
    encoder, and then the last increment, on to the next.
    """
    lines = in_ranges(df.select(*by, order, "encoder"), [*by, order])
    spot = ["__range", *by]
    here = Window.partitionBy(*spot).orderBy(order)
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ends = lines.groupBy(*spot).agg(F.max_by("encoder", order).alias("_end"))
    carried = ends.select(*spot, F.last("_end").over(earlier).alias("_carried"))
    backwards = Window.partitionBy(*spot).orderBy(F.desc(order))
    late = lines.withColumn("_r", F.row_number().over(backwards)).where(F.col("_r") <= TAIL_ROWS)  # five rows a range
    late = late.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("_r") <= TAIL_ROWS)
    tail = late.groupBy(*by).agg(F.min(order).alias("_tail"))
    rows = join_groups(join_on(lines, carried, spot), tail, list(by))
    before = F.coalesce(F.lag("encoder").over(here), "_carried")
    rows = rows.withColumn("_before", before)
    fell = F.col("encoder") < F.col("_before")
    step = F.when(F.col("_before").isNull(), 0).when(fell & (F.col(order) >= F.col("_tail")), None).when(fell, ENCODER_TOP - F.col("_before") + F.col("encoder")).otherwise(F.col("encoder") - F.col("_before"))
    steps = written(rows.select(*spot, order, step.cast("long").alias("_step")), "encoder-steps")
    ends = steps.groupBy(*spot).agg(F.max_by("_step", F.when(F.col("_step").isNotNull(), F.col(order))).alias("_end"))
    carried = ends.select(*spot, F.last("_end", True).over(earlier).alias("_carried"))
    own = F.last("_step", True).over(here.rowsBetween(Window.unboundedPreceding, 0))
    made = join_on(steps.withColumn("_own", own), carried, spot).select(*by, order, F.coalesce("_own", "_carried").alias("increment"))
    return join_on(df, made, [*by, order])


def running_azimuth(df: DataFrame, order: str = "line", by: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """Degrees turned so far: prefix sums over ranges of lines."""
    placed = numbered_within(df.select(*by, order, "increment"), list(by), [order], {"_before": "increment"}, "_place")
    turned = placed.select(*by, order, ((F.col("_before") + F.col("increment")) / COUNTS_PER_DEGREE).alias("turned"))
    return join_on(df, turned, [*by, order])


def pulses(lines: DataFrame) -> DataFrame:
    """One row for each pulse, with ranges in metres; short arrays end a line's pulses, not the job."""
    p = lines.select("scan_id", "line", "turned", "increment", "step", F.size("r1").alias("n_pulses"), F.posexplode(F.arrays_zip("r1", "i1", "r2", "i2")).alias("pulse", "v"))
    return p.select("scan_id", "line", "turned", "increment", "step", "n_pulses", "pulse", *[(F.coalesce(F.col(f"v.r{k}"), F.lit(0)) / 1000.0).alias(f"r{k}") for k in (1, 2)], *[F.coalesce(F.col(f"v.i{k}"), F.lit(0)).alias(f"i{k}") for k in (1, 2)])


#: Middle pulse and degrees between pulses, by version of the scanner.
VERSIONS = {1: (270, 0.5), 2: (540, 0.25)}


def pulse_angles(df: DataFrame, version: int = 2) -> DataFrame:
    """Azimuth in [0, 360) and zenith; the scanner turns on while its mirror sweeps, pulses before the middle look backwards."""
    middle, spacing = VERSIONS[version]
    turned = F.col("turned") + F.col("increment") / COUNTS_PER_DEGREE / F.nullif(F.col("n_pulses"), F.lit(0)) * F.col("pulse")
    back = F.when(F.col("pulse") < middle, 360).otherwise(180)
    return df.withColumns({"zenith": F.abs(F.col("pulse") - middle) * F.lit(spacing), "azimuth": F.pmod(back - turned, F.lit(360.0))})


def to_cartesian(df: DataFrame, rng: str) -> DataFrame:
    z, a, r = F.radians("zenith"), F.radians("azimuth"), F.col(rng)
    return df.withColumns({"X": -r * F.sin(z) * F.cos(a), "Y": r * F.sin(z) * F.sin(a), "Z": r * F.cos(z)})


def returns(df: DataFrame) -> DataFrame:
    """A row for each return: the first always, the second where it has a range."""
    n = F.when(F.col("r2") > 0, 2).when(F.col("r1") > 0, 1).otherwise(0)
    both = F.array(F.struct(F.lit(1).alias("return_number"), F.col("r1").alias("rangemeter"), F.col("i1").alias("Intensity")), F.struct(F.lit(2).alias("return_number"), F.col("r2").alias("rangemeter"), F.col("i2").alias("Intensity")))
    kept = F.filter(both, lambda x: (x["return_number"] == 1) | (x["rangemeter"] > 0))
    flat = df.withColumn("n_returns", n).withColumn("_r", F.explode(kept)).select("*", "_r.*").drop("_r", "r1", "r2", "i1", "i2")
    return to_cartesian(flat, "rangemeter")


def decode(files: DataFrame) -> DataFrame:
    """Returns of raw scanner files (scan_id, value)."""
    return files.transform(scan_lines).transform(parse_lines).transform(encoder_steps).transform(running_azimuth).transform(pulses).transform(pulse_angles).transform(returns)


def scan_info(lines: DataFrame) -> DataFrame:
    """scan_id, scan lines, most pulses in a line, pulses, and pulses with a first return."""
    valid = F.size(F.filter("r1", lambda x: x > 0))
    return lines.groupBy("scan_id").agg(F.count("*").alias("n_lines"), F.max(F.size("r1")).alias("most_pulses"), F.sum(F.size("r1")).alias("n_pulses"), F.sum(valid).alias("n_valid"))
