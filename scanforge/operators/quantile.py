"""Exact quantiles without one task that holds all values.

Groups of at most ``DIRECT`` values use the built-in exact percentile.  Above that, the interval
in which each wanted place lies is narrowed: one pass counts its values in ``BINS`` equal bins, the bin
that holds the place is the next interval.  What is left, ``DIRECT`` values at most or one value
repeated, gives the value at the place itself.  Linear interpolation between neighbours, as usual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanforge.tables import join_groups, written

DIRECT = 1_000_000
BINS = 4096


def with_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]], by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with each of ``wanted`` (name: value, share) as a column: one row of quantiles for each group, joined back."""
    found = quantiles(df, wanted, by)
    return join_groups(df, found, list(by), "left") if by else df.crossJoin(F.broadcast(found))  # one row


def known(c: Column) -> Column:
    """A value as a double, NULL for NaN."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]], by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., names..): quantiles of values that are neither NULL nor NaN.  Groups and values are written once; passes read that table."""
    values = {str(c): c for c, _ in wanted.values()}  # several shares of one value are one column
    place = {v: f"_v{i}" for i, v in enumerate(values)}
    narrow = written(df.select(*by, *[known(c).alias(place[v]) for v, c in values.items()]), "quantile-values")
    return quantiles_of(narrow, {k: (F.col(place[str(c)]), p) for k, (c, p) in wanted.items()}, by)


def quantiles_of(df: DataFrame, wanted: dict[str, tuple[Column, float]], by: tuple[str, ...] = ()) -> DataFrame:
    """``quantiles`` of a written table whose values hold no NaN."""
    names = list(wanted)
    most = df.count()
    if most > DIRECT and by:
        most = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if most <= DIRECT:
        exact = [F.percentile(c, F.lit(p)).alias(k) for k, (c, p) in wanted.items()]
        return df.groupBy(*by).agg(*exact) if by else df.agg(*exact)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(p).alias("share"), c.alias("v")) for k, (c, p) in wanted.items()])).alias("x")
    rows = df.select(*by, each).select(*by, "x.*").where("v is not null")
    keys = [*by, "name"]
    targets = rows.groupBy(*keys).agg(F.first("share").alias("share"), F.count("*").alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.col("share") * (F.col("inside") - 1)
    ends = F.explode(F.array(F.struct(F.lit(0).alias("end"), F.floor(at).alias("place")), F.struct(F.lit(1).alias("end"), F.ceil(at).alias("place")))).alias("t")
    targets = written(targets.select(*keys, "lo", "hi", "inside", (at - F.floor(at)).alias("part"), ends).select(*keys, "lo", "hi", "inside", "part", "t.*"), "quantile-targets")
    while not targets.where(f"inside > {DIRECT} AND lo < hi").isEmpty():
        inside = join_groups(rows.drop("share"), targets, keys).where("v BETWEEN lo AND hi")
        bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS), F.lit(BINS - 1))).otherwise(0)
        counts = inside.groupBy(*keys, "end", "part", "place", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = Window.partitionBy(*keys, "end").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # BINS rows
        placed = counts.withColumn("upto", F.sum("n").over(upto)).where("place < upto AND place >= upto - n")
        targets = written(placed.select(*keys, "lo", "hi", F.col("n").alias("inside"), "part", "end", (F.col("place") - F.col("upto") + F.col("n")).alias("place")), "quantile-targets")
    few = join_groups(rows.drop("share"), targets, keys).where("lo < hi AND v BETWEEN lo AND hi")
    values = few.groupBy(*keys, "end", "part", "place").agg(F.sort_array(F.collect_list("v")).alias("vs"))  # DIRECT values at most
    values = values.select(*keys, "end", "part", F.get("vs", F.col("place").cast("int")).alias("v")).unionByName(targets.where("lo >= hi").select(*keys, "end", "part", F.col("lo").alias("v")))
    left, right = (F.max(F.when(F.col("end") == e, F.col("v"))) for e in (0, 1))
    ends_ = values.groupBy(*keys).agg((left + (right - left) * F.max("part")).alias("q"))
    out = ends_.groupBy(*by).agg(*[F.max(F.when(F.col("name") == k, F.col("q"))).alias(k) for k in names])
    return out if by else out.select(*names)
