"""Deterministic samples: every draw is a hash of the row's key and a seed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanforge.operators.quantile import with_quantiles
from scanforge.tables import join_groups, numbered_within, written

#: Samples of more rows are cut at a draw found by counting; smaller ones are a top-n, in order of draw.
FEW = 5000
#: Rows of a group that share the cut's digits and are ranked by one window, at most.
RANKED = 1_000_000


def draw(seed: int, *keys: str) -> Column:
    """A 32-digit hexadecimal draw that any engine with md5 can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def first_drawn(df: DataFrame, by: list[str], keys: list[str], wanted: Callable[[Column], Column], seed: int = 42) -> DataFrame:
    """``df`` with ``_first``: whether a row is among the first of its group by draw and keys; ``wanted`` gives their number from the group's rows.

    One count by the draw's first four digits (65 536 rows a group at most) tells at which digits a group is cut; only rows with those digits are ranked.
    """
    drawn = df.withColumns({"_u": draw(seed, *keys), "_digits": F.substr(draw(seed, *keys), F.lit(1), F.lit(4))})
    counts = written(drawn.groupBy(*by, F.col("_digits").alias("_cut")).agg(F.count("*").alias("_n")), "draw-counts")
    group = Window.partitionBy(*by)
    upto = group.orderBy("_cut").rowsBetween(Window.unboundedPreceding, 0)
    cuts = counts.withColumn("_left", wanted(F.sum("_n").over(group)).cast("long") - F.sum("_n").over(upto) + F.col("_n"))
    # a group of which all or none is wanted is cut after its last digits or before its first
    cuts = written(cuts.withColumn("_last", F.max("_cut").over(group)).where("_left > 0 AND (_left <= _n OR _cut = _last)").select(*by, "_cut", "_left", "_n"), "draw-cuts")
    placed = join_groups(drawn, cuts, by, "left")
    sure = placed.where("_cut IS NULL OR _digits <> _cut").withColumn("_first", F.coalesce(F.col("_digits") < F.col("_cut"), F.lit(False)))
    open_ = placed.where("_digits = _cut")
    if (cuts.agg(F.max("_n")).first()[0] or 0) <= RANKED:
        ranked = open_.withColumn("_first", F.row_number().over(group.orderBy("_u", *keys)) <= F.col("_left"))
    else:  # many rows of equal keys
        ranked = numbered_within(open_, by, ["_u", *keys], row="_place").withColumn("_first", F.col("_place") < F.col("_left"))
    return sure.select(*df.columns, "_first").unionByName(ranked.select(*df.columns, "_first"))


def exact_sample(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """n rows without replacement, the first by draw; no global sort."""
    if n <= FEW:
        return df.withColumn("_u", draw(seed, *keys)).orderBy("_u", *keys).limit(n).drop("_u")
    return first_drawn(df, [], keys, lambda rows: F.least(rows, F.lit(n)), seed).where("_first").drop("_first")


def fraction_sample(df: DataFrame, fraction: float, keys: list[str], seed: int = 42) -> DataFrame:
    return first_drawn(df, [], keys, lambda rows: F.bround(rows * F.lit(fraction)), seed).where("_first").drop("_first")


def stratified_sample(df: DataFrame, label: str, keep: int, keys: list[str], rare_below: float = 0.05, boost: float = 0.5, seed: int = 42) -> DataFrame:
    """keep rows: of each rare class up to an equal quota of ``boost`` of them, the rest from all major classes."""
    shares = df.groupBy(label).agg(F.count("*").alias("_n"))
    shares = written(shares.withColumn("_rare", F.col("_n") / F.sum("_n").over(Window.partitionBy()) < rare_below), "class-shares")  # one row a class
    n_rare = shares.where("_rare").count()
    quota = int(keep * boost) // n_rare if n_rare else 0
    marked = join_groups(df, shares, [label], nulls=False).withColumn("_u", draw(seed, *keys))
    # a fixed limit, so that each task keeps no more than the quota of a class before rows meet
    ranked = marked.where("_rare").withColumn("_k", F.row_number().over(Window.partitionBy(label).orderBy("_u", *keys)))
    rare = written(ranked.where(F.col("_k") <= quota).select(df.columns), "rare-sample")
    left = max(0, keep - rare.count())
    return rare.unionByName(exact_sample(marked.where("not _rare").select(df.columns), left, keys, seed))


def stride_sample(df: DataFrame, stride: int, order: list[str], by: list[str]) -> DataFrame:
    """Every n-th row of each group; groups are numbered by range and prefix sums."""
    return numbered_within(df, by, order, row="_i").where(F.col("_i") % stride == 0).select(*df.columns)


def uniform(seed: int, index: Column) -> Column:
    """A number in [0, 1) from the first 8 hexadecimal digits of an md5."""
    return F.conv(F.substr(F.md5(F.concat_ws("|", F.lit(str(seed)), index.cast("string"))), F.lit(1), F.lit(8)), 16, 10).cast("double") / 4294967296.0


def weighted_resample(df: DataFrame, weight: str, value: str, n: int, key: str, transform: str = "none", quantile: float = 0.99, seed: int = 0, by: str | None = None) -> DataFrame:
    """n draws with replacement, probabilities by the weight cut at its quantile and transformed (none, log1p, sqrt).

    Draws are bucketed like the cumulative weights, so the range join is an equi-join on 1024 buckets.
    """
    change = {"none": lambda c: c, "log1p": F.log1p, "sqrt": F.sqrt}[transform]
    keys = [by] if by else []
    cut = with_quantiles(df, {"_q": (F.col(weight), quantile)}, tuple(keys))
    cut = cut.withColumn("_w", change(F.least(F.col(weight), F.col("_q")))).select(*dict.fromkeys([*keys, key, value]), "_w")
    cut = written(cut, "weights")
    placed = numbered_within(cut, keys, [key], {"_before": "_w"}, row="_i")
    totals = cut.groupBy(*keys).agg(F.sum("_w").alias("_all")) if by else cut.agg(F.sum("_w").alias("_all"))
    placed = join_groups(placed, totals, keys, nulls=False) if by else placed.crossJoin(F.broadcast(totals))  # one row
    last = F.col("_i") == F.col("_i_count") - 1
    placed = placed.withColumns({"_from": F.col("_before") / F.col("_all"), "_to": F.when(last, 1.0).otherwise((F.col("_before") + F.col("_w")) / F.col("_all"))})
    buckets = 1024
    spread = placed.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_from") * buckets), F.least(F.floor(F.col("_to") * buckets), F.lit(buckets).cast("long")))))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), uniform(seed, F.col("id")).alias("_u")).withColumn("_b", F.floor(F.col("_u") * buckets))
    return spread.join(draws, "_b").where("_u >= _from and _u < _to").select(*keys, "draw", *dict.fromkeys([key, value]))


def train_split(df: DataFrame, label: str, keys: list[str], share: float = 0.8, seed: int = 42) -> DataFrame:
    """is_train: the first ``share`` of each class by draw."""
    return first_drawn(df, [label], keys, lambda rows: F.round(rows * F.lit(share)), seed).withColumnRenamed("_first", "is_train")


def head(df: DataFrame, n: int = 5) -> DataFrame:
    """The first rows, to look at."""
    return df.limit(n)
