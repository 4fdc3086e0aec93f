"""Label refinement: neighbour votes, a random forest on reliable points, and their merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanforge.operators import trees as trees_of
from scanforge.operators.sample import train_split
from scanforge.operators.spatial import knn_among
from scanforge.tables import written


def vote(points: DataFrame, k: int = 50, threshold: float = 0.8, cell: float = 0.1, label: str = "class_id", by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., point_id, label, vote): the dominant class among the k nearest, where the own one has too little support.

    Dominant: the most frequent class but 0, the least on a tie.  A point of class 0 takes it if
    there is one; another point takes it if its own share is below the threshold.
    """
    near = knn_among(points, k, cell, by)
    own = points.select(*by, "point_id", F.col(label).alias("label"))
    nbr = points.select(*by, F.col("point_id").alias("nbr_id"), F.col(label).alias("nbr_label"))
    labelled = near.join(nbr, [*by, "nbr_id"]).join(own, [*by, "point_id"])
    counts = labelled.groupBy(*by, "point_id", "label", "nbr_label").agg(F.count("*").alias("n"))
    best = F.max_by(F.when(F.col("nbr_label") != 0, F.col("nbr_label")), F.when(F.col("nbr_label") != 0, F.struct("n", -F.col("nbr_label"))))
    sums = counts.groupBy(*by, "point_id", "label").agg(best.alias("dominant"), F.sum("n").alias("all"), F.sum(F.when(F.col("nbr_label") == F.col("label"), F.col("n")).otherwise(0)).alias("own"))
    unsure = (F.col("label") == 0) | (F.col("own") / F.col("all") < threshold)
    return sums.select(*by, "point_id", "label", F.when(unsure & F.col("dominant").isNotNull(), F.col("dominant")).otherwise(F.col("label")).alias("vote"))


def forest(voted: DataFrame, features: list[str], trees: int = 200, seed: int = 42, depth: int = 30, bins: int = 128) -> tuple[DataFrame, float]:
    """``voted`` with rf_label and rf_confidence, and the accuracy on held-out reliable points.

    Reliable points keep their label under the vote and aren't of class 0; classes are weighted
    equally; a fifth of each class is held out.  Trees grow until leaves are pure, up to ``depth`` levels, and split at ``bins``
    quantiles of a feature.
    """
    rows = written(voted.withColumn("_row", F.monotonically_increasing_id()), "forest-voted")
    reliable = F.coalesce(F.expr("label <> 0 and label = vote"), F.lit(False))
    classes = rows.where(reliable).groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()
    if not classes:
        raise ValueError("a forest needs reliable points: none has a class but 0 that its vote confirms")
    labels, weights = [r.label for r in classes], [sum(r.n for r in classes) / (len(classes) * r.n) for r in classes]
    split = train_split(rows.where(reliable), "label", ["point_id"], seed=seed)
    split = written(split.unionByName(rows.where(~reliable).withColumn("is_train", F.lit(None).cast("boolean"))), "forest-split")
    named = F.array(*[F.lit(v) for v in labels])
    learnt = F.when(F.col("is_train"), F.array_position(named, F.col("label")) - 1).otherwise(-1)
    best = trees_of.votes(split, features, learnt, F.col("point_id"), weights, trees, seed, depth, bins)
    best = best.select("_row", F.get(named, F.col("best")).cast("int").alias("rf_label"), F.col("share").alias("rf_confidence"))
    out = written(split.join(best, "_row"), "forest-scored")
    held = out.where("not is_train").agg(F.avg((F.col("rf_label") == F.col("label")).cast("double"))).first()[0]
    return out.select(*[f"`{c}`" for c in voted.columns], "rf_label", "rf_confidence"), held


def merge(scored: DataFrame, confidence: float = 0.85) -> DataFrame:
    """label_refined: the forest's class for class 0 and where it is sure and differs, else the vote."""
    sure = (F.col("rf_confidence") > confidence) & (F.col("label") != F.col("rf_label"))
    return scored.withColumn("label_refined", F.when((F.col("label") == 0) | sure, F.col("rf_label")).otherwise(F.col("vote")))


def refine(points: DataFrame, features: list[str], k: int = 50, threshold: float = 0.8, confidence: float = 0.85, cell: float = 0.1, label: str = "class_id", trees: int = 200) -> DataFrame:
    voted = vote(points, k, threshold, cell, label)
    joined = written(points.select("point_id", *features).join(voted, "point_id"), "voted")  # counted, split, fitted and scored
    return merge(forest(joined, features, trees)[0], confidence)
