"""Sets of ids, labels and values: one distinct aggregate each, whatever the number of frames or columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanforge.tables import join_on


def distinct_ids(name: str, *ids: DataFrame) -> DataFrame:
    """The distinct values (column ``name``, NULL left out) of frames of one column each; each frame is reduced before they meet."""
    each = [df.toDF(name).where(F.col(name).isNotNull()).distinct() for df in ids]
    return each[0] if len(each) == 1 else reduce(DataFrame.unionByName, each).distinct()


def label_domain(df: DataFrame, columns: list[str], name: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., name): the labels that occur in any of the columns, from one pass over the frame."""
    return df.select(*by, F.explode(F.array_distinct(F.array(*columns))).alias(name)).where(F.col(name).isNotNull()).distinct()


def common_values(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct values of ``a`` (all its columns, NULL equals NULL) that ``b`` has, too; ``b`` may name them otherwise."""
    other = b.toDF(*a.columns).distinct()
    return join_on(a.distinct(), other, a.columns, "left_semi")
