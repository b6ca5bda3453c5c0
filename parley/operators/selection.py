"""The most frequent keys of a large count table, without a task that gathers them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.rowindex import index_by_order


def most_frequent(counts: DataFrame, n: int, count: str, key: str) -> DataFrame:
    """The ``n`` rows of the largest counts; equal counts go by key.

    A histogram of the counts tells the count at the cut. What lies above it is a filter, and
    only the rows at the cut are put in order, by a distributed sort. ``counts`` should be a
    stored table.
    """
    # One row per distinct count: few, as there are at most sqrt(2 * total) of them.
    cells = counts.groupBy(count).agg(F.count(F.lit(1)).alias("__rows"))
    upto = F.sum("__rows").over(Window.orderBy(F.desc(count)))
    cut = (
        cells.withColumn("__upto", upto).filter(F.col("__upto") >= n)
        .agg(F.max_by(F.struct(count, "__rows", "__upto"), count).alias("c")).first()["c"]
    )
    if cut is None:
        return counts
    wanted = n - (cut["__upto"] - cut["__rows"])
    above, ties = counts.filter(F.col(count) > cut[count]), counts.filter(F.col(count) == cut[count])
    if wanted < cut["__rows"]:
        ties = index_by_order(ties, [F.col(key)], "__n").filter(F.col("__n") < wanted).drop("__n")
    return above.unionByName(ties)
