"""The review queue as CSV text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.numbers import plain_number
from parley.operators.triage import EXPORT_COLUMNS, export_rows, review_queue

HEADER = ",".join(EXPORT_COLUMNS)


def review_queue_lines(items: DataFrame) -> DataFrame:
    """Queue rows as CSV lines: every field quoted, quotes doubled, null empty."""
    flat = export_rows(items)
    kinds = dict(flat.dtypes)

    def quoted(name: str):
        value = F.col(name)
        value = plain_number(value) if kinds[name] == "double" else value.cast("string")
        doubled = F.replace(F.coalesce(value, F.lit("")), F.lit('"'), F.lit('""'))
        return F.concat(F.lit('"'), doubled, F.lit('"'))

    return flat.select("row_id", "risk_score", F.concat_ws(",", *map(quoted, EXPORT_COLUMNS)).alias("line"))


def write_review_queue(items: DataFrame, path: str) -> None:
    """All items in queue order below one bare header line.

    The part files are consecutive ranges of the sorted queue: joined in name order they are
    the whole CSV. The header rides on the first row.
    """
    ordered = review_queue(review_queue_lines(items)).withColumn(
        "__at", F.monotonically_increasing_id()
    )
    first = F.concat(F.lit(HEADER + "\n"), F.col("line"))
    lines = ordered.select(F.when(F.col("__at") == 0, first).otherwise(F.col("line")).alias("value"))
    if items.isEmpty():
        lines = items.sparkSession.createDataFrame([(HEADER,)], "value string")
    lines.write.mode("overwrite").text(path)
