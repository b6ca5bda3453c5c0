"""Comment triage as a stateless stream: the batch code over ``readStream``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.functions import text as tx
from parley.operators.modeling import Scorer
from parley.plans.review import triage_comments
from parley.settings import CUE_TERMS, CueTerm

REJECTED = "rejected_blank"


def comment_stream(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet",
                   files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(fmt).load(folder)


def analyze_stream(
    comments: DataFrame,
    scorer: Scorer,
    threshold: float = 0.5,
    terms: Iterable[CueTerm] = CUE_TERMS,
) -> DataFrame:
    """Review items of all non-blank comments of a ``(row_id, text)`` stream.

    Blank comments are counted as the observed metric ``rejected_blank`` of each batch.
    """
    blank = tx.is_blank(F.col("text"))
    watched = comments.observe(
        "comments", F.count_if(blank).alias(REJECTED), F.count(F.lit(1)).alias("received")
    )
    return triage_comments(watched.filter(~blank), scorer, threshold, terms)


def start(items: DataFrame, output: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append items to a Parquet folder, exactly once across restarts."""
    writer = items.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.outputMode("append").start(output)
