"""From an uploaded comment file to a review queue and its summary."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from parley.operators import triage
from parley.operators.modeling import Scorer, score_comments
from parley.session import staged
from parley.settings import CUE_TERMS, CueTerm
from parley.sources.uploads import parse_upload


@dataclass
class Review:
    """Scored items, stored once, with the views over them."""

    items: DataFrame

    @property
    def queue(self) -> DataFrame:
        return triage.review_queue(self.items)

    @property
    def summary(self) -> DataFrame:
        return triage.queue_summary(self.items)


def triage_comments(
    comments: DataFrame,
    scorer: Scorer,
    threshold: float = 0.5,
    terms: Iterable[CueTerm] = CUE_TERMS,
) -> DataFrame:
    """``(row_id, text)`` comments as review items, in batch or streaming."""
    scored = score_comments(comments, "text", scorer, threshold)
    return triage.build_review_items(scored, terms)


def analyze_file(
    spark: SparkSession,
    path: str,
    scorer: Scorer,
    text_column: str | None = None,
    threshold: float = 0.5,
) -> Review:
    """Parse, score and rank an upload."""
    comments = parse_upload(spark, path, text_column)
    return Review(staged(triage_comments(comments, scorer, threshold), "items"))
