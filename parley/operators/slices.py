"""Challenge slices and their summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import detectors as dt
from parley.operators.audit import histogram, weighted_percentile
from parley.settings import PrepSettings

SLICE_COLUMNS = ("has_identity_term", "has_obfuscation", "implicit_proxy", "length_bucket")


@dataclass(frozen=True)
class LengthThresholds:
    short: int
    medium: int


def length_thresholds_table(df: DataFrame, word_len: str = "word_len") -> DataFrame:
    """One row: the longest short text and the longest medium text, in words."""
    counts = histogram(df, {"words": F.col(word_len)})
    q = counts.agg(weighted_percentile([0.33, 0.66]).alias("q"))
    short = F.greatest(F.lit(1), F.ceil(F.col("q")[0])).cast("int")
    return q.select(short.alias("short_max_word_len"), F.ceil(F.col("q")[1]).alias("__m")).select(
        "short_max_word_len",
        F.greatest(F.col("short_max_word_len") + 1, F.col("__m")).cast("int").alias("medium_max_word_len"),
    )


def length_thresholds(df: DataFrame, word_len: str = "word_len") -> LengthThresholds:
    """The thresholds as driver values, to be reused for other sources."""
    row = length_thresholds_table(df, word_len).first()
    if row is None or row[0] is None or math.isnan(row[0]):
        raise ValueError("length thresholds need at least one row")
    return LengthThresholds(row["short_max_word_len"], row["medium_max_word_len"])


def length_bucket(word_len: Column, limits: LengthThresholds) -> Column:
    """Right-closed buckets."""
    return (
        F.when(word_len <= limits.short, "short")
        .when(word_len <= limits.medium, "medium")
        .otherwise("long")
    )


def add_flags(
    corpus: DataFrame, settings: PrepSettings = PrepSettings(), score_columns: Sequence[str] = ()
) -> DataFrame:
    """Identity, obfuscation and implicit-toxicity flags (0/1) on a standard corpus.

    Identity scores decide where the source has them, the lexicon elsewhere.
    """
    text = F.col("text_clean")
    present = [c for c in score_columns if c in corpus.columns]
    identity = (
        dt.any_score_at_least(present, settings.identity_threshold)
        if present
        else dt.contains_any_term(text, settings.identity_terms)
    )
    explicit = dt.contains_any_term(text, settings.explicit_terms)
    return corpus.withColumns(
        {
            "has_identity_term": identity.cast("int"),
            "has_obfuscation": dt.has_obfuscation(text).cast("int"),
            "implicit_proxy": ((F.col("binary_label") == 1) & ~explicit).cast("int"),
        }
    )


def slice_summary(df: DataFrame, columns: Sequence[str] = SLICE_COLUMNS) -> DataFrame:
    """Rows and label counts of every value of every slice column, in one aggregation.

    Rows are first counted per combination of values, so the unpivoted table is tiny.
    """
    present = [c for c in columns if c in df.columns]
    combos = df.groupBy(*present, "binary_label").agg(F.count(F.lit(1)).alias("rows"))
    tall = combos.select(
        "binary_label",
        "rows",
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("slice"), F.col(c).cast("string").alias("value"))
                      for c in present])
        ).alias("s"),
    )
    positives = F.sum(F.when(F.col("binary_label") == 1, F.col("rows")).otherwise(0))
    negatives = F.sum(F.when(F.col("binary_label") == 0, F.col("rows")).otherwise(0))
    return tall.groupBy("s.slice", "s.value").agg(
        F.sum("rows").alias("row_count"),
        negatives.alias("label_0"),
        positives.alias("label_1"),
        (positives / F.sum("rows")).alias("positive_ratio"),
    )
