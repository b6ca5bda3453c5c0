"""From probabilities to a ranked review queue."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.cues import add_cues, cue_summary, explode_once
from parley.functions.numbers import format_percent, round_exact
from parley.operators.rowindex import index_by_order
from parley.settings import CUE_TERMS, CueTerm

PREDICTION_COLUMNS = (
    "original_text", "cleaned_text", "predicted_label", "numeric_label", "confidence",
    "toxic_probability", "non_toxic_probability", "threshold",
)
# Lower bound, band, recommendation, priority and reviewer sentence.
BANDS = (
    (0.85, "High", "High priority for human review", 1,
     "This comment should be prioritised for human review."),
    (0.65, "Medium", "Review recommended", 2,
     "This comment may require review depending on moderation policy."),
    (0.50, "Borderline", "Review if moderation capacity allows", 3,
     "This comment shows some risk signals and may require context."),
    (None, "Low", "No immediate review priority", 4,
     "No immediate review priority detected."),
)
EXPORT_COLUMNS = (
    "row_id", "original_text", "prediction", "risk_level", "risk_score", "risk_score_percent",
    "review_recommendation", "review_priority", "keyword_cues", "toxic_probability",
    "non_toxic_probability", "confidence", "threshold", "cleaned_text",
)


def apply_threshold(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add the label, confidence and complement of ``toxic_probability``."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError(f"threshold must be between 0 and 1, got {threshold}")
    p = F.col("toxic_probability")
    other = F.col("non_toxic_probability") if "non_toxic_probability" in df.columns else 1.0 - p
    label = (p >= threshold).cast("int")
    return df.withColumns(
        {
            "numeric_label": label,
            "predicted_label": F.when(label == 1, "toxic").otherwise("non-toxic"),
            "non_toxic_probability": other,
            "confidence": F.greatest(p, other),
            "threshold": F.lit(float(threshold)),
        }
    )


def _by_band(probability: Column, field: int) -> Column:
    *upper, last = BANDS
    chosen = F.lit(last[field])
    for band in reversed(upper):
        chosen = F.when(probability >= band[0], band[field]).otherwise(chosen)
    return chosen


def risk_level(probability: Column) -> Column:
    return _by_band(probability, 1)


def classify_risk(df: DataFrame, probability: str = "toxic_probability") -> DataFrame:
    """Add band, recommendation and priority of the unrounded probability."""
    p = F.col(probability)
    return df.withColumns(
        {
            "risk_level": _by_band(p, 1),
            "review_recommendation": _by_band(p, 2),
            "review_priority": _by_band(p, 3),
        }
    )


def risk_explanation(level: Column) -> Column:
    """The reviewer sentence of a band; unknown bands read like the lowest."""
    sentence = F.lit(BANDS[-1][4])
    for band in BANDS[:-1]:
        sentence = F.when(level == band[1], band[4]).otherwise(sentence)
    return sentence


def build_review_items(
    predictions: DataFrame, terms: Iterable[CueTerm] = CUE_TERMS
) -> DataFrame:
    """Nested review items from prediction rows (``row_id``, ``original_text`` and scores).

    Missing or unreadable prediction fields fall back to values derived from the others.
    """
    def given(name: str, kind: str) -> Column:
        if name not in predictions.columns:
            return F.lit(None).cast(kind)
        return F.col(name).try_cast(kind)

    text = F.coalesce(given("original_text", "string"), F.lit(""))
    p, t = F.col("__p"), F.col("__t")
    non_toxic, label = F.col("__q"), F.col("__n")
    prepared = (
        predictions.withColumn("__text", text)
        .withColumn("__p", F.coalesce(given("toxic_probability", "double"), F.lit(0.0)))
        .withColumn("__t", F.coalesce(given("threshold", "double"), F.lit(0.5)))
        .withColumn(
            "__q",
            F.coalesce(given("non_toxic_probability", "double"), F.greatest(F.lit(0.0), 1.0 - p)),
        )
        .withColumn("__n", F.coalesce(given("numeric_label", "int"), (p >= t).cast("int")))
        .withColumn(
            "__label",
            F.coalesce(
                F.nullif(given("predicted_label", "string"), F.lit("")),
                F.when(label == 1, "toxic").otherwise("non-toxic"),
            ),
        )
    )
    row_id = F.col("row_id").cast("long") if "row_id" in predictions.columns else F.lit(None).cast("long")
    confidence = F.coalesce(given("confidence", "double"), F.greatest(p, non_toxic))
    return add_cues(prepared, "__text", "__cues", terms).select(
        row_id.alias("row_id"),
        F.col("__text").alias("original_text"),
        F.col("__label").alias("prediction"),
        _by_band(p, 1).alias("risk_level"),
        round_exact(p, 4).alias("risk_score"),
        format_percent(p).alias("risk_score_percent"),
        _by_band(p, 2).alias("review_recommendation"),
        _by_band(p, 3).alias("review_priority"),
        F.col("__cues").alias("detected_cues"),
        F.struct(
            F.col("__label").alias("predicted_label"),
            label.alias("numeric_label"),
            p.alias("toxic_probability"),
            non_toxic.alias("non_toxic_probability"),
            confidence.alias("confidence"),
            t.alias("threshold"),
            F.coalesce(given("cleaned_text", "string"), F.lit("")).alias("cleaned_text"),
        ).alias("advanced"),
    )


def _queue_order() -> list[Column]:
    return [F.desc("risk_score"), F.asc("row_id")]


def review_queue(items: DataFrame) -> DataFrame:
    """Items by rounded score, highest first; ties stay in file order."""
    return items.orderBy(*_queue_order())


def queue_filter(items: DataFrame, level: str = "All") -> DataFrame:
    if level not in ("All", *[b[1] for b in BANDS]):
        raise ValueError(f"unknown risk level {level!r}")
    return items if level == "All" else items.filter(F.col("risk_level") == level)


def queue_topk(items: DataFrame, level: str = "All", limit: int | None = None) -> DataFrame:
    """The head of the filtered queue (the whole of it without a limit)."""
    queue = review_queue(queue_filter(items, level))
    return queue if limit is None else queue.limit(limit)


def queue_rank(items: DataFrame, level: str = "All", limit: int | None = None) -> DataFrame:
    """Add the 1-based ``rank`` in the displayed queue.

    A limited queue is small after its distributed top-k; the full queue is numbered from its
    sorted files.
    """
    if limit is None:
        return index_by_order(queue_filter(items, level), _queue_order(), "rank", start=1)
    top = queue_topk(items, level, limit)
    from pyspark.sql import Window

    return top.withColumn("rank", F.row_number().over(Window.orderBy(*_queue_order())).cast("long"))


def queue_summary(items: DataFrame) -> DataFrame:
    """One row of queue totals; zeros for an empty queue."""
    level = F.col("risk_level")
    counts = {
        "high_risk": F.count_if(level == "High"),
        "medium_risk": F.count_if(level == "Medium"),
        "borderline": F.count_if(level == "Borderline"),
        "low_risk": F.count_if(level == "Low"),
    }
    toxic = F.count_if(F.col("prediction") == "toxic")
    row = items.agg(
        F.count(F.lit(1)).alias("total_comments"),
        *[c.alias(n) for n, c in counts.items()],
        toxic.alias("predicted_toxic"),
        # Rounded scores are whole ten-thousandths, so their sum is exact.
        F.sum(F.rint(F.col("risk_score") * 10000.0).cast("long")).alias("__units"),
    )
    mean = F.coalesce(F.col("__units") / F.col("total_comments") / 10000.0, F.lit(0.0))
    return row.withColumn("__mean", mean).select(
        "total_comments",
        (F.col("high_risk") + F.col("medium_risk") + F.col("borderline")).alias("needs_review"),
        *counts,
        "predicted_toxic",
        (F.col("total_comments") - F.col("predicted_toxic")).alias("predicted_non_toxic"),
        round_exact(F.col("__mean"), 4).alias("average_risk_score"),
        format_percent(F.col("__mean")).alias("average_risk_score_percent"),
    )


def risk_distribution(items: DataFrame) -> DataFrame:
    """Count and share of all four bands, empty bands included."""
    row = items.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("risk_level") == b[1]).alias(b[1]) for b in BANDS],
    )
    total = F.col("total")
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(b[1]).alias("risk_level"),
                        F.col(b[1]).alias("rows"),
                        F.when(total == 0, 0.0).otherwise(F.col(b[1]) / total).alias("share"),
                    )
                    for b in BANDS
                ]
            )
        )
    )


def cue_statistics(items: DataFrame) -> DataFrame:
    """Comments and hits per cue term."""
    return (
        explode_once(items.select("detected_cues"), "detected_cues", "c")
        .groupBy("c.keyword", "c.category", "c.severity")
        .agg(F.count(F.lit(1)).alias("comments"), F.sum("c.count").alias("hits"))
    )


def export_rows(items: DataFrame) -> DataFrame:
    """Items flattened to the fourteen export columns."""
    flat = items.select(
        *[c for c in items.columns if c not in ("advanced", "detected_cues")],
        cue_summary(F.col("detected_cues")).alias("keyword_cues"),
        "advanced.toxic_probability",
        "advanced.non_toxic_probability",
        "advanced.confidence",
        "advanced.threshold",
        "advanced.cleaned_text",
    )
    return flat.select(*EXPORT_COLUMNS)
