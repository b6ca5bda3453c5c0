"""Quality checks on a split corpus."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators import leakage
from parley.operators.audit import histogram, weighted_percentile
from parley.operators.dedup import surplus_rows
from parley.session import staged
from parley.settings import PrepSettings


def class_distribution_by_split(df: DataFrame) -> DataFrame:
    """Rows, label counts and positive share of each split."""
    label = F.col("binary_label")
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(label == 0).alias("label_0"),
        F.count_if(label == 1).alias("label_1"),
        F.avg(label).alias("positive_ratio"),
    )


def label_drift(by_split: DataFrame, limit: float = PrepSettings.drift_limit) -> DataFrame:
    """Distance of each split's positive share from the overall share, and whether it is too far."""
    # One row per split.
    every = Window.partitionBy()
    overall = F.sum("label_1").over(every) / F.sum("row_count").over(every)
    drift = F.abs(F.coalesce("positive_ratio", F.lit(0.0)) - F.coalesce("overall_ratio", F.lit(0.0)))
    return (
        by_split.withColumn("overall_ratio", overall)
        .withColumn("drift", drift)
        .select(
            "split", "positive_ratio", "overall_ratio", "drift",
            (F.col("drift") > limit).alias("exceeds_limit"),
        )
    )


def small_splits(by_split: DataFrame, minimum: int = PrepSettings.small_split_rows) -> DataFrame:
    return by_split.filter(F.col("row_count") < minimum).select("split", "row_count")


def missing_after_prep(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(tx.is_blank(F.col("text_clean"))).alias("missing_text_after_cleaning"),
        F.count_if(F.col("binary_label").isNull()).alias("missing_labels_after_harmonization"),
    )


def hash_duplicates(df: DataFrame) -> DataFrame:
    """Duplicate hashes left in a prepared corpus."""
    raw, normalized = surplus_rows(F.col("text_hash_raw"), F.col("text_hash_normalized"))
    return df.agg(
        raw.alias("raw_hash_duplicates"), normalized.alias("normalized_hash_duplicates")
    )


def token_length_diagnostics(df: DataFrame, column: str = "bert_token_len") -> DataFrame:
    """Token-length profile as one row; ``available`` is false without any length."""
    counts = histogram(df, {"tokens": F.col(column)})
    n = F.sum("rows")

    def share_over(limit):
        return F.sum(F.when(F.col("value") > limit, F.col("rows")).otherwise(0)) / n

    return counts.agg(
        n.isNotNull().alias("available"),
        (F.sum(F.col("value") * F.col("rows")) / n).alias("mean"),
        weighted_percentile([0.5, 0.9, 0.95]).alias("__p"),
        share_over(128).alias("fraction_gt_128"),
        share_over(256).alias("fraction_gt_256"),
    ).select(
        "available",
        "mean",
        F.col("__p")[0].alias("median"),
        F.col("__p")[1].alias("p90"),
        F.col("__p")[2].alias("p95"),
        "fraction_gt_128",
        "fraction_gt_256",
    )


@dataclass
class Validation:
    """The checks of one source and the warnings they raised, in order."""

    source: str
    tables: dict[str, DataFrame]
    warnings: list[tuple[str, str, str]] = field(default_factory=list)


def text_tables(df: DataFrame) -> dict[str, DataFrame]:
    """The checks of texts and of their token lengths, of the columns that ``df`` has."""
    tables = {}
    if "text_clean" in df.columns:
        tables["missing_after_prep"] = missing_after_prep(df)
    if "bert_token_len" in df.columns:
        tables["token_length_diagnostics"] = token_length_diagnostics(df)
    return tables


def validate_dataset(
    df: DataFrame,
    source: str,
    splits: Sequence[str],
    settings: PrepSettings = PrepSettings(),
) -> Validation:
    """Run all checks; leakage raises unless ``fail_on_leakage`` is off.

    Only per-split rows and per-pair counts reach the driver.
    """
    by_split = class_distribution_by_split(df)
    drift = label_drift(by_split, settings.drift_limit)
    # A few rows, which the gate in the plan reads again.
    overlaps = staged(leakage.split_hash_overlap(df, splits), "overlaps")
    tables = {
        "class_distribution_by_split": by_split,
        "label_ratio_drift": drift,
        "hash_overlap_across_splits": overlaps,
        "duplicate_counts_after_removal": hash_duplicates(df),
        **text_tables(df),
    }
    warnings = [
        (source, "small_split",
         f"{source}:{r['split']} is suspiciously small with {r['row_count']} rows.")
        for r in small_splits(by_split, settings.small_split_rows).orderBy("split").collect()
    ]
    drifted = drift.filter("exceeds_limit").orderBy("split").collect()
    if drifted:
        listed = ", ".join(f"{r['split']} {r['drift']:.6f}" for r in drifted)
        warnings.append(
            (source, "label_drift",
             f"{source} label-ratio drift across splits exceeds {settings.drift_limit}: {listed}.")
        )
    warnings += [
        (source, "leakage", message)
        for message in leakage.leakage_gate(overlaps, source, settings.fail_on_leakage)
    ]
    return Validation(source, tables, warnings)
