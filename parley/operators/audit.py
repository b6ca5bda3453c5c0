"""Raw-table profiles as tidy tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators.dedup import surplus_rows
from parley.operators.facts import FEATURES, feature_column, raw_profile, surface_features
from parley.session import staged

PERCENTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


def histogram(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """``(measure, value, rows)``: how often each value occurs, nulls left out.

    Partial aggregation keeps one row per distinct value and task, so what follows works on
    distinct values, not on rows.
    """
    columns = df.select(*[c.cast("long").alias(name) for name, c in measures.items()])
    tall = columns.unpivot([], list(measures), "measure", "value")
    return (
        tall.filter(F.col("value").isNotNull())
        .groupBy("measure", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def weighted_percentile(points: Sequence[float]) -> Column:
    """Exact, linearly interpolated percentiles of a histogram."""
    return F.percentile("value", list(points), F.col("rows"))


def length_stats(df: DataFrame, text_column: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and percentiles of text lengths.

    One row for characters and one for words of the raw text; null text has length zero.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    return _length_stats(df, F.length(text), tx.word_count(text))


def _length_stats(df: DataFrame, chars: Column, words: Column) -> DataFrame:
    counts = histogram(df, {"char_length": chars, "word_length": words})
    value = F.col("value").cast("decimal(38,0)")
    n, total = F.sum("rows"), F.sum(value * F.col("rows"))
    squares = F.sum((value * value).cast("decimal(30,0)") * F.col("rows"))
    stats = counts.groupBy("measure").agg(
        n.alias("count"),
        total.cast("double").alias("__sum"),
        squares.cast("double").alias("__squares"),
        F.min("value").cast("double").alias("min"),
        F.max("value").cast("double").alias("max"),
        weighted_percentile(list(PERCENTILES.values())).alias("__p"),
    )
    n, total = F.col("count"), F.col("__sum")
    variance = (F.col("__squares") - total * total / n) / (n - 1)
    return stats.select(
        "measure",
        "count",
        (total / n).alias("mean"),
        F.when(n > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("std"),
        "min",
        *[F.col("__p")[i].alias(name) for i, name in enumerate(PERCENTILES)],
        "max",
    )


def _share(flag: Column) -> Column:
    return F.coalesce(F.avg(flag.cast("int")), F.lit(0.0))


def feature_fractions(df: DataFrame, text_column: str) -> DataFrame:
    """Share of rows (0 to 1) with each surface feature; zeros for an empty table."""
    return df.agg(*[_share(f).alias(n) for n, f in surface_features(F.col(text_column)).items()])


def class_distribution(df: DataFrame, label: str = "binary_label") -> DataFrame:
    """Rows per label, with the overall share of positives on every row."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    # One row per class.
    every = Window.partitionBy()
    positive = F.sum(F.when(F.col(label) == 1, F.col("rows")).otherwise(0)).over(every)
    return counts.withColumn("positive_ratio", positive / F.sum("rows").over(every))


def duplicate_counts(df: DataFrame, text_column: str, fold: bool = True) -> DataFrame:
    """Rows beyond the first of each exact and of each normalised text."""
    return _duplicates(_with_hashes(df, text_column, fold))


def _with_hashes(df: DataFrame, text_column: str, fold: bool) -> DataFrame:
    return tx.add_duplicate_text(df, text_column, "__key", fold).withColumns({
        "raw_null": F.col(text_column).isNull(), "text_hash_raw": tx.sha256_text(F.col(text_column)),
        "text_hash_normalized": F.sha2("__key", 256)}).drop("__key")


def _duplicates(facts: DataFrame) -> DataFrame:
    # A null text is a key of its own.
    exact, normalized = surplus_rows(
        F.when(~F.col("raw_null"), F.col("text_hash_raw")), F.col("text_hash_normalized"))
    return facts.agg(
        exact.alias("exact_duplicate_count"), normalized.alias("normalized_duplicate_count"))


def _tall(row: DataFrame) -> DataFrame:
    """A one-row table as ``(metric, value)`` rows."""
    doubles = row.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in row.columns])
    names = [F.col(f"`{c}`") for c in doubles.columns]
    return doubles.unpivot([], names, "metric", "value")


def audit_facts(facts: DataFrame, labelled: bool = True) -> DataFrame:
    """The whole raw profile of stored facts as ``(metric, value)`` rows; no text is read."""
    counts = [
        F.count(F.lit(1)).alias("total_row_count"),
        F.count_if("raw_null").alias("missing_null_text_count"),
        F.count_if("missing_label").alias("missing_label_count"),
        F.count_if("raw_blank").alias("empty_string_text_count"),
        *[_share(F.col(feature_column(n))).alias(f"feature.{n}") for n in FEATURES],
    ]
    if labelled:
        label = F.col("binary_label")
        counts += [
            F.count_if(label == 0).alias("class.0"),
            F.count_if(label == 1).alias("class.1"),
            F.avg(label).alias("class.positive_ratio"),
        ]
    lengths = _length_stats(facts, F.col("raw_chars"), F.col("raw_words"))
    names = [c for c in lengths.columns if c != "measure"]
    tall_lengths = (
        lengths.select("measure", *[F.col(c).cast("double").alias(c) for c in names])
        .unpivot(["measure"], names, "stat", "value")
        .select(F.concat_ws(".", "measure", "stat").alias("metric"), "value")
    )
    return _tall(facts.agg(*counts)).unionByName(_tall(_duplicates(facts))).unionByName(tall_lengths)


def audit_dataset(
    df: DataFrame,
    text_column: str,
    label_columns: Sequence[str] = (),
    binary_label: Column | None = None,
    fold: bool = True,
) -> DataFrame:
    """The whole raw profile as ``(metric, value)`` rows, from one pass over the texts."""
    label = F.lit(None).cast("int") if binary_label is None else binary_label
    profile = raw_profile(F.col(text_column), label_columns)
    rows = df.select(
        F.col(text_column).alias("__text"), label.alias("binary_label"),
        *[c.alias(n) for n, c in profile.items()])
    facts = staged(_with_hashes(rows, "__text", fold).drop("__text"), "profile")
    return audit_facts(facts, binary_label is not None)
