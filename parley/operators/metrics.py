"""Binary classification metrics from (label, prediction) counts.

Every metric derives from one small grouped count, so a table is read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("accuracy", "precision", "recall", "f1")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def _cells(label: str, prediction: str) -> dict[str, Column]:
    y, p = F.col(label) == 1, F.col(prediction) == 1
    return {
        "tp": F.count_if(y & p),
        "fp": F.count_if(~y & p),
        "fn": F.count_if(y & ~p),
        "tn": F.count_if(~y & ~p),
    }


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(2 * tp, 2 * tp + fp + fn)


def binary_metrics(
    df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class; 0/0 is 0."""
    counts = df.groupBy(*by).agg(*[c.alias(n) for n, c in _cells(label, prediction).items()])
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *by,
        (tp + fp + fn + tn).alias("rows"),
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _f1(tp, fp, fn).alias("f1"),
    )


def evaluate_slices(
    df: DataFrame, label: str, prediction: str, slices: Sequence[str]
) -> DataFrame:
    """The metrics of every value of every slice column."""
    combos = df.groupBy(*slices, label, prediction).agg(F.count(F.lit(1)).alias("n"))
    tall = combos.select(
        F.col(label).alias("y"),
        F.col(prediction).alias("p"),
        "n",
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("slice"), F.col(c).cast("string").alias("value"))
                      for c in slices])
        ).alias("s"),
    )

    def total(condition):
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    y, p = F.col("y") == 1, F.col("p") == 1
    counts = tall.groupBy("s.slice", "s.value").agg(
        total(y & p).alias("tp"), total(~y & p).alias("fp"),
        total(y & ~p).alias("fn"), total(~y & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "slice", "value",
        (tp + fp + fn + tn).alias("rows"),
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _f1(tp, fp, fn).alias("f1"),
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """All four (actual, predicted) counts, zeros included."""
    row = df.agg(*[c.alias(n) for n, c in _cells(label, prediction).items()])
    cells = ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(actual).alias("actual"),
                        F.lit(predicted).alias("predicted"),
                        F.col(name).alias("rows"),
                    )
                    for actual, predicted, name in cells
                ]
            )
        )
    )


def classification_report(
    df: DataFrame, label: str, prediction: str, names: tuple[str, str] = ("Non-Toxic", "Toxic")
) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and both averages."""
    row = df.agg(*[c.alias(n) for n, c in _cells(label, prediction).items()])
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    neg = (_ratio(tn, tn + fn), _ratio(tn, tn + fp), _f1(tn, fn, fp), tn + fp)
    pos = (_ratio(tp, tp + fp), _ratio(tp, tp + fn), _f1(tp, fp, fn), tp + fn)
    accuracy = _ratio(tp + tn, n)
    macro = tuple((a + b) / 2 for a, b in zip(neg[:3], pos[:3]))
    weighted = tuple(_ratio(a * neg[3] + b * pos[3], n) for a, b in zip(neg[:3], pos[:3]))

    def line(name, values, support):
        return F.struct(
            F.lit(name).alias("class"),
            *[v.alias(m) for v, m in zip(values, ("precision", "recall", "f1"))],
            support.cast("long").alias("support"),
        )

    nothing = F.lit(None).cast("double")
    return row.select(
        F.inline(
            F.array(
                line(names[0], neg[:3], neg[3]),
                line(names[1], pos[:3], pos[3]),
                line("accuracy", (nothing, nothing, accuracy), n),
                line("macro avg", macro, n),
                line("weighted avg", weighted, n),
            )
        )
    )


def metric_table(metrics: DataFrame, value: str = "value") -> DataFrame:
    """One-row metrics as ``(metric, value)``."""
    return metrics.select(*METRICS).unpivot([], list(METRICS), "metric", value)


def model_comparison(baseline: DataFrame, advanced: DataFrame) -> DataFrame:
    """Two ``(metric, value)`` tables side by side with the gain of the second."""
    return baseline.withColumnRenamed("value", "baseline").join(
        advanced.withColumnRenamed("value", "advanced"), "metric"
    ).withColumn("delta", F.col("advanced") - F.col("baseline"))


def class_share_percent(df: DataFrame, label: str = "binary_label") -> DataFrame:
    """Share of each class as text with one decimal."""
    from parley.functions.numbers import scaled_round

    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    share = F.col("rows") / F.sum("rows").over(Window.partitionBy())  # one row per class
    tenths = scaled_round(share * 100.0, 1).cast("long")
    text = F.concat(
        F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%")
    )
    return counts.select(label, "rows", text.alias("share"))
