"""Train on one split, evaluate on the others, compare models on the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators import metrics
from parley.operators.modeling import LinearScorer, fit_logistic


@dataclass
class Evaluation:
    scorer: LinearScorer
    predictions: DataFrame
    metrics: DataFrame


def predict_splits(
    corpus: DataFrame, scorer: LinearScorer, text_column: str = "text_tfidf", threshold: float = 0.5
) -> DataFrame:
    return scorer(corpus, text_column).withColumn(
        "prediction", (F.col("toxic_probability") >= threshold).cast("int")
    )


def train_and_evaluate(
    corpus: DataFrame, text_column: str = "text_tfidf", max_features: int = 50_000, min_df: int = 2,
    fit: Callable[..., LinearScorer] = fit_logistic,
) -> Evaluation:
    """Fit on train, then metrics for val and test. ``corpus`` should be a stored table."""
    train = corpus.filter(F.col("split") == "train")
    scorer = fit(train, text_column, max_features=max_features, min_df=min_df)
    held_out = predict_splits(corpus.filter(F.col("split") != "train"), scorer, text_column)
    return Evaluation(
        scorer, held_out, metrics.binary_metrics(held_out, "binary_label", "prediction", ["split"])
    )
