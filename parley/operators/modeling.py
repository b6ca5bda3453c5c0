"""The logistic-regression baseline and scoring."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import text as tx
from parley.operators.tfidf import TfidfModel, array_literal, fit_tfidf
from parley.session import scratch_path

# Weights that one task of the fit holds (some 60 MB).
PARTITION_TERMS = 5_000_000
# Relative progress at which the fit ends; leaves a residual of some 1e-4 per coefficient.
TOLERANCE = 1e-10

# Adds ``toxic_probability`` (double) to a table given its cleaned-text column.
Scorer = Callable[[DataFrame, str], DataFrame]


def balanced_class_weights(df: DataFrame, label: str = "binary_label") -> DataFrame:
    """``n / (classes * rows of the class)`` per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    every = Window.partitionBy()  # one row per class
    return counts.withColumn(
        "weight",
        F.sum("rows").over(every) / (F.count(F.lit(1)).over(every) * F.col("rows")),
    )


@dataclass(frozen=True)
class LinearScorer:
    """A fitted TF-IDF vocabulary with one coefficient per term."""

    features: TfidfModel
    coefficients: tuple[float, ...]
    intercept: float

    def __call__(self, df: DataFrame, text_column: str) -> DataFrame:
        """Add ``toxic_probability``; rows are scored where they are, in built-in expressions.

        Texts are case-folded first, as the texts were that the model is fitted on.
        """
        folded = tx.add_casefolded(df, text_column, "__folded")
        return (
            self.margins(folded, "__folded")
            .withColumn("toxic_probability", 1.0 / (1.0 + F.exp(-F.col("margin"))))
            .drop("tfidf", "margin", "__folded")
        )

    def margins(self, df: DataFrame, text_column: str) -> DataFrame:
        """Add ``tfidf`` and the linear ``margin`` of texts that are folded already."""
        weights = array_literal(self.coefficients)
        products = F.zip_with(
            F.col("tfidf.indices"), F.col("tfidf.weights"), lambda i, w: w * F.get(weights, i)
        )
        margin = F.aggregate(products, F.lit(self.intercept), lambda acc, x: acc + x)
        return self.features.weights(df, text_column).withColumn("margin", margin)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = list(zip(range(len(self.coefficients)), self.features.terms, self.features.idf, self.coefficients))
        rows.append((-1, None, None, self.intercept))
        schema = "idx int, term string, idf double, coefficient double"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearScorer:
        rows = spark.read.parquet(path).orderBy("idx").collect()
        head, rest = rows[0], rows[1:]
        return cls(
            TfidfModel(tuple(r["term"] for r in rest), tuple(r["idf"] for r in rest)),
            tuple(r["coefficient"] for r in rest),
            head["coefficient"],
        )


def _feature_table(df: DataFrame, model: TfidfModel, text_column: str, label: str) -> tuple[DataFrame, int]:
    """Labels, class weights and sparse vectors in a table in the shared folder, and its rows.

    The vectors are written as their plain struct and read back as vectors; the optimiser's
    many passes then read a file instead of repeating the text work. They are read in partitions
    of PARTITION_TERMS weights: each pass is a job, and small tables gain nothing from more tasks.
    """
    spark = df.sparkSession
    weights = balanced_class_weights(df.select(label), label).select(label, "weight")
    rows = model.weights(df.select(label, text_column), text_column)
    path = scratch_path(spark, "features")
    rows.join(F.broadcast(weights), label).select(
        F.col(label).cast("double").alias("label"),
        "weight",
        F.struct(
            F.lit(0).cast("byte").alias("type"),
            F.lit(len(model.terms)).alias("size"),
            F.col("tfidf.indices").alias("indices"),
            F.col("tfidf.weights").alias("values"),
        ).alias("features"),
    ).write.parquet(path)
    schema = T.StructType(
        [
            T.StructField("label", T.DoubleType()),
            T.StructField("weight", T.DoubleType()),
            T.StructField("features", VectorUDT()),
        ]
    )
    size = spark.read.parquet(path).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.size("features.indices")).alias("terms")).first()
    table = spark.read.schema(schema).parquet(path)
    return table.coalesce(1 + (size["terms"] or 0) // PARTITION_TERMS), size["rows"]


def fit_logistic(
    train: DataFrame,
    text_column: str = "text_tfidf",
    label: str = "binary_label",
    max_features: int = 50_000,
    min_df: int = 2,
    c: float = 1.0,
    max_iter: int = 1000,
) -> LinearScorer:
    """Fit TF-IDF and a class-balanced, L2-regularised logistic regression on ``train`` only.

    The balanced weights sum to the row count, hence the penalty ``1 / (c * rows)``.
    """
    model = fit_tfidf(train, text_column, max_features, min_df)
    table, rows = _feature_table(train, model, text_column, label)
    regression = LogisticRegression(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        regParam=1.0 / (c * rows),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=TOLERANCE,
    ).fit(table)
    return LinearScorer(
        model, tuple(float(x) for x in regression.coefficients), float(regression.intercept)
    )


def fit_residuals(
    scorer: LinearScorer, train: DataFrame, text_column: str = "text_tfidf",
    label: str = "binary_label", c: float = 1.0,
) -> DataFrame:
    """``(term, residual)``: how far each coefficient is from the optimum's equation.

    At the least of ``w'w / 2 + c * sum of weighted losses`` every ``w_j + c * sum of
    weight * (p - y) * x_j`` is zero, and no coefficient is further from the optimum than the
    residuals' norm. The intercept, which is not penalised, has the null term.
    """
    model = scorer.features
    weights = balanced_class_weights(train.select(label), label).select(label, "weight")
    scored = scorer.margins(train.select(label, text_column), text_column)
    pull = scored.join(F.broadcast(weights), label).select(
        "tfidf", (F.col("weight") * (1.0 / (1.0 + F.exp(-F.col("margin"))) - F.col(label))).alias("error"))
    terms = F.arrays_zip(F.col("tfidf.indices").alias("i"), F.col("tfidf.weights").alias("w"))
    # The intercept is a term of weight 1 in every row.
    every = F.array_append(F.transform(terms, lambda t: F.struct(t["i"].alias("i"), t["w"].alias("w"))),
                           F.struct(F.lit(-1).alias("i"), F.lit(1.0).alias("w")))
    sums = (
        pull.select("error", F.explode(every).alias("t"))
        .groupBy(F.col("t.i").alias("index")).agg((F.sum(F.col("error") * F.col("t.w")) * c).alias("pull"))
    )
    spark = train.sparkSession
    own = spark.createDataFrame(
        [(-1, None, 0.0), *((i, t, w) for i, (t, w) in enumerate(zip(model.terms, scorer.coefficients)))],
        "index int, term string, coefficient double")
    return own.join(sums, "index", "left").select(
        "term", (F.col("coefficient") + F.coalesce("pull", F.lit(0.0))).alias("residual"))


def fit_log_odds(
    train: DataFrame, text_column: str = "text_tfidf", label: str = "binary_label",
    max_features: int = 50_000, min_df: int = 2,
) -> LinearScorer:
    """A counted baseline: a term's coefficient is the log ratio of its smoothed shares of
    positive and of negative texts, the intercept the log ratio of the classes."""
    model = fit_tfidf(train, text_column, max_features, min_df)
    rows = model.weights(train.select(label, text_column), text_column)
    counts = rows.select(label, F.explode("tfidf.indices").alias("index")).groupBy("index").agg(
        F.count_if(F.col(label) == 1).alias("positive"), F.count_if(F.col(label) == 0).alias("negative"))
    whole = train.agg(F.count_if(F.col(label) == 1).alias("positive"),
                      F.count_if(F.col(label) == 0).alias("negative")).first()
    ratio = F.log((F.col("positive") + 1.0) / (whole.positive + 2.0)) - F.log(
        (F.col("negative") + 1.0) / (whole.negative + 2.0))
    # One number per term of the vocabulary.
    found = counts.select("index", ratio.alias("coefficient")).toArrow().to_pydict()
    coefficients = [0.0] * len(model.terms)
    for i, value in zip(found["index"], found["coefficient"]):
        coefficients[i] = value
    return LinearScorer(model, tuple(coefficients), math.log((whole.positive + 1) / (whole.negative + 1)))


def score_comments(
    df: DataFrame, text_column: str, scorer: Scorer, threshold: float = 0.5
) -> DataFrame:
    """Clean, score and label comments; prediction columns are appended to the same rows."""
    from parley.operators.triage import PREDICTION_COLUMNS, apply_threshold

    clash = sorted(set(PREDICTION_COLUMNS) & set(df.columns))
    if clash:
        raise ValueError(f"input already has prediction columns {clash}")
    original = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    prepared = tx.add_clean_text(
        df.withColumn("original_text", original), "original_text", "cleaned_text"
    )
    scored = apply_threshold(scorer(prepared, "cleaned_text"), threshold)
    return scored.select(*df.columns, *PREDICTION_COLUMNS)
