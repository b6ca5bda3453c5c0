"""The test tables in the shapes the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import labels as lb
from parley.operators import slices, splits
from parley.operators.standardize import removal_summary, standardize, standardize_once
from parley.settings import MULTILABEL_LABELS, PrepSettings
from parley.session import staged

IDENTITY = ("female", "muslim")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, sf_dir: str, *key: str) -> DataFrame:
    """Use all cores if the documents have fewer file splits than there are cores.

    Larger inputs stay as they are read.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    few = table(spark, sf_dir, "documents").rdd.getNumPartitions() < cores
    return df.repartition(cores, *key) if few else df


# The split of a file that a document is read from.
SPLIT = ("__file", "__split")


def _texts(spark, sf_dir, split: tuple[str, ...] = ()) -> DataFrame:
    places = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", *[c.alias(name) for c, name in zip(places, split)])


def documents(spark, sf_dir, split: tuple[str, ...] = ()) -> DataFrame:
    return spread(_texts(spark, sf_dir, split), sf_dir, "doc_id")


def comments(spark, sf_dir) -> DataFrame:
    """Every text of the test set: ``(src, id, text)``."""
    docs = table(spark, sf_dir, "documents").select(
        F.lit("d").alias("src"), F.col("doc_id").alias("id"), "text"
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.lit("c").alias("src"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text"
    )
    pages = table(spark, sf_dir, "pages").select(
        F.lit("p").alias("src"), F.col("page_id").alias("id"), F.col("html").alias("text")
    )
    return spread(docs.union(turns).union(pages), sf_dir, "src", "id")


def labelled(spark, sf_dir, split: tuple[str, ...] = ()) -> DataFrame:
    """Documents with six label columns, as a multi-label source."""
    rows = _texts(spark, sf_dir, split).join(table(spark, sf_dir, "labels"), "doc_id")
    return spread(rows, sf_dir, "doc_id").select(
        F.col("doc_id").alias("source_row_index"),
        F.col("doc_id").cast("string").alias("id"),
        F.col("text").alias("comment_text"),
        "toxic",
        F.lit(0).alias("severe_toxic"),
        (1 - F.col("quality")).alias("obscene"),
        F.lit(None).cast("int").alias("threat"),
        F.lit(0).alias("insult"),
        F.lit(0).alias("identity_hate"),
        *split,
    )


def partly_labelled(spark, sf_dir) -> DataFrame:
    """All documents; labels are missing where no label row exists."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spread(docs.join(table(spark, sf_dir, "labels"), "doc_id", "left"), sf_dir, "doc_id")


def ratio(multiplier: int, column: str = "doc_id"):
    """A reproducible stand-in score between 0 and 1."""
    return ((F.col(column) * multiplier) % 10007) / 10006.0


def scored(spark, sf_dir, split: tuple[str, ...] = ()) -> DataFrame:
    """All documents with a toxicity score and two identity scores."""
    score = ratio(7919)
    return documents(spark, sf_dir, split).select(
        F.col("doc_id").alias("source_row_index"),
        "text",
        score.alias("toxicity"),
        F.when(F.col("doc_id") % 10 != 0, ratio(31) * 0.6).alias("female"),
        (ratio(104729) * 0.55).alias("muslim"),
        *split,
    )


def main_label():
    return lb.multilabel_to_binary(MULTILABEL_LABELS)


def main_corpus(spark, sf_dir) -> DataFrame:
    return standardize(
        labelled(spark, sf_dir), "multilabel", "comment_text", main_label(),
        lb.multilabel_json(MULTILABEL_LABELS),
    )


def scored_corpus(spark, sf_dir) -> DataFrame:
    return standardize(
        scored(spark, sf_dir), "scored", "text", lb.score_to_binary("toxicity", 0.5),
        lb.score_json("toxicity"), carry=IDENTITY,
    )


def sliced_corpus(spark, sf_dir) -> DataFrame:
    stored = staged(slices.add_flags(main_corpus(spark, sf_dir)), "corpus")
    limits = slices.length_thresholds(stored)
    return stored.withColumn("length_bucket", slices.length_bucket(F.col("word_len"), limits))


def split_corpus(spark, sf_dir) -> DataFrame:
    return splits.stratified_split3(sliced_corpus(spark, sf_dir))


def main_train_rows(spark, sf_dir) -> int:
    """The cap of the scored sample: as many rows as the main source trains on.

    The sizes of a split follow from the number of rows, so nothing is split to know them.
    """
    kept = removal_summary(labelled(spark, sf_dir), "comment_text", main_label()).first()["output_rows"]
    rest, _ = splits.part_sizes(kept, PrepSettings.test_size)
    return splits.part_sizes(rest, PrepSettings.val_size / (1.0 - PrepSettings.test_size))[0]


def split_scored(spark, sf_dir) -> DataFrame:
    stored = staged(
        slices.add_flags(scored_corpus(spark, sf_dir), score_columns=IDENTITY), "scored"
    )
    return splits.stratified_split2(stored)


def split_scored_once(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """``split_scored`` to be written once, without a stored copy, and its stored ids and splits."""
    index, corpus = standardize_once(
        scored(spark, sf_dir), "scored", "text", lb.score_to_binary("toxicity", 0.5),
        lb.score_json("toxicity"), carry=IDENTITY,
    )
    split = splits.split2_column(index)
    flagged = slices.add_flags(corpus, score_columns=IDENTITY)
    return index.withColumn("split", split), flagged.withColumn("split", split)


def predictions(spark, sf_dir) -> DataFrame:
    """All documents with the stand-in probability as a model's output."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("row_id"),
        F.col("text").alias("original_text"),
        ratio(7919).alias("toxic_probability"),
    )


def length_scorer(df: DataFrame, text_column: str) -> DataFrame:
    """A reproducible stand-in model: a score from the text length."""
    score = ((F.length(text_column).cast("long") * 7919) % 10007) / 10006.0
    return df.withColumn("toxic_probability", score)
