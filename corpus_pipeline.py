"""From raw documents to training sequences in five stages.

Each stage takes ``(spark, docs, sf_dir)``, docs being what its predecessor kept, and its result
is stored before the next one reads it. All stages read whole texts, very long ones too, take
null and empty texts as texts without words, and give no rows for an empty table. Columns beyond
the five of the documents are not carried, whatever their names. Repeated rows are rows of their
own until ``jaccard_join`` keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.classifier import classify
from parley.llm.common import stored, table
from parley.llm.decontamination import find_contamination
from parley.llm.jaccard_join import keep_one_of_each
from parley.llm.line_dedup import drop_boilerplate
from parley.llm.packing import best_fit_packing, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality reaches the classifier's threshold.

    A score equal to it is kept. Null and empty texts have the score of a text without words.
    Without labels every score is 0.5 and nothing is kept.
    """
    rows = classify(docs, "doc_id", "text", table(spark, sf_dir, "labels"))
    return rows.filter("predicted = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate in their source.

    The ratio decides at every size of a source: a line need only be repeated at all.
    Copies of one text count as one page, so that one of them is left for the next stage. Null
    texts stay null, with a null ``n_chars``; a null source is a source of its own; a share equal
    to the ratio stays.
    """
    rows = drop_boilerplate(docs, "source", "text", min_pages=2, copies=False)
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: that of the smallest id, null first.

    Documents without words have no copies and all stay.
    """
    return keep_one_of_each(docs, "doc_id", "text").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no benchmark window; null and empty texts share none."""
    benchmark = table(spark, sf_dir, "benchmark")
    rows = find_contamination(docs, "text", benchmark, "item_id", "text")
    return rows.filter("n_hit = 0").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence; null and empty texts are one
    piece of the end id alone."""
    return best_fit_packing(docs, "doc_id", "text", tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("packing", packing),
]

# The first stage fits a network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
