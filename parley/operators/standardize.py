"""From raw labelled comments to the standard corpus table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators.facts import ROW, text_facts
from parley.operators.rowindex import index_by_key, with_numbers
from parley.session import staged
from parley.settings import PrepSettings

CORPUS_COLUMNS = (
    "sample_id", "source_dataset", "raw_text", "text_clean", "text_tfidf", "binary_label",
    "orig_label_info", "char_len", "word_len", "text_hash_raw", "text_hash_normalized",
)


def _survivors(facts: DataFrame, settings: PrepSettings) -> DataFrame:
    if settings.remove_missing_text:
        facts = facts.filter(~F.col("raw_blank") & ~F.col("clean_blank"))
    if settings.remove_missing_labels:
        facts = facts.filter(~F.col("no_label"))
    return facts


def _numbers(rows: DataFrame, settings: PrepSettings) -> DataFrame:
    """The row numbers that stay, with the sample numbers they get."""
    slim = rows.select(ROW, F.col("text_hash_normalized").alias("hash"))
    if settings.remove_duplicates:
        slim = slim.groupBy("hash").agg(F.min(ROW).alias(ROW))
    return index_by_key(slim.select(ROW), ROW, "__number")


def _sample_id(source: str) -> Column:
    return F.format_string(f"{source}_%08d", F.col("__number"))


def _corpus(numbered: DataFrame, source: str, carry: tuple[str, ...]) -> DataFrame:
    return (
        numbered.withColumn("sample_id", _sample_id(source))
        .withColumn("source_dataset", F.lit(source))
        .withColumn("text_tfidf", tx.casefold(F.col("text_clean")))
        .select(*CORPUS_COLUMNS, *carry)
    )


def corpus_from_facts(
    facts: DataFrame, source: str, settings: PrepSettings = PrepSettings(),
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """The standard corpus from stored facts.

    Duplicates are found and sample numbers assigned on the slim ``(hash, row)`` projection; the
    texts are shuffled once, by row number.
    """
    rows = _survivors(facts, settings)
    return _corpus(rows.join(_numbers(rows, settings), ROW), source, carry)


def standardize_once(
    raw: DataFrame,
    source: str,
    text_column: str,
    label: Column,
    label_info: Column,
    settings: PrepSettings = PrepSettings(),
    carry: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """The corpus of :func:`standardize` for a caller that writes it once, and its stored index:
    the ids and classes of its rows.

    No text is stored or shuffled on the way: each is normalised for its hash, and those that stay
    again when the corpus is written.
    """
    facts = text_facts(raw, text_column, label, label_info, settings, profile=False)
    slim = staged(facts.select(
        ROW, "binary_label", "raw_blank", "clean_blank", "no_label", "text_hash_normalized"), "facts")
    index, corpus = corpus_from_slim_facts(
        slim, raw, source, text_column, label, label_info, settings, carry, ("binary_label",))
    return staged(index, "index"), corpus


def corpus_from_slim_facts(
    facts: DataFrame,
    raw: DataFrame,
    source: str,
    text_column: str,
    label: Column,
    label_info: Column,
    settings: PrepSettings = PrepSettings(),
    carry: tuple[str, ...] = (),
    columns: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """The ids and some ``columns`` of the rows that stay, from stored facts that need not hold
    texts, and the corpus, whose texts are normalised again as it is written."""
    rows = _survivors(facts, settings)
    numbers = staged(_numbers(rows, settings), "numbers")
    index = rows.join(numbers, ROW).select(_sample_id(source).alias("sample_id"), *columns)
    texts = with_numbers(raw.withColumn(ROW, F.col(ROW).cast("long")), numbers, ROW, "__number")
    kept = _survivors(text_facts(
        texts, text_column, label, label_info, settings, (*carry, "__number"), profile=False), settings)
    return index, _corpus(kept, source, carry)


def standardize(
    raw: DataFrame,
    source: str,
    text_column: str,
    label: Column,
    label_info: Column,
    settings: PrepSettings = PrepSettings(),
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Clean, hash, de-duplicate and number the rows of one labelled source.

    ``raw`` needs a unique long ``source_row_index`` giving the source order. Each text is
    normalised once, into stored facts.
    """
    facts = text_facts(raw, text_column, label, label_info, settings, carry, profile=False)
    return corpus_from_facts(staged(facts, "facts"), source, settings, carry)


def removals_from_facts(facts: DataFrame, settings: PrepSettings = PrepSettings()) -> DataFrame:
    """One row counting what :func:`corpus_from_facts` removes and why.

    The counters describe the rows reaching each step even when that step is switched off.
    """
    raw_blank, clean_blank, no_label = (F.col(c) for c in ("raw_blank", "clean_blank", "no_label"))
    always = F.lit(True)
    text_ok = ~raw_blank if settings.remove_missing_text else always
    label_ok = ~no_label if settings.remove_missing_labels else always
    reached_clean = text_ok & label_ok
    clean_ok = ~clean_blank if settings.remove_missing_text else always
    reached_dedup = reached_clean & clean_ok

    kept_rows = F.count_if(reached_dedup)
    surplus = kept_rows - F.count_distinct(F.when(reached_dedup, F.col("text_hash_normalized")))
    output = kept_rows - surplus if settings.remove_duplicates else kept_rows
    return facts.agg(
        F.count(F.lit(1)).alias("input_rows"),
        (F.count_if(raw_blank) + F.count_if(reached_clean & clean_blank)).alias("removed_missing_text"),
        F.count_if(text_ok & no_label).alias("removed_missing_labels"),
        surplus.alias("removed_normalized_duplicates"),
        output.alias("output_rows"),
    )


def removal_summary(
    raw: DataFrame,
    text_column: str,
    label: Column,
    settings: PrepSettings = PrepSettings(),
) -> DataFrame:
    """What :func:`standardize` removes and why, as one row."""
    info = F.lit(None).cast("string")
    return removals_from_facts(text_facts(raw, text_column, label, info, settings, profile=False), settings)
