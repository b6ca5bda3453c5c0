"""What later steps need to know about the texts of a source, found in one pass.

Audit, removal counts, duplicates and the standard corpus all start from the same unescaping,
normalisation and hashing. ``text_facts`` does these once per row. Stored as Parquet, every
step then reads the few narrow columns that it needs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import detectors as dt
from parley.functions import text as tx
from parley.settings import PrepSettings

ROW = "source_row_index"
_FEATURE = "feature_"


def surface_features(text: Column) -> dict[str, Column]:
    return {
        "urls": dt.contains_url(text),
        "emails": dt.contains_email(text),
        "digits": dt.contains_digits(text),
        "repeated_punctuation": dt.contains_repeated_punctuation(text),
        "all_caps_tokens": dt.contains_all_caps_token(text),
    }


FEATURES = ("urls", "emails", "digits", "repeated_punctuation", "all_caps_tokens")


def feature_column(name: str) -> str:
    return _FEATURE + name


def raw_profile(text: Column, label_columns: Sequence[str] = ()) -> dict[str, Column]:
    """Narrow columns about a raw text and its label cells."""
    length = F.coalesce(text, F.lit(""))
    return {
        "raw_null": text.isNull(),
        "raw_blank": tx.is_blank(text),
        "raw_chars": F.length(length),
        "raw_words": tx.word_count(length),
        "missing_label": reduce(or_, [F.col(c).isNull() for c in label_columns], F.lit(False)),
        **{feature_column(n): c for n, c in surface_features(text).items()},
    }


def text_facts(
    raw: DataFrame,
    text_column: str,
    label: Column,
    label_info: Column,
    settings: PrepSettings = PrepSettings(),
    carry: Sequence[str] = (),
    label_columns: Sequence[str] = (),
    profile: bool = True,
) -> DataFrame:
    """One row per row of ``raw``: the raw and clean texts, their hashes and lengths, the reasons
    to remove the row and, with ``profile``, what an audit counts."""
    text = F.col(text_column)
    about = raw_profile(text, label_columns) if profile else {"raw_blank": tx.is_blank(text)}
    base = raw.select(
        F.col(ROW).cast("long").alias(ROW),
        text.alias("raw_text"),
        label.alias("binary_label"),
        label_info.alias("orig_label_info"),
        *[F.col(c) for c in carry],
        *[c.alias(name) for name, c in about.items()],
    )
    flat = tx.add_flat_text(base, "raw_text", "__flat")
    masked = tx.add_masked_text(
        flat, "__flat", "text_clean",
        replace_urls=settings.replace_urls, replace_emails=settings.replace_emails,
        url_token=settings.url_token, email_token=settings.email_token,
    )
    # Masking never empties a text, so blankness shows before it; a blank token is the exception.
    tokens_show = settings.url_token.strip() and settings.email_token.strip()
    key, clean = F.col("__flat"), F.col("text_clean")
    return (
        masked.withColumn("__key", tx.casefold(key) if settings.fold_duplicates else key)
        .withColumns({
            "text_hash_raw": tx.sha256_text(F.col("raw_text")),
            "text_hash_normalized": F.sha2("__key", 256),
            "char_len": F.length(clean),
            "word_len": tx.word_count_collapsed(clean),
            "no_label": F.col("binary_label").isNull(),
            "clean_blank": (key if tokens_show else clean) == "",
        })
        .drop("__flat", "__key")
    )
