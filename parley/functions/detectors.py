"""Boolean detectors over text; null text never matches."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions import patterns as rx
from parley.functions.text import may_have_url



def _known(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def contains_url(text: Column) -> Column:
    return _known(may_have_url(text) & text.rlike(rx.URL))


def contains_email(text: Column) -> Column:
    return _known(text.contains("@") & text.rlike(rx.EMAIL))


def contains_digits(text: Column) -> Column:
    return _known(text.rlike(rx.DIGIT))


def contains_repeated_punctuation(text: Column) -> Column:
    return _known(text.rlike(rx.REPEATED_PUNCTUATION))


def contains_all_caps_token(text: Column) -> Column:
    return _known(text.rlike(rx.ALL_CAPS))


def contains_any_term(text: Column, terms: Iterable[str]) -> Column:
    """Whole-term, case-insensitive lexicon search."""
    return _known(text.rlike(rx.any_term(terms)))


def any_score_at_least(columns: Sequence[str], threshold: float) -> Column:
    """True if any score reaches the threshold; missing or non-numeric scores do not."""
    from parley.functions.labels import to_number

    hits = [_known(to_number(F.col(c)) >= threshold) for c in columns]
    return reduce(or_, hits, F.lit(False))


def has_inserted_symbols(text: Column) -> Column:
    """Letters, symbols, letters, symbols, letters as one word, as in ``b-a-d``."""
    ends = F.regexp_extract_all(F.concat(text, F.lit(" ")), F.lit(rx.ANY_CHAIN), F.lit(1))
    return F.exists(ends, lambda end: end != "")


def has_obfuscation(text: Column) -> Column:
    """Any of four character-level heuristics, cheapest first."""
    leet = (
        text.rlike(rx.LEET_ANYWHERE)
        | ((text.contains("4") | text.contains("@")) & text.rlike(rx.LEET_AFTER_LETTERS))
        | (text.contains("0") & text.rlike(rx.LEET_BEFORE_LETTERS))
    )
    return _known(
        leet
        | text.rlike(rx.REPEATED_LETTER)
        | has_inserted_symbols(text)
        | text.rlike(rx.SPLIT_WORDS)
    )
