"""Label harmonisation."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.numbers import plain_number


def to_number(value: Column) -> Column:
    """Numeric value or null; NaN counts as missing."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def multilabel_to_binary(columns: Sequence[str]) -> Column:
    """1 if any label column is positive; missing labels are not positive."""
    numbers = [to_number(F.col(c)) for c in columns]
    best = F.greatest(*numbers) if len(numbers) > 1 else numbers[0]
    return F.coalesce(best > 0, F.lit(False)).cast("int")


def score_to_binary(column: str, threshold: float) -> Column:
    """1 if the score reaches the threshold; a missing score does not."""
    return F.coalesce(to_number(F.col(column)) >= threshold, F.lit(False)).cast("int")


def all_missing(columns: Sequence[str]) -> Column:
    return F.coalesce(*[to_number(F.col(c)) for c in columns]).isNull()


def multilabel_json(columns: Sequence[str]) -> Column:
    """Compact JSON of the original labels with sorted keys; nulls are kept."""
    fields = [to_number(F.col(c)).cast("int").alias(c) for c in sorted(columns)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def score_json(column: str) -> Column:
    """Compact JSON of the original score; a missing score is ``null``."""
    number = plain_number(to_number(F.col(column)), keep_zero=True, places=4)
    name = json.dumps(column, ensure_ascii=False)
    return F.concat(F.lit("{" + name + ":"), F.coalesce(number, F.lit("null")), F.lit("}"))
