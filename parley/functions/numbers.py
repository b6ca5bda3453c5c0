"""Decimal rounding of doubles by their exact binary value, ties to even.

Spark rounds the shortest decimal rendering of a double, so 0.15 counts as a tie although the
stored value lies below it. The reports round the stored value. The product with a scale is
split into two doubles that hold it exactly, which decides every case, ties included.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLITTER = float(2**27 + 1)


def scaled_round(value: Column, digits: int) -> Column:
    """``value * 10**digits`` rounded to a whole number (as a double)."""
    twice = float(2 * 10**digits)
    big = value * _SPLITTER
    high = big - (big - value)
    low = value - high
    a, b = high * twice, low * twice
    total = a + b
    back = total - a
    error = (a - (total - back)) + (b - back)
    half = total / 2.0
    tie = (total == F.rint(total)) & (half != F.rint(half))
    return (
        F.when(tie & (error > 0), F.ceil(half).cast("double"))
        .when(tie & (error < 0), F.floor(half).cast("double"))
        .otherwise(F.rint(half))
    )


def round_exact(value: Column, digits: int) -> Column:
    return scaled_round(value, digits) / float(10**digits)


def format_percent(fraction: Column) -> Column:
    """``0.1234`` as ``12.3%``."""
    tenths = scaled_round(fraction * 100.0, 1).cast("long")
    sign = F.when(tenths < 0, "-").otherwise("")
    size = F.abs(tenths)
    whole = F.floor(size / 10).cast("string")
    return F.concat(sign, whole, F.lit("."), (size % 10).cast("string"), F.lit("%"))


def plain_number(value: Column, keep_zero: bool = False, places: int = 6) -> Column:
    """Decimal text of a double below ten million, without an exponent where that is readable.

    Numbers with up to ``places - 1`` zeros after the point are written out; smaller ones get
    an exponent (two digits with ``keep_zero``, which also keeps a final ``.0``).
    """
    text = value.cast("string")
    small = r"^(-?)(\d)\.(\d+)E-(\d+)$"

    def part(i):
        return F.regexp_extract(text, small, i)

    exponent = part(4).try_cast("int")
    fraction = F.regexp_replace(part(3), r"\A0\z", "")
    zeros = F.lpad(F.lit(""), exponent - 1, "0")
    plain = F.concat(part(1), F.lit("0."), zeros, part(2), fraction)
    shown = F.lpad(part(4), 2, "0") if keep_zero else part(4)
    dot = F.when(fraction == "", "").otherwise(".")
    scientific = F.concat(part(1), part(2), dot, fraction, F.lit("e-"), shown)
    return (
        F.when(~text.rlike(small), text if keep_zero else F.regexp_replace(text, r"\.0\z", ""))
        .when(exponent <= places, plain)
        .otherwise(scientific)
    )
