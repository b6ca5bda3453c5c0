"""Lexicon search with a table of terms of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import lexicon as lx
from parley.functions import patterns as rx

# Lexicons up to this size become one pattern in the plan (about a megabyte).
PATTERN_TERMS = 50_000
# Longest term, in pieces, that the join looks for.
MOST_PIECES = 32
_JOINT = "\x01"


def _pieces(text: Column) -> Column:
    """Words, blanks (as one space) and single symbols of a text, folded.

    The folding is the lower case of each character's upper case where that is one character.
    """
    # Characters whose lower case differs from that of their upper case.
    folded = F.translate(F.lower(F.translate(text, "\u0130", "i")), "\u0131\u017f\u03c2\u00b5", "is\u03c3\u03bc")
    cut = F.regexp_extract_all(folded, F.lit(rf"(?sU)[{rx.WORD}]++|[{rx.WS}]++|."), F.lit(0))
    return F.transform(cut, lambda p: F.when(p.rlike(rf"(?U)\A[{rx.WS}]"), F.lit(" ")).otherwise(p))


def _is_word(piece: Column) -> Column:
    return F.coalesce(piece.rlike(rf"\A[{rx.WORD}]"), F.lit(False))


def term_keys(lexicon: DataFrame, term: str) -> DataFrame:
    """``(term, gram, pieces, symbol_first, symbol_last)``, one row per distinct term."""
    text = F.trim(F.regexp_replace(F.col(term), rx.WS_RUN, " "))
    rows = lexicon.select(text.alias("term")).filter(F.col("term") != "").distinct()
    cut = rows.withColumn("__p", _pieces(F.col("term")))
    return cut.select(
        "term", F.array_join("__p", _JOINT).alias("gram"), F.size("__p").alias("pieces"),
        (~_is_word(F.get("__p", F.lit(0)))).alias("symbol_first"),
        (~_is_word(F.element_at("__p", -1))).alias("symbol_last"),
    )


def matching_terms(df: DataFrame, key: str, text: str, lexicon: DataFrame, term: str = "term") -> DataFrame:
    """``(key, term)``: which terms occur in which rows, whatever the lexicon's size.

    Every run of as many pieces as some term has is joined with the terms by its text, so both
    sides are dealt by run; equal runs of a row are one row. Only the terms' lengths reach the
    driver, at most MOST_PIECES numbers.
    """
    keys = term_keys(lexicon, term)
    sizes = sorted(r.pieces for r in keys.select("pieces").distinct().limit(MOST_PIECES + 1).collect())
    if len(sizes) > MOST_PIECES or (sizes and sizes[-1] > MOST_PIECES):
        raise ValueError(f"a term has more than {MOST_PIECES} words and symbols")
    p = F.col("__p")

    def runs(n: int) -> Column:
        starts = F.when(F.size(p) >= n, F.sequence(F.lit(1), F.size(p) - (n - 1)))
        return F.transform(starts, lambda i: F.struct(
            F.array_join(F.slice(p, i, n), _JOINT).alias("gram"),
            _is_word(F.get(p, i - 2)).alias("after_word"),
            _is_word(F.get(p, i + (n - 1))).alias("before_word")))

    if not sizes:
        return df.select(key).limit(0).withColumn("term", F.lit(""))
    cut = df.select(F.col(key), _pieces(F.col(text)).alias("__p"))
    grams = cut.select(key, F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*map(runs, sizes)))))).alias("g"))
    found = grams.select(key, "g.*").join(keys, "gram").filter(
        ~(F.col("symbol_first") & F.col("after_word")) & ~(F.col("symbol_last") & F.col("before_word")))
    return found.select(key, "term").distinct()


def flag_terms(df: DataFrame, key: str, text: str, lexicon: DataFrame, term: str = "term",
               out: str = "has_term") -> DataFrame:
    """Add whether any term of the table occurs in ``text``; ``key`` must be unique.

    Up to PATTERN_TERMS terms the rows are searched where they are; beyond, they are joined.
    """
    rows = lexicon.select(F.col(term).alias("t")).filter("t IS NOT NULL").distinct()
    terms = [lx.normalized(r.t) for r in rows.limit(PATTERN_TERMS + 1).collect()]
    if len(terms) <= PATTERN_TERMS:
        terms = [t for t in terms if t]
        found = F.col(text).rlike(rx.any_term(terms)) if terms else F.lit(False)
        return df.withColumn(out, F.coalesce(found, F.lit(False)))
    hits = matching_terms(df, key, text, lexicon, term).select(key).distinct().withColumn(out, F.lit(True))
    return df.join(hits, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))
