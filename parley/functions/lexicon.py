"""Lexicons of thousands of terms: every hit of every term, in one pass over a text.

A term is a path of pieces (words, blanks, single symbols) in a trie. A text is cut into the
same pieces, and each piece is tried against the trie, so a pass costs the text's length and
not the lexicon's. Hits are those of :func:`parley.functions.patterns.any_term` with one term.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import patterns as rx

# Terms that are sent to every worker (some 100 MB); larger lexicons are joined instead, see
# ``parley.operators.lexicon``.
MOST_TERMS = 200_000
HITS_TYPE = "array<struct<term:int,start:int,end:int>>"

_PIECE = re.compile(r"\w+|\s+|.", re.S)


def normalized(term: str) -> str:
    """A term with single blanks inside and none at its ends."""
    return " ".join(term.split())


class _Fold(dict):
    """A character as a case-insensitive comparison sees it."""

    def __missing__(self, code: int) -> int:
        upper = chr(code).upper()
        lower = (upper if len(upper) == 1 else chr(code)).lower()
        self[code] = folded = ord(lower) if len(lower) == 1 else ord(lower[0])
        return folded


class TermTrie:
    """A lexicon; terms are known by their place in it."""

    def __init__(self, terms: Iterable[str]) -> None:
        self.fold = _Fold()
        self.root: dict = {}
        for number, term in enumerate(terms):
            node = self.root
            for _, piece in self._pieces(normalized(term)):
                node = node.setdefault(piece, {})
            if node is not self.root:
                node.setdefault(None, []).append(number)

    def _pieces(self, text: str) -> Iterator[tuple[int, str]]:
        for match in _PIECE.finditer(text):
            piece = match.group()
            yield match.start(), " " if piece.isspace() else (
                piece.lower() if piece.isascii() else piece.translate(self.fold))

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """``(term, start, end)`` by start and end; hits of one term do not overlap."""
        starts, pieces = zip(*self._pieces(text)) if text else ((), ())
        ends = (*starts[1:], len(text))
        word = [p[0] == "_" or p[0].isalnum() for p in pieces]
        found, last_end = [], {}
        for i, piece in enumerate(pieces):
            node, j = self.root.get(piece), i
            # Pieces that are words end where words end; symbols must not touch a word.
            if node is None or (i and not word[i] and word[i - 1]):
                continue
            while node is not None:
                j += 1
                if None in node and not (j < len(pieces) and not word[j - 1] and word[j]):
                    for term in node[None]:
                        if starts[i] >= last_end.get(term, 0):
                            found.append((term, starts[i], ends[j - 1]))
                            last_end[term] = ends[j - 1]
                node = node.get(pieces[j]) if j < len(pieces) else None
        return sorted(found, key=lambda h: (h[1], h[2], h[0]))


def check_size(terms: tuple[str, ...]) -> None:
    if len(terms) > MOST_TERMS:
        raise ValueError(
            f"{len(terms)} terms are too many to send to every worker; "
            "use parley.operators.lexicon with a table of terms")


def term_hits(spark: SparkSession, text: str, terms: Iterable[str]) -> Column:
    """The hits of all terms in the column ``text``, empty for a null text.

    One pattern over the whole lexicon keeps the texts without any hit in the JVM.
    """
    terms = tuple(terms)
    check_size(terms)
    if not terms:
        return F.array().cast(HITS_TYPE)
    shared = spark.sparkContext.broadcast(terms)

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = TermTrie(shared.value)
        for texts in batches:
            yield texts.map(
                lambda t: [{"term": a, "start": b, "end": c} for a, b, c in trie.hits(t)],
                na_action="ignore")

    # "Nondeterministic" keeps the optimiser from evaluating it again in pushed-down filters.
    udf = F.pandas_udf(find, HITS_TYPE).asNondeterministic()
    pattern = rx.any_term(normalized(t) for t in terms if t.strip())
    return F.coalesce(udf(F.when(F.col(text).rlike(pattern), F.col(text))), F.array().cast(HITS_TYPE))


def add_term_hits(df: DataFrame, text: str, terms: Iterable[str], out: str = "hits") -> DataFrame:
    return df.withColumn(out, term_hits(df.sparkSession, text, terms))
