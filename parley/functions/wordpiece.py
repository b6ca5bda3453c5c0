"""Subword lengths with a user-supplied WordPiece vocabulary.

Spark ships no tokenizer. An Arrow UDF counts pieces; the vocabulary reaches the workers once
per process as a broadcast variable, and becomes a trie of its characters there.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SPECIAL_TOKENS = 2
MAX_WORD = 100
# Distinct words whose pieces a worker remembers.
_MEMO = 500_000

# Words of plain ASCII texts: runs of letters and digits, and single marks.
_ASCII_WORD = re.compile(r"[a-z0-9]+|[!-/:-@\[-`{-~]")
_ASCII_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


class PieceTrie:
    """A vocabulary by its characters; pieces that continue a word begin with ``##``."""

    def __init__(self, vocabulary: Iterable[str]) -> None:
        self.first: dict = {}
        self.later: dict = {}
        for piece in vocabulary:
            node, rest = (self.later, piece[2:]) if piece.startswith("##") else (self.first, piece)
            for ch in rest:
                node = node.setdefault(ch, {})
            node[None] = True

    def count(self, word: str) -> int:
        """Pieces of a word, the longest first; 1 if the word cannot be made of pieces."""
        if len(word) > MAX_WORD:
            return 1
        node, at, total = self.first, 0, 0
        while at < len(word):
            end, i = 0, at
            while i < len(word) and (node := node.get(word[i])) is not None:
                i += 1
                if None in node:
                    end = i
            if not end:
                return 1
            node, at, total = self.later, end, total + 1
        return total


class _Counts(dict):
    def __init__(self, trie: PieceTrie) -> None:
        super().__init__()
        self.trie = trie

    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMO:
            self.clear()
        self[word] = total = self.trie.count(word)
        return total


class _Basic(dict):
    """What a character of decomposed text becomes: nothing, itself, or itself between blanks."""

    def __missing__(self, code: int) -> str:
        ch, kind = chr(code), unicodedata.category(chr(code))
        han = (0x4E00 <= code <= 0x9FFF or 0x3400 <= code <= 0x4DBF or 0xF900 <= code <= 0xFAFF
               or 0x20000 <= code <= 0x2FA1F)
        ascii_mark = 32 < code < 127 and not ch.isalnum()
        if kind == "Mn" or code == 0xFFFD or (kind[0] == "C" and ch not in "\t\n\r"):
            value = ""
        elif ascii_mark or han or kind[0] == "P":
            value = f" {ch} "
        else:
            value = ch
        self[code] = value
        return value


class PieceCounter:
    """Words and piece counts of texts, in a worker."""

    def __init__(self, vocabulary: Iterable[str]) -> None:
        self.counts, self.basic = _Counts(PieceTrie(vocabulary)), _Basic()

    def words(self, text: str) -> list[str]:
        """Lower-cased words without accents; marks and Han characters stand alone."""
        if text.isascii():
            text = text.lower()
            if _ASCII_CONTROL.search(text):
                text = _ASCII_CONTROL.sub("", text)
            return _ASCII_WORD.findall(text)
        return unicodedata.normalize("NFD", text.lower()).translate(self.basic).split()

    def length(self, text: str | None) -> int:
        return SPECIAL_TOKENS + sum(map(self.counts.__getitem__, self.words(text or "")))


def token_length_udf(spark: SparkSession, vocabulary: Iterable[str]):
    """A column function giving the pieces of a text plus the two special tokens.

    Lower-cases, strips accents, splits at whitespace, punctuation and Han characters, then
    matches the longest known piece first; a word with no match counts as one unknown piece.
    Null has the special tokens alone.
    """
    shared = spark.sparkContext.broadcast(frozenset(vocabulary))

    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = PieceCounter(shared.value)
        for texts in batches:
            yield pd.Series([counter.length(t) for t in texts], texts.index, "int32")

    udf = F.pandas_udf(pieces, "int")

    def token_length(text: Column) -> Column:
        return udf(text)

    return token_length
