r"""Regular expressions in Java syntax.

The text rules are defined on Unicode strings: ``\w`` is a letter, a number or ``_`` and
``\s`` includes the separators U+001C to U+001F. Java's own classes differ in both (and match
ASCII only unless ``U`` is set), so both are spelled out here, and word boundaries are written
as look-arounds over ``WORD``.
Quantifiers are possessive wherever backtracking cannot change the answer, which keeps
matching free of recursion and backtracking on hostile text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

WS = r"\s\x1C-\x1F"
NON_BLANK = rf"(?U)[^{WS}]"
EDGE_WS = rf"(?U)\A[{WS}]++|[{WS}]++\z"
WS_RUN = rf"(?U)[{WS}]++"

WORD = r"\p{L}\p{N}_"
WORD_START = rf"(?<![{WORD}])"
WORD_END = rf"(?![{WORD}])"
_EITHER_EDGE = rf"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"
# Of lower-case texts. Plain letters and digits come first: most characters need no look-up.
WORD_TOKEN = rf"[a-z0-9{WORD}]{{2,}}+"

URL = rf"(?iuU){WORD_START}(?:https?://|www\.)[^{WS}]++"
# An address starts at the first word boundary of a run of local-part characters. Entering a run
# only at its beginning (or where the last address ended) and keeping what lies before that
# boundary as group 1 reads each run once.
_LOCAL = "A-Z0-9._%+-"
EMAIL = (
    rf"(?iu)(?:\G|(?<![{_LOCAL}]))((?<![{WORD}])[.%+-]*+|(?<=[{WORD}])[A-Z0-9_]*+)"
    rf"[{_LOCAL}]++@[A-Z0-9.-]+\.[A-Z]{{2,}}+{WORD_END}"
)
DIGIT = r"\p{Nd}"
REPEATED_PUNCTUATION = r"([!?.,;:])\1{2}"
ALL_CAPS = rf"{WORD_START}[A-Z]{{2,}}+{WORD_END}"

REPEATED_LETTER = r"(?iu)([a-z])\1{2}"
# Letters (or nothing) from a boundary up to 4 or @; 0 and letters up to a boundary.
LEET_ANYWHERE = "[31!]"
LEET_AFTER_LETTERS = rf"(?iu){_EITHER_EDGE}[a-z]*+[4@]"
LEET_BEFORE_LETTERS = rf"(?iu)0[a-z]*+{WORD_END}"
_SYMBOLS = rf"[^a-z0-9{WS}]"
_WORD_SYMBOL = rf"[{WORD}&&[^a-z0-9]]"
# Letters, symbols, letters, symbols, letters; if a word-like symbol follows, the chain goes
# on until its first word end.
_CHAIN = (
    rf"(?iuU){WORD_START}[a-z]++{_SYMBOLS}++[a-z]++{_SYMBOLS}++[a-z]++"
    rf"(?:{_WORD_SYMBOL}{_SYMBOLS}*+[a-z]++)*+"
)
INSERTED_SYMBOL = _CHAIN + WORD_END
# The same chains, whether or not they end at a word end; group 1 is the character behind those
# that do. Listing them reads a text once, however many chains fail.
ANY_CHAIN = rf"{_CHAIN}([^{WORD}])?"


def spaced_letters(words: Iterable[str]) -> str:
    """Whole words whose letters may be separated by any symbols."""
    gap = r"[^\p{L}\p{N}]*+"
    return rf"(?iu){WORD_START}(?:" + "|".join(gap.join(word) for word in words) + f"){WORD_END}"


# The four words looked for with symbols between their letters.
SPLIT_WORDS = spaced_letters(("fuck", "shit", "bitch", "cunt"))


def term(text: str) -> str:
    """One lexicon term with flexible inner whitespace."""
    return rf"[{WS}]++".join(re.escape(part) for part in text.split(" "))


def any_term(terms: Iterable[str]) -> str:
    """Any of the terms as whole words, ignoring case.

    Terms that begin alike share their beginning, as in a trie, so that a text position is
    tried against the letters that can follow instead of against every term.
    """
    trie: dict = {}
    for text in terms:
        node = trie
        for i, part in enumerate(text.split(" ")):
            for atom in ([rf"[{WS}]++"] if i else []) + [re.escape(c.lower() if len(c.lower()) == 1 else c)
                                                       for c in part]:
                node = node.setdefault(atom, {})
        node[""] = {}
    return rf"(?iuU){WORD_START}(?:{_alternatives(trie)}){WORD_END}"


def _alternatives(node: dict) -> str:
    """The rest of a trie as a pattern; where a term ends, longer ones are tried first."""
    parts = []
    for atom, below in node.items():
        while atom and len(below) == 1 and "" not in below:  # no branch: one run
            ((more, below),) = below.items()
            atom += more
        if atom:
            rest = _alternatives({k: v for k, v in below.items() if k})
            optional = "?" if "" in below else ""
            parts.append(atom + (f"(?:{rest}){optional}" if rest else ""))
    return "|".join(parts)


# Characters that neither NFKC nor a composition with a neighbour can change, and whose case
# folding is their lower case (sharp s apart): ASCII, Latin letters, Cyrillic, Arabic letters,
# kana, common Han and Hangul syllables. Texts made of these never leave the JVM.
_ASCII = r"[\x00-\x7F]*+"
_STABLE = (
    r"[\u00BF-\u012F\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB"
    r"\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0400-\u045F\u0621-\u063A\u0641-\u064A"
    r"\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3]++"
)
STABLE_TEXT = rf"\A{_ASCII}(?:{_STABLE}{_ASCII})*+\z"
ENTITY_START = r"&[^\t\n\f <&;]"
