"""Spelling variants: brute force over pairs, edge cases, and the parts of the search."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from parley.llm import spelling_variants as sv

SCHEMA = "doc_id long, text string, word string, n long"


def brute_force(docs):
    counts = Counter()
    for doc_id, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {w: [v for v in words if near(w, v)] for w in words}
    forms = {}
    for w, others in found.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 10 * words[w]:
            forms[w] = best

    def root(w):
        while w in forms:
            w = forms[w]
        return w

    return sorted((w, forms.get(w) or "", root(w), n, len(found[w]), words.get(forms.get(w), 0))
                  for w, n in words.items())


def edited(random, word):
    at, letter = random.integers(len(word)), "abcdeßÿ×"[random.integers(8)]
    return [word[:at] + word[at + 1 :], word[:at] + letter + word[at:],
            word[:at] + letter + word[at + 1 :]][random.integers(3)]


def documents(seed=3):
    random = np.random.default_rng(seed)
    base = ["".join(random.choice(list("abcdeé"), random.integers(6, 10))) for _ in range(60)]
    base += [w[::-1] for w in base[:20]] + ["aaaaaaa" + "a" * k for k in range(300)]
    words = []
    for w in base:
        # Chains of forms: each step tenfold rarer.
        for times in (300, 25, 2)[: 1 + random.integers(3)]:
            words += [w] * int(times)
            w = edited(random, w)
        words += [edited(random, w) for _ in range(6)] * 2
    words = [words[i] for i in random.permutation(len(words))]
    joins = [" ", "\n", "日", "1", "-", "Ā"]
    docs = [(i, "".join(w + joins[(i + k) % 6] for k, w in enumerate(words[i::70])), "x", i)
            for i in range(70)]
    docs += [(5, "LONGWORD longword ÀÉÎÕÜß× ÀÉÎÕÜß× àéîõüß÷ àéîõüß÷", None, None)] * 2
    docs += [(None, "nulled nullidword nullidword", "", 0), (None, None, None, None), (9, "", "", 1)]
    return docs + [(11, "z" * 5000 + " " + "z" * 5001 + " " + "z" * 5000 + " " + "z" * 5001, "", 2)]


def rows_of(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


@pytest.mark.parametrize("leaf_words, sample_words, block", [(4000, 200_000, 8192), (20, 200_000, 7),
                                                           (1, 100, 8192)])
def test_against_brute_force(spark, monkeypatch, leaf_words, sample_words, block):
    monkeypatch.setattr(sv, "BLOCK", block)
    monkeypatch.setattr(sv, "LEAST_SAMPLE", 2)
    monkeypatch.setattr(sv, "HELD_WORDS", 200)
    docs = documents()
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    mine = rows_of(sv.spelling_variants(df, "doc_id", "text", 10, leaf_words, sample_words))
    want = brute_force(docs)
    assert mine == want
    assert any(form and root != form for _, form, root, *_ in want)  # a chain


def test_long_texts_are_read_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sv, "PART_BYTES", 50)
    docs = documents(4)
    df = spark.createDataFrame(docs, SCHEMA)
    assert rows_of(sv.spelling_variants(df, "doc_id", "text")) == brute_force(docs)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert sv.spelling_variants(df, "doc_id", "text").count() == 0


def test_range_search_loses_no_neighbour():
    """Every word one edit away lies in a reached leaf, whatever the leaf size."""
    random = np.random.default_rng(1)
    words = sorted({random.choice(list(b"abc\xe9"), 9).astype(np.uint8).tobytes() for _ in range(3000)})
    points = sv.letter_counts(sv.letters(words))
    tree = sv.Tree(points, 5)
    home = tree.leaves_of(points)
    assert all(set(own) == set(np.flatnonzero(home == leaf))
               for leaf, own in enumerate(tree.members))
    reached = {(int(i), leaf) for leaf, who in tree.reached(points, False) for i in who}
    for i in range(0, len(words), 37):
        for j, other in enumerate(words):
            if sum(a != b for a, b in zip(words[i], other)) == 1:
                assert (i, int(home[j])) in reached
    assert len(reached) < 0.5 * len(words) * len(tree)  # and it prunes


def test_one_edit():
    rows = lambda *words: sv.letters([w.encode("latin-1") for w in words])
    assert sv.one_edit(rows("abc", "abc", "abc"), rows("abd", "abc", "cba")).tolist() == [
        True, False, False]
    assert sv.one_edit(rows("xabc", "axbc", "abcx", "abxy"), rows("abc", "abc", "abc", "abc")
                       ).tolist() == [True, True, True, False]
