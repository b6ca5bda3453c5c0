"""Large lexicons: the same hits as one regular expression per term."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.functions import cues as cu
from parley.functions import lexicon as lx
from parley.functions import patterns as rx
from parley.operators import lexicon as op
from parley.operators.triage import build_review_items
from parley.settings import CUE_TERMS, CueTerm

PARTS = ["ab", "abc", "a", "bad", "Straße", "été", "日本", "x1", "_", "-", "!", "*", "'", "i", "S", "Σος", "ſt"]


def terms_and_texts(n_terms=5000, n_texts=150, seed=4):
    random = np.random.default_rng(seed)

    def some(k):
        return "".join(random.choice(PARTS) + random.choice(["", "", " ", " ", "  ", "\n"])
                       for _ in range(random.integers(1, k)))

    terms = sorted({lx.normalized(some(5)) for _ in range(3 * n_terms)} - {""})
    terms = [terms[i] for i in random.permutation(len(terms))[:n_terms]]
    texts = [None, "", " ", "İ ı ſ ς µ K"]
    for _ in range(n_texts):
        texts.append("".join(
            (random.choice(terms) if random.random() < 0.3 else some(4)).replace(" ", random.choice([" ", "\t "]))
            + random.choice(["", " ", ".", "́"]) for _ in range(12)))
    return terms, [t if t is None or i % 3 else t.upper() for i, t in enumerate(texts)]


def by_regex(terms, text):
    out = []
    for k, term in enumerate(terms):
        body = r"\s+".join(re.escape(p) for p in term.split(" "))
        out += [(k, *m.span()) for m in re.finditer(rf"(?<!\w){body}(?!\w)", text or "", re.I)]
    return sorted(out, key=lambda h: (h[1], h[2], h[0]))


@pytest.fixture(scope="module")
def large(spark):
    terms, texts = terms_and_texts()
    assert len(terms) == 5000
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4).cache()
    return terms, df, {i: by_regex(terms, t) for i, t in enumerate(texts)}


def test_every_hit_of_5000_terms(large):
    terms, df, want = large
    assert sum(map(len, want.values())) > 1000
    for row in lx.add_term_hits(df, "text", terms).collect():
        assert [(h["term"], h["start"], h["end"]) for h in row["hits"]] == want[row["id"]], row["text"]


def test_flag_by_one_pattern(large):
    terms, df, want = large
    got = {r.id: r.flag for r in df.select("id", F.coalesce(F.col("text").rlike(rx.any_term(terms)), F.lit(False)).alias("flag")).collect()}
    assert got == {i: bool(hits) for i, hits in want.items()}


def test_joined_lexicon_finds_the_same_terms(spark, large, monkeypatch):
    terms, df, want = large
    table = spark.createDataFrame([(t,) for t in terms + terms[:9] + [" ", None]], "term string")
    pairs = {(r.id, r.term) for r in op.matching_terms(df, "id", "text", table).collect()}
    # Equal terms but for case are two terms with the same hits.
    assert pairs == {(i, terms[h[0]]) for i, hits in want.items() for h in hits}
    for size in (50_000, 10):
        monkeypatch.setattr(op, "PATTERN_TERMS", size)
        got = {r.id: r.has_term for r in op.flag_terms(df, "id", "text", table).collect()}
        assert got == {i: bool(hits) for i, hits in want.items()}
    none = spark.createDataFrame([], "term string")
    assert not any(r.has_term for r in op.flag_terms(df, "id", "text", none).collect())
    assert op.matching_terms(df, "id", "text", none).isEmpty()


def test_cues_of_many_terms_equal_the_expressions(spark, large, monkeypatch):
    _, df, _ = large
    texts = ["Shut  up you idiot, IDIOT! 😀 moron", "idiotic", "édumb hate\nyou", None, "", "go die go die loser"]
    rows = df.limit(20).select("text").unionByName(spark.createDataFrame([(t,) for t in texts], "text string"))
    few = cu.add_cues(rows, "text", "c").collect()
    monkeypatch.setattr(cu, "EXPRESSION_TERMS", 3)
    many = cu.add_cues(rows, "text", "c").collect()
    assert few == many and any(r.c for r in few)
    lexicon = CUE_TERMS + tuple(CueTerm(f"term{i}", "x", "Low") for i in range(3000))
    items = build_review_items(rows.select(F.col("text").alias("original_text")), lexicon)
    assert Counter(str(r.detected_cues) for r in items.collect()) == Counter(str(r.c) for r in few)


def test_size_limits(spark, monkeypatch):
    monkeypatch.setattr(lx, "MOST_TERMS", 2)
    df = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(ValueError, match="too many"):
        lx.add_term_hits(df, "text", ["a", "b", "c"])
    table = spark.createDataFrame([("a " * 40,)], "term string")
    with pytest.raises(ValueError, match="more than 32"):
        op.matching_terms(df.withColumn("id", F.lit(1)), "id", "text", table)


def test_long_texts_cost_their_length(large):
    import time

    trie = lx.TermTrie(large[0])
    started = time.perf_counter()
    assert trie.hits("word, " * 200_000) == []
    assert time.perf_counter() - started < 10
