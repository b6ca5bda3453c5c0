"""Source audit: brute force over small texts, edge cases, and the tree against plain sums."""

import re
from collections import Counter

import pytest

from parley.llm import source_divergence
from parley.llm.source_divergence import audit_sources

SCHEMA = "doc_id long, text string, lang string, source string, p long, value string"


def brute_force(docs, min_docs, top):
    docs = [(t or "", g or "", s or "") for _, t, g, s, *_ in docs]
    terms = [[w.encode().lower().decode() for w in re.findall(r"[A-Za-z\u0080-\U0010ffff]+", t)]
             for t, _, _ in docs]
    out = []
    for lang in {g for _, g, _ in docs}:
        seen = Counter(w for ws, (_, g, _) in zip(terms, docs) if g == lang for w in set(ws))
        kept = {w for w, n in seen.items() if n >= min_docs}
        counts = {s: Counter() for _, g, s in docs if g == lang}
        for ws, (_, g, s) in zip(terms, docs):
            if g == lang:
                counts[s].update(w for w in ws if w in kept)
        whole = sum(counts.values(), Counter())

        def share(c, w):
            return 1 + (10**9 * (c[w] + 5)) // (c.total() + 5 * len(kept))

        for s, c in counts.items():
            pairs = [(-sum(abs(share(c, w) - share(d, w)) for w in kept), o)
                     for o, d in counts.items() if o != s]
            over = [(share(whole, w) - share(c, w), w) for w in c if share(c, w) > share(whole, w)]
            for part, rows in (("pair", pairs), ("term", over)):
                rows.sort(key=lambda r: (r[0], r[1].encode()))
                rows = rows[: top if part == "term" else None]
                out += [(lang, s, part, i, -v, k) for k, (v, i) in enumerate(rows, 1)]
    return sorted(out)


def documents():
    words = "the of ﬁsh Straße ÀB été x y zz Zz ZZ don't a-b 日本".split()
    docs = []
    for i in range(160):
        text = " ".join(words[(i * k * k + k) % len(words)] for k in range(i % 17))
        docs.append((i, text, ("en", "de", None, "")[i % 4], f"s{i % 9}" if i % 11 else None, i, "c"))
    docs += [docs[30]] * 5 + [(None, None, "fr", "only", None, None), (7, "", "it", "a", 1, "d"),
                             (7, None, "it", "b", 1, "d"), (8, "?! 123", None, None, 2, "e")]
    return docs


def rows_of(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("min_docs, top", [(1, 50), (5, 3), (10_000, 50)])
def test_against_brute_force(spark, min_docs, top):
    docs = documents()
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    mine = rows_of(audit_sources(df, "text", "lang", "source", min_docs, top))
    assert mine == brute_force(docs, min_docs, top)


def test_small_buffers_give_the_same_rows(spark, monkeypatch):
    docs = documents() + [(1, "word " * 3000 + "été" * 900, "en", "s1", 0, "")]
    for name, size in (("HELD_COUNTS", 10), ("PART_BYTES", 64), ("HELD_PAIRS", 4)):
        monkeypatch.setattr(source_divergence, name, size)
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    assert rows_of(audit_sources(df, "text", "lang", "source", 2)) == brute_force(docs, 2, 50)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert audit_sources(df, "text", "lang", "source").count() == 0


def test_counts_beyond_64_bits_of_product(spark):
    """Shares stay exact where a billion times the count exceeds a long."""
    df = spark.createDataFrame([(9_000_000_000_000_000, 9_100_000_000_000_000, 1000)],
                               "n long, total long, terms long")
    share = df.select(source_divergence._share("n", "total", "terms")).first()[0]
    assert share == 1 + 10**9 * (9_000_000_000_000_000 + 5) // (9_100_000_000_000_000 + 5000)


def test_shared_paths_are_corrected_once(monkeypatch):
    """Equal path beginnings make one node each, whatever their multiplicity."""
    import numpy as np

    tree, added = source_divergence.PathTree(), []
    add = tree._add
    monkeypatch.setattr(tree, "_add", lambda d: (added.append(d), add(d)))
    one = np.array([1, 2, 3])
    for last, times in ((3, 4), (3, 2), (5, 1)):
        n = np.array([1, 2, last])
        list(tree.insert("en", ["a", "b", "c"], n, 10 * n, one, times))
    rows = [r for batch in tree.close() for r in batch.to_pylist()]
    assert sorted(added) == [1, 2, 2]
    got = {(r["source"], r["item"]): r["value"] for r in rows}
    both = lambda p, z, q, y: abs(p - q) - abs(z - q) - abs(p - y) + abs(z - y)
    want = 6 * both(30, 3, 20, 2) + both(50, 3, 20, 2)
    assert got["c", "b"] == got["b", "c"] == want
    assert got.get(("b", "a"), 0) == 7 * both(20, 2, 10, 1)
