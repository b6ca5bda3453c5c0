"""The pipeline's stages against plain versions of them, and edge cases."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import packing
from test_operators import EDGE, SCHEMA


def plain_lines(rows):
    """Texts by id without the lines on over 5 % of their source's distinct texts, two at least."""
    pages = defaultdict(set)
    for r in rows:
        pages[r.source].add(r.text)
    on = defaultdict(int)
    for source, texts in pages.items():
        for text in texts:
            for line in {x for x in (text or "").split("\n") if x.encode().split()}:
                on[source, line] += 1

    def kept(r):
        if r.text is None:
            return None
        return "\n".join(x for x in r.text.split("\n")
                         if not (on[r.source, x] >= 2 and on[r.source, x] / len(pages[r.source]) > 0.05))

    return {r.doc_id: kept(r) for r in rows}


def plain_copies(rows):
    """Ids that are the smallest of their group of near copies, or have no words."""
    sets = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        words = (r.text or "").encode().lower().split()
        k = min(5, max(1, len(words)))
        sets[r.doc_id] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()
    label = {i: i for i in sets}
    ids = list(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return {i for i in ids if label[i] == i}


def plain_clean(rows, items):
    def words(text):
        return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())

    windows = {tuple(w[i : i + min(10, len(w))]) for w in map(words, items) if w for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}

    def hit(text):
        own = words(text)
        return any(tuple(own[i : i + k]) in windows for k in sizes for i in range(len(own) - k + 1))

    return {r.doc_id for r in rows if not hit(r.text)}


def test_stages_by_plain_versions(spark, sf):
    """Every stage on what the plain version of its predecessor kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = corpus_pipeline.quality_classifier(spark, docs, sf).collect()
    from parley.llm.classifier import classify

    scored = classify(docs, "doc_id", "text", spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert {r.doc_id for r in first} == {r.doc_id for r in scored if r.score >= 0.7} != set()
    rows = spark.createDataFrame(first, SCHEMA)
    second = corpus_pipeline.line_dedup(spark, rows, sf).collect()
    assert {r.doc_id: r.text for r in second} == plain_lines(first)
    assert all(r.n_chars == len(r.text) for r in second if r.text is not None)
    third = corpus_pipeline.jaccard_join(spark, spark.createDataFrame(second, SCHEMA), sf).collect()
    assert {r.doc_id for r in third} == plain_copies(second)
    fourth = corpus_pipeline.decontamination(spark, spark.createDataFrame(third, SCHEMA), sf).collect()
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r.doc_id for r in fourth} == plain_clean(third, items) < {r.doc_id for r in third}
    pieces = corpus_pipeline.packing(spark, spark.createDataFrame(fourth, SCHEMA), sf).collect()
    tokens = packing.Tokens(packing.tokenizer_path())
    ids = {r.doc_id: np.append(tokens.of(r.text), 2).astype("<u4") for r in fourth}
    held = defaultdict(int)
    for r in pieces:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and len(part) == r.length
        held[r.doc_id] += r.length
    assert held == {d: len(x) for d, x in ids.items()}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_edge_cases(spark, sf, name, stage):
    docs = spark.createDataFrame([r for r in EDGE if r[0] is not None], SCHEMA)
    docs = docs.withColumn("score", F.lit("own")).withColumn("__key", F.lit("own"))
    out = stage(spark, docs, sf)
    rows = out.collect()
    if name == "packing":
        assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5}
    else:
        assert tuple(out.columns) == corpus_pipeline.COLUMNS
    if name == "line_dedup":
        assert sorted(r.doc_id for r in rows) == [1, 2, 3, 3, 4, 5]
        assert all((r.text is None) == (r.doc_id == 2) == (r.n_chars is None) for r in rows)
    if name == "jaccard_join":
        assert sorted(r.doc_id for r in rows) == [1, 2, 3, 4, 5]
    if name == "decontamination":
        assert len(rows) == 6
    empty = spark.createDataFrame([], SCHEMA)
    assert stage(spark, empty, sf).count() == 0
