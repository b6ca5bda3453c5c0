"""Toxicity: planted insults, held-out accuracy, scores against plain loops, edge cases."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import toxicity as tox

WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ivy juniper kauri larch".split()
INSULTS = ("grobmul", "spitling")
SCHEMA = "doc_id long, text string, lang string"


def documents(n=1200):
    """Sentences of tree names; every sixth document has one sentence with an insult."""
    random, docs, labels = np.random.default_rng(2), [], []
    for i in range(n):
        sentences = [" ".join(random.choice(WORDS, random.integers(3, 9)))
                     for _ in range(random.integers(1, 12))]
        if bad := i % 6 == 0:
            at = random.integers(len(sentences))
            sentences[at] += f" {INSULTS[i % 4 // 2]}{random.choice(['', 'ach', 'est'])} elm"
        docs.append((i, ". ".join(sentences) + ".", "x"))
        labels.append((i, int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = documents()
    df = spark.createDataFrame(docs, SCHEMA).repartition(4).cache()
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    return df, known, tox.fit(df, "doc_id", "text", known)


def test_held_out_documents(spark, fitted):
    df, known, model = fitted
    rows = tox.score_documents(df, "doc_id", "text", model).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(1200) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r.predicted == (r.doc_id % 6 == 0) == (r.score >= 0.5) for r in held)


def test_offending_sentences_are_located(spark, fitted):
    df, _, model = fitted
    texts = {r.doc_id: r.text for r in df.collect()}
    found = tox.offending_sentences(df, "doc_id", "text", model).collect()
    assert {int(r.id) for r in found} == {i for i in texts if i % 6 == 0}
    for r in found:
        assert texts[int(r.id)][r.start : r.end] == r.text
        assert any(x in r.text for x in INSULTS)
        assert re.split(r"(?<=\.) ", texts[int(r.id)])[r.sentence] == r.text


def test_labels_of_held_out_rows_are_not_read(spark, fitted):
    df, known, model = fitted
    turned = known.withColumn("toxic", F.when(tox.held_out("doc_id"), 1 - F.col("toxic"))
                              .otherwise(F.col("toxic")))
    again = tox.fit(df, "doc_id", "text", turned)
    assert again.bias == model.bias and np.array_equal(again.weights, model.weights)


@pytest.mark.parametrize("part", [1 << 20, 1, 7])
def test_scores_by_plain_loop(monkeypatch, fitted, part):
    monkeypatch.setattr(tox, "PART_CHARS", part)
    model = fitted[2]
    weights = {h: model.weights[i] for h, i in model.chosen.items()}
    scorer = tox.Scorer(model)
    texts = [t for _, t, _ in documents(40)[0]] + [
        "", "...", "\n\n", "elm", ". grobmul. elm\n? Grobmul birch", "spitlingest" * 9 + "。x",
        "grobmul " * 50]
    for text in texts:
        harmless = 1.0
        for sentence in re.split(r"[.!?\n。！？]", text):
            words = re.findall(r"\w+", sentence)
            if words:
                z = model.bias + sum(weights.get(f, 0) for w in words for f in tox.features(w))
                harmless *= 1 - 1 / (1 + math.exp(-z))
        assert model.document(scorer.harm(text)) == pytest.approx(1 - harmless, abs=1e-9)
        one = 1.0
        for _, _, p in scorer.sentences(text):
            one *= 1 - p
        assert one == pytest.approx(harmless, abs=1e-9)
        assert tox.document_features(text, tox.Memo(tox.features)) == {
            f for w in re.findall(r"\w+", text) for f in tox.features(w)}


def test_gradient_lowers_the_documents_loss():
    """The loss after fitting is below that of any single weight moved a little."""
    random = np.random.default_rng(0)
    model = tox.Model([1, 2, 3])
    toxic = random.random(200) < 0.3
    doc_of = np.arange(200).repeat(2)
    feature = np.where(toxic[doc_of] & (random.random(400) < 0.7), 0, random.integers(1, 3, 400))
    sentences = np.full(200, 5.0)
    model.fit(toxic, sentences, doc_of, np.arange(400), feature)

    def loss(weights, bias):
        z = bias + weights[feature]
        harm = 3 * np.log1p(np.exp(bias)) + np.bincount(doc_of, np.log1p(np.exp(z)))
        return (np.where(toxic, -np.log(-np.expm1(-harm)), harm).mean()
                + tox.PENALTY / 2 * (weights**2).sum())

    least = loss(model.weights, model.bias)
    for k in range(3):
        for step in (-0.3, 0.3):
            moved = model.weights.copy()
            moved[k] += step
            assert loss(moved, model.bias) >= least - 1e-3  # flat near the least


def test_edge_cases(spark, fitted):
    _, known, model = fitted
    rows = [(1, None, "a"), (2, "", "a"), (3, "...", "a"), (4, "elm grobmul", "a"),
            (4, "elm grobmul", "a"), (None, "elm grobmul", None), (None, None, None),
            (6, "elm. " * 300_000 + "grobmul", "long")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("own")).withColumn(
        "Predicted", F.lit(7.5)).withColumn("__text", F.lit("own"))
    out = tox.score_documents(df, "doc_id", "text", model)
    assert out.columns == ["doc_id", "text", "lang", "__text", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == 8
    assert all(r.score == 0 and r.predicted == 0 for r in got if not r.text or r.text == "...")
    assert all(r.predicted == 1 for r in got if r.text == "elm grobmul" or r.doc_id == 6)
    assert [r.held_out for r in got if r.doc_id is None] == [False, False]
    empty = spark.createDataFrame([], SCHEMA)
    assert tox.detect_toxicity(empty, "doc_id", "text", known).count() == 0
    for label in (0, 1):
        same = known.withColumn("toxic", F.lit(label))
        none = tox.detect_toxicity(df.drop("score", "Predicted"), "doc_id", "text", same).collect()
        assert {r.score for r in none} == {0.0}
    nothing = tox.offending_sentences(df, "doc_id", "text", None)
    assert nothing.count() == 0


def test_sample_has_one_row_per_id_and_majority_labels(spark):
    docs = spark.createDataFrame([(7, "b", ""), (7, "a", ""), (1, None, ""), (2, "c", "")], SCHEMA)
    labels = spark.createDataFrame([(7, 1), (7, 0), (2, 0), (2, 0), (2, 1), (None, 1), (3, None)],
                                   "doc_id long, toxic int")
    rows = tox.labelled_sample(docs, "doc_id", "text", labels, "toxic").collect()
    want = {("7", True, "a"), ("2", False, "c")}
    assert {(r.id, r.toxic, r.text) for r in rows} == {
        w for w in want if zlib.crc32(w[0].encode()) % 5}


def test_query_on_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = tox.op13_toxicity(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    wrong = sum(r.predicted != r.toxic for r in rows)
    assert len(rows) > 500 and wrong <= 0.02 * len(rows)
