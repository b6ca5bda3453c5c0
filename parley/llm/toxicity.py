"""Toxic documents and the sentences that make them so, learned from document labels alone.

A document is a bag of sentences, and nobody has labelled those. Each sentence has a logistic
score over its words and word beginnings; a document is toxic unless every sentence is harmless
(noisy-or): ``1 - prod(1 - p)``. Fitting the documents' labels through that product leaves the
blame with the sentences that toxic documents have and others lack, so the same scores find the
offending sentences afterwards.

Fitting reads a bounded sample of labelled rows. Tasks count in how many sampled documents, and
toxic ones, each feature occurs; the features that toxic documents have significantly more
often, up to a bound, are the model's. Scoring reads every text whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import MEMO_WORDS, crc32_of_id, received, ship, stored, table, unused

# Bound on labelled rows that the model is fitted on, one per id, and on their length.
SAMPLE_ROWS = 30_000
SAMPLE_CHARS = 200_000
# Bound on the model's features. A feature needs so many documents, so many standard deviations
# more toxic ones than chance gives it, and so many times the usual share of toxic ones: common
# words that lean a little to one side would fill the sentences and say nothing.
MAX_FEATURES = 6_000
LEAST_DOCS = 4
LEAST_DEVIATIONS = 3.0
LEAST_LIFT = 2.0
# Word beginnings of so many characters are features beside the whole word.
BEGINNINGS = (3, 4, 5, 6)
THRESHOLD = 0.5
STEPS = 400
PENALTY = 2e-5
SEED = 13
# Characters of a long text that are read at a time; longer words are not remembered.
PART_CHARS = 1 << 20
MEMO_CHARS = 64

_TOKEN = re.compile(r"\w+|[.!?\n。！？]")
_ENDS = frozenset(".!?\n。！？")
_NO_WORD = re.compile(r"\W")
ADDED = ("held_out", "score", "predicted")


# Features

def features(word: str) -> tuple[int, ...]:
    """64-bit hashes of the lower-cased word and of its beginnings."""
    word = word.lower()
    names = ["w" + word, *("b" + word[:k] for k in BEGINNINGS if len(word) >= k)]
    return tuple(xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"), SEED) - 2**63
                 for x in names)


class Memo(dict):
    """A function of words, remembered for up to MEMO_WORDS words."""

    def __init__(self, of) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, word: str):
        value = self.of(word)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = value
        return value


def _parts(text: str) -> Iterator[str]:
    """A long text in pieces that end between words."""
    begin = 0
    while begin < len(text):
        end = begin + PART_CHARS
        if end < len(text):
            gap = _NO_WORD.search(text, end)
            end = gap.start() if gap else len(text)
        yield text[begin:end]
        begin = end


def document_features(text: str, memo: Memo) -> set[int]:
    found: set[int] = set()
    for part in _parts(text):
        for word in set(_TOKEN.findall(part)) - _ENDS:
            found.update(memo[word])
    return found


def sentence_features(text: str, chosen: dict[int, int], memo: Memo) -> tuple[int, list[list[int]]]:
    """Number of sentences, and for those with chosen features, the features' numbers."""
    total, with_any, own, words = 0, [], [], 0
    for part in _parts(text):
        for token in _TOKEN.findall(part):
            if token in _ENDS:
                total += words > 0
                if own:
                    with_any.append(own)
                own, words = [], 0
            else:
                words += 1
                own.extend(chosen[f] for f in memo[token] if f in chosen)
    total += words > 0
    if own:
        with_any.append(own)
    return total, with_any


# The model

def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


class Model:
    """Weights by feature and the score of a sentence without any."""

    def __init__(self, feature_hashes: list[int]) -> None:
        self.chosen = {h: i for i, h in enumerate(feature_hashes)}
        self.weights = np.zeros(len(feature_hashes))
        self.bias = -5.0

    def fit(self, toxic: np.ndarray, sentences: np.ndarray, doc_of: np.ndarray,
            sentence_of: np.ndarray, feature: np.ndarray) -> None:
        """Minimise the documents' loss, with a penalty on the weights' squares.

        ``sentences`` counts each document's sentences, ``doc_of`` has the document of each
        sentence with features, ``sentence_of`` and ``feature`` list the latter.
        """
        bare = sentences - np.bincount(doc_of, minlength=len(toxic))
        first, second = np.zeros(len(self.weights) + 1), np.zeros(len(self.weights) + 1)
        for step in range(1, STEPS + 1):
            z = self.bias + np.bincount(
                sentence_of, self.weights[feature], minlength=len(doc_of))
            # -log of the chance that all sentences are harmless
            harm = bare * _softplus(self.bias) + np.bincount(
                doc_of, _softplus(z), minlength=len(toxic))
            harm = np.maximum(harm, 1e-12)
            slope = np.where(toxic, -1 / np.expm1(np.minimum(harm, 50)), 1.0) / len(toxic)
            steep = slope[doc_of] * _sigmoid(z)
            slopes = np.append(
                np.bincount(feature, steep[sentence_of], minlength=len(self.weights))
                + PENALTY * self.weights,
                steep.sum() + (slope * bare).sum() * _sigmoid(self.bias))
            first = 0.9 * first + 0.1 * slopes  # Adam
            second = 0.99 * second + 0.01 * slopes**2
            move = first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-10)
            move *= 0.2 * (1 - step / (STEPS + 1))
            self.weights -= move[:-1]
            self.bias -= move[-1]

    def weight(self, word: str) -> float:
        return float(sum(self.weights[self.chosen[f]] for f in features(word) if f in self.chosen))

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        """Of sentences, from the sums of their words' weights."""
        return _sigmoid(self.bias + sums)

    def document(self, harm: float) -> float:
        """Noisy-or, from the sum of the sentences' softplus scores."""
        return float(-np.expm1(-harm))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


class Scorer:
    """Sentence and document scores in a task."""

    def __init__(self, model: Model) -> None:
        self.model = model
        # An end of sentence is no number.
        self.memo = Memo(lambda w: np.nan if w in _ENDS else model.weight(w))

    def harm(self, text: str) -> float:
        """Sum of the softplus scores of the sentences with a word."""
        total, open_sum, open_words = 0.0, 0.0, 0
        for part in _parts(text):
            tokens = _TOKEN.findall(part)
            values = np.fromiter(map(self.memo.__getitem__, tokens), np.float64, len(tokens))
            ends = np.flatnonzero(np.isnan(values))
            words = np.ones(len(values), np.int64)
            words[ends] = 0
            values[ends] = 0
            starts = np.concatenate([[0], ends])
            if len(values) == 0:
                continue
            sums, counts = np.add.reduceat(values, starts), np.add.reduceat(words, starts)
            sums[0] += open_sum
            counts[0] += open_words
            open_sum, open_words = sums[-1], counts[-1]
            z = self.model.bias + sums[:-1][counts[:-1] > 0]
            total += float(_softplus(z).sum())
        if open_words:
            total += float(_softplus(self.model.bias + open_sum))
        return total

    def sentences(self, text: str) -> Iterator[tuple[int, int, float]]:
        """``(start, end, probability)`` of each sentence with a word, in code points."""
        start = end = None
        total = 0.0
        for match in _TOKEN.finditer(text):
            value = self.memo[match.group()]
            if value != value:
                if start is not None:
                    yield start, match.end(), float(self.model.probabilities(total))
                start, total = None, 0.0
            else:
                start = match.start() if start is None else start
                end, total = match.end(), total + value
        if start is not None:
            yield start, end, float(self.model.probabilities(total))


# Spark

def held_out(id_column: str):
    """Whether the id's CRC-32 leaves 0 modulo 5; a null id is not held out."""
    return F.coalesce(crc32_of_id(id_column) % 5 == 0, F.lit(False))


def labelled_sample(df: DataFrame, id_column: str, text: str, labels: DataFrame, label: str,
                    rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(id, toxic, text)``: about ``rows`` rows at most, one per id, chosen by the id's hash.

    Held-out ids, and texts of over SAMPLE_CHARS characters, are left out. Of several labels the
    majority counts, ties as toxic; of several texts of one id, the least.
    """
    one = (
        labels.select(F.col(id_column).alias("id"), F.col(label).alias("y"))
        .filter(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out("id"))
        .groupBy(F.col("id").cast("string").alias("id"))
        .agg((F.avg("y") >= 0.5).alias("toxic"))
    )
    share = min(1.0, rows / max(1, one.count()))
    place = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30))
    # The sample has about ``rows`` small rows by construction.
    chosen = F.broadcast(one.filter(place < int(share * (1 << 30))))
    texts = df.select(F.col(id_column).cast("string").alias("id"),
                      F.col(text).cast("string").alias("text"))
    return (
        texts.filter(F.length("text") <= SAMPLE_CHARS).join(chosen, "id")
        .groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    )


def _count_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo, docs, bad = Memo(features), Counter(), Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({
            "feature": pa.array(list(docs), pa.int64()), "n": pa.array(list(docs.values()), pa.int64()),
            "n_toxic": pa.array([bad[f] for f in docs], pa.int64())})
        docs.clear()
        bad.clear()
        return out

    for batch in batches:
        for toxic, text in zip(*(batch.column(c).to_pylist() for c in ("toxic", "text"))):
            found = document_features(text, memo)
            docs.update(found)
            if toxic:
                bad.update(found)
            if len(docs) >= MEMO_WORDS:
                yield flush()
    if docs:
        yield flush()


def choose_features(sample: DataFrame, most: int = MAX_FEATURES) -> list[int]:
    """The features that toxic documents have more often than chance, the clearest first."""
    whole = sample.agg(F.count(F.lit(1)).alias("n"), F.count_if("toxic").alias("bad")).first()
    if not whole.bad or whole.bad == whole.n:
        return []
    rate = whole.bad / whole.n
    expected = F.col("n") * rate
    deviations = (F.col("n_toxic") - expected) / F.sqrt(expected * (1 - rate))
    rows = (
        sample.select("toxic", "text").mapInArrow(_count_features, "feature long, n long, n_toxic long")
        .groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
        .filter(F.col("n") >= LEAST_DOCS).withColumn("deviations", deviations)
        .filter((F.col("deviations") >= LEAST_DEVIATIONS)
                & (F.col("n_toxic") >= LEAST_LIFT * rate * F.col("n")))
        .orderBy(F.desc("deviations"), "feature").limit(most).collect()
    )
    return [r.feature for r in rows]


def fit(df: DataFrame, id_column: str, text: str, labels: DataFrame, label: str = "toxic",
        rows: int = SAMPLE_ROWS) -> Model | None:
    """The fitted model; None if the sample lacks toxic or other documents."""
    sample = stored(labelled_sample(df, id_column, text, labels, label, rows), "toxic-sample")
    chosen = choose_features(sample)
    if not chosen:
        return None
    model = Model(chosen)
    shared = ship(df.sparkSession, model.chosen)

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, memo = received(shared), Memo(features)
        for batch in batches:
            found = [sentence_features(t, known, memo) for t in batch.column("text").to_pylist()]
            lengths = [np.array([len(s) for s in own], np.int32).tobytes() for _, own in found]
            numbers = [np.array([f for s in own for f in s], np.int32).tobytes() for _, own in found]
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "toxic": batch.column("toxic"),
                "sentences": pa.array([n for n, _ in found], pa.int64()),
                "lengths": pa.array(lengths, pa.binary()), "features": pa.array(numbers, pa.binary())})

    # Bounded by the sample: the chosen features of its sentences.
    docs = sample.mapInArrow(
        listed, "id string, toxic boolean, sentences long, lengths binary, features binary",
    ).toArrow().sort_by("id")
    lengths = [np.frombuffer(x, np.int32) for x in docs["lengths"].to_pylist()]
    doc_of = np.repeat(np.arange(len(lengths)), [len(x) for x in lengths])
    sentence_of = np.repeat(np.arange(len(doc_of)), np.concatenate(lengths))
    numbers = np.concatenate([np.frombuffer(x, np.int32) for x in docs["features"].to_pylist()])
    model.fit(docs["toxic"].to_numpy(), docs["sentences"].to_numpy().astype(float), doc_of,
              sentence_of, numbers)
    return model


def score_documents(df: DataFrame, id_column: str, text: str, model: Model | None,
                    threshold: float = THRESHOLD) -> DataFrame:
    """Add ADDED to every row; columns of the caller that have these names give way to them."""
    names = [n for n in df.columns if n.lower() not in ADDED]
    texts, held = unused(df, "__text"), unused(df, "__held_out")
    rows = df.select(*(f"`{n}`" for n in names), held_out(id_column).alias(held),
                     F.col(text).cast("string").alias(texts))
    shared = ship(df.sparkSession, model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = received(shared)
        scorer = known and Scorer(known)
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            if known:
                scores[:] = [known.document(scorer.harm(t)) if t else 0.0
                             for t in batch.column(texts).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(scores, pa.float64()),
                 pa.array(scores >= threshold).cast(pa.int32())], [*names, *ADDED])

    fields = "".join(f"`{n}` {rows.schema[n].dataType.simpleString()}, " for n in names)
    return rows.mapInArrow(run, f"{fields}held_out boolean, score double, predicted int")


def detect_toxicity(
    df: DataFrame, id_column: str, text: str, labels: DataFrame, label: str = "toxic",
    rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD,
) -> DataFrame:
    """Add ``held_out`` (boolean), ``score`` (double) and ``predicted`` (int) to every row.

    Rows whose ``crc32(id as text) mod 5`` is 0 are held out: their labels are never read. A null
    id is not held out and takes no part in fitting. Null and empty texts, and texts without a
    word, have no sentence to blame and score 0, as all texts do where the labels have but one
    value. Very long texts are read whole, in parts. Repeated rows and other columns stay;
    columns named as the added ones are replaced. An empty table stays empty.
    """
    model = fit(df, id_column, text, labels, label, rows)
    return score_documents(df, id_column, text, model, threshold)


def offending_sentences(df: DataFrame, id_column: str, text: str, model: Model | None,
                        least: float = THRESHOLD) -> DataFrame:
    """``(id, sentence, start, end, text, probability)`` of all sentences that reach ``least``.

    ``id`` is the id as text; ``sentence`` counts a document's sentences with a word from 0, and
    ``start`` and ``end`` are code points of the document. Without a model there are none.
    """
    shared = ship(df.sparkSession, model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = received(shared)
        if not known:
            return
        scorer = Scorer(known)
        for batch in batches:
            found = [
                {"id": doc_id, "sentence": k, "start": a, "end": b, "text": whole[a:b], "probability": p}
                for doc_id, whole in zip(*(c.to_pylist() for c in batch.columns))
                for k, (a, b, p) in enumerate(scorer.sentences(whole or "")) if p >= least
            ]
            yield pa.RecordBatch.from_pylist(found, _SENTENCE)

    return df.select(F.col(id_column).cast("string"), F.col(text).cast("string")).mapInArrow(
        run, "id string, sentence int, start int, end int, text string, probability double")


_SENTENCE = pa.schema([
    ("id", pa.string()), ("sentence", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
    ("text", pa.string()), ("probability", pa.float64())])


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, fitted on labels.toxic outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = detect_toxicity(docs, "doc_id", "text", table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op13_toxicity": op13_toxicity}
ORACLE: dict[str, str] = {}
