"""Quality classifier: random-indexing word vectors, a two-layer network, calibrated.

Every word falls into one of BUCKETS buckets and each bucket has a sparse random index
vector. A word vector is the sum of the index vectors of the neighbours of all the word's
occurrences in the corpus, so one pass of local sums gives all vectors. A document is the
mean of its words' vectors. A small network, fitted on a bounded sample of labelled rows,
scores that mean; one temperature, fitted on rows that the network has not seen, makes the
scores probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import (
    MEMO_WORDS, any_names, chunks, crc32_of_id, merged_chunks, received, ship, table,
)

BUCKETS = 16_384
DIM = 64
# Entries of an index vector that are +1 or -1; the rest is 0.
NONZERO = 8
NEIGHBOURS = 2
CHUNK = 1024
# Positions that are summed at a time, whatever a text's length.
SLICE = 100_000
# Bound on labelled rows that the network is fitted on, calibration rows included.
SAMPLE_ROWS = 20_000
HIDDEN = 32
EPOCHS = 60
THRESHOLD = 0.7
SEED = 11

# Words here: runs of letters, digits or punctuation marks.
_WORD = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[!-/:-@\[-`{-~]+")
_PAD = BUCKETS


class Buckets(dict):
    """Bucket numbers of words, remembered for up to MEMO_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) % BUCKETS
        return value

    def of(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").encode("utf-8", "surrogatepass"))
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def index_vectors() -> np.ndarray:
    """A ternary vector for each bucket, and zeros for the padding between documents."""
    random = np.random.default_rng(SEED)
    vectors = np.zeros((BUCKETS + 1, DIM), np.int8)
    for bucket in range(BUCKETS):
        places = random.choice(DIM, NONZERO, replace=False)
        vectors[bucket, places] = random.choice((-1, 1), NONZERO)
    return vectors


def add_contexts(ids: np.ndarray, index: np.ndarray, sums: np.ndarray) -> None:
    """Add the neighbours' index vectors to each word's sum; ids start and end with padding."""
    r = NEIGHBOURS
    for begin in range(r, len(ids) - r, SLICE):
        end = min(begin + SLICE, len(ids) - r)
        near = index[ids[begin - r : end + r]]
        n = end - begin
        context = sum(near[r + d : r + d + n] for d in range(-r, r + 1) if d)
        own = ids[begin:end]
        order = np.argsort(own, kind="stable")
        words, starts, counts = np.unique(own[order], return_index=True, return_counts=True)
        sums[words, :DIM] += np.add.reduceat(context[order], starts, axis=0, dtype=np.int32)
        sums[words, DIM] += counts


def _local_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    buckets, index = Buckets(), index_vectors()
    sums = np.zeros((BUCKETS + 1, DIM + 1), np.int32)
    pad = np.full(NEIGHBOURS, _PAD, np.int32)

    def flush(held: list[np.ndarray]) -> None:
        if held:
            add_contexts(np.concatenate([pad, *held]), index, sums)

    for batch in batches:
        held, n = [], 0
        for text in batch.column(0).to_pylist():
            held += [buckets.of(text), pad]
            n += len(held[-2])
            if n >= SLICE:
                flush(held)
                held, n = [], 0
        flush(held)
    for number, part in chunks(sums[:BUCKETS], CHUNK):
        yield pa.RecordBatch.from_pydict(
            {"chunk": pa.array([number], pa.int32()), "data": pa.array([part.tobytes()])}
        )


def word_vectors(df: DataFrame, text: str) -> np.ndarray:
    """Vectors of all buckets from the whole corpus; BUCKETS x DIM numbers at the driver.

    The mean context is taken off, so that frequent words do not make all vectors alike; the
    word's own index vector is added.
    """
    parts = df.select(text).mapInArrow(_local_sums, "chunk int, data binary")
    total = np.zeros((BUCKETS, DIM + 1), np.int64)
    for row in merged_chunks(parts, "int32", "int64", 2**62).collect():
        total[row.chunk * CHUNK :][:CHUNK] = np.frombuffer(row.data, np.int64).reshape(-1, DIM + 1)
    counts = np.maximum(total[:, DIM:], 1)
    context = total[:, :DIM] / counts
    context -= total[:, :DIM].sum(axis=0) / max(1, total[:, DIM].sum())
    context[total[:, DIM] == 0] = 0
    length = np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    own = index_vectors()[:BUCKETS] / np.sqrt(NONZERO)
    return (context / length * 0.5 + own).astype(np.float32)


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of a document's words; zeros without words."""
    total = np.zeros(DIM, np.float64)
    for begin in range(0, len(ids), SLICE):
        total += vectors[ids[begin : begin + SLICE]].sum(axis=0, dtype=np.float64)
    return total / max(1, len(ids))


class Network:
    """Scaled input, one hidden tanh layer, one logit divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        random = np.random.default_rng(SEED)
        held = random.random(len(y)) < 0.2
        self.mean = x.mean(axis=0)
        self.scale = np.maximum(x.std(axis=0), 1e-9)
        self.w1 = random.normal(0, DIM**-0.5, (x.shape[1], HIDDEN))
        self.b1 = np.zeros(HIDDEN)
        self.w2 = random.normal(0, HIDDEN**-0.5, HIDDEN)
        self.b2 = np.zeros(1)
        self.temperature = 1.0
        self._fit((x[~held] - self.mean) / self.scale, y[~held].astype(float), random)
        if held.any():
            logits = self.logits(x[held])
            choices = np.geomspace(0.25, 8, 101)
            losses = [_loss(logits / t, y[held]) for t in choices]
            self.temperature = float(choices[int(np.argmin(losses))])

    def _fit(self, x: np.ndarray, y: np.ndarray, random: np.random.Generator) -> None:
        names = ("w1", "b1", "w2", "b2")
        first = {n: np.zeros_like(getattr(self, n)) for n in names}
        second = {n: np.zeros_like(getattr(self, n)) for n in names}
        step = 0
        for epoch in range(EPOCHS):
            rate = 0.01 * (1 - epoch / EPOCHS)
            order = random.permutation(len(y))
            for begin in range(0, len(y), 256):
                rows = order[begin : begin + 256]
                hidden = np.tanh(x[rows] @ self.w1 + self.b1)
                error = (_sigmoid(hidden @ self.w2 + self.b2) - y[rows]) / len(rows)
                back = np.outer(error, self.w2) * (1 - hidden**2)
                slopes = {
                    "w1": x[rows].T @ back + 1e-4 * self.w1, "b1": back.sum(axis=0),
                    "w2": hidden.T @ error + 1e-4 * self.w2, "b2": np.array([error.sum()]),
                }
                step += 1
                for n in names:  # Adam
                    first[n] = 0.9 * first[n] + 0.1 * slopes[n]
                    second[n] = 0.999 * second[n] + 0.001 * slopes[n] ** 2
                    move = first[n] / (1 - 0.9**step)
                    size = np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8
                    setattr(self, n, getattr(self, n) - rate * move / size)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(_sigmoid(logits), 1e-12, 1 - 1e-12)
    return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def sample_labels(labels: DataFrame, id_column: str, label: str, rows: int) -> DataFrame:
    """``(id, y)``: one row per labelled id outside the held-out quarter, about ``rows`` at most.

    Ids are chosen by their hash. Ids with several labels get the majority, ties count as 1.
    """
    held_out = crc32_of_id(id_column) % 4 == 2
    one = (
        labels.filter(F.col(id_column).isNotNull() & F.col(label).isNotNull() & ~held_out)
        .groupBy(F.col(id_column).alias("id"))
        .agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    )
    known = one.count()
    share = min(1.0, rows / max(1, known))
    place = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30))
    return one.filter(place < int(share * (1 << 30)))


def fit(df: DataFrame, id_column: str, text: str, labels: DataFrame, label: str,
        rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, Network | None]:
    """Word vectors of the corpus and the fitted network (None without labelled texts)."""
    spark = df.sparkSession
    vectors = word_vectors(df, text)
    shared = ship(spark, vectors)

    def pool(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, known = Buckets(), received(shared)
        for batch in batches:
            means = [
                pooled(buckets.of(t), known).astype(np.float32).tobytes()
                for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_pydict(
                {"id": batch.column("id"), "y": batch.column("y"), "mean": pa.array(means)}
            )

    # The sample has about ``rows`` small rows by construction.
    sample = F.broadcast(sample_labels(labels, id_column, label, rows))
    texts = df.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    means = (
        texts.join(sample, "id").select("id", "y", "text")
        .mapInArrow(pool, "id long, y int, mean binary")
        .groupBy("id").agg(F.max("y").alias("y"), F.min("mean").alias("mean"))
    )
    table_ = means.toArrow().sort_by("id")
    if not table_.num_rows:
        return vectors, None
    x = np.array([np.frombuffer(m, np.float32) for m in table_["mean"].to_pylist()], np.float64)
    return vectors, Network(x, table_["y"].to_numpy())


def score(df: DataFrame, text: str, vectors: np.ndarray, network: Network | None) -> DataFrame:
    """Add ``score`` (double, 0 to 1) to every row; 0.5 everywhere without a network."""
    shared = ship(df.sparkSession, (vectors, network))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, (known, net) = Buckets(), received(shared)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            scores = np.full(len(texts), 0.5)
            if net is not None and texts:
                scores = net.probabilities(np.array([pooled(buckets.of(t), known) for t in texts]))
            columns = {n: batch.column(n) for n in batch.schema.names}
            yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(scores, pa.float64())})

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(run, f"{fields}, score double")


@any_names("held_out", "score", "predicted", columns=("id_column", "text"), keyed="labels")
def classify(
    df: DataFrame, id_column: str, text: str, labels: DataFrame, label: str = "quality",
    rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD,
) -> DataFrame:
    """Add ``held_out`` (boolean), ``score`` (double) and ``predicted`` (int) to every row.

    Rows whose ``crc32(id as text) mod 4`` is 2 are held out: their labels are never read. A
    null id is not held out and takes no part in fitting. Null and empty texts have the zero
    vector and its score. Very long texts are read whole, in slices. Ids are numbers. Repeated
    rows and other columns stay; columns named as the added ones are replaced. Without labels
    every score is 0.5. An empty table stays empty.
    """
    vectors, network = fit(df, id_column, text, labels, label, rows)
    held = F.coalesce(crc32_of_id(id_column) % 4 == 2, F.lit(False))
    out = score(df, text, vectors, network).withColumn("held_out", held)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, fitted on labels.quality outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = classify(docs, "doc_id", "text", table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
ORACLE: dict[str, str] = {}
