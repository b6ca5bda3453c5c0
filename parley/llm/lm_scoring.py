"""Scores by the difference of two language models' losses per token.

Target and background are word-pair models over one vocabulary, the corpus' distinct words, and
both models are smoothed alike. A pair's probability is mixed with its second word's, a word's
with the uniform one. A document's score is its mean loss per token under the target model less
that under the background model: the lower, the more it looks like the target.

Every occurrence in every document is counted, and every distinct word and pair has counts of its
own, kept by a hash of 57 bits at least: the models grow with the corpus and are never in one place. Rows are
dealt to batches of bounded size. Each batch sends its distinct n-grams, sorted, with its own
counts, to the chunks of the hash range; a chunk adds them up and answers each batch with the
corpus' counts in the same order. A word that is everywhere is one entry per batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import Words, any_names, mixed, stored, table, utf8

# Text of one batch: a share of the corpus within these bounds. A longer text is its own batch.
LEAST_BATCH, MOST_BATCH, BATCHES = 1 << 18, 1 << 23, 256
# Text whose n-grams meet in one chunk at most, and the least number of chunks as a power of 2.
CHUNK_BYTES, LEAST_CHUNK_BITS = 1 << 25, 10
# The low bytes of a key that are sent. A chunk fixes as many of the two upper ones as it has
# bits; the others are dropped, so keys have 48 bits and the chunk's, 58 at least.
KEY_BYTES = 6
# Weight of the word model in a pair's probability, and of the uniform one in a word's.
PAIR_WEIGHT = 4.0
WORD_WEIGHT = 100.0


def word_keys(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Even keys, of words; those of pairs are odd."""
    return hashes & ~np.uint64(1) & sent_bits(bits)


def pair_keys(hashes: np.ndarray, bits: int) -> np.ndarray:
    keys = mixed(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
    return (keys | np.uint64(1)) & sent_bits(bits)


def sent_bits(bits: int) -> np.uint64:
    """The bits of a key that its chunk of ``bits`` bits and its sent bytes tell."""
    low = 8 * KEY_BYTES
    return np.uint64(((1 << 64) - (1 << (64 - min(bits, 64 - low)))) | ((1 << low) - 1))


def chunk_bits(size: int) -> int:
    return max(LEAST_CHUNK_BITS, int(size // CHUNK_BYTES).bit_length())


def planes(values: np.ndarray) -> bytes:
    """Integers with the bytes of equal weight side by side: zeros then compress well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def from_planes(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype)[:, 0]


def batched(df: DataFrame, text: str, batch_bytes: int) -> DataFrame:
    """Add ``__batch`` (long) and store the rows, so a lost task cannot deal them anew."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seen = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(
                zero_copy_only=False).astype(np.int64)
            ends = seen + np.cumsum(sizes + 16)
            seen = int(ends[-1]) if len(ends) else seen
            number = first + (ends - sizes - 16) // batch_bytes
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(number)], [*batch.schema.names, "__batch"])

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return stored(df.mapInArrow(deal, f"{fields}, __batch long"), "lm-rows", compression="zstd")


def own_counts(rows: DataFrame, text: str, target: str, bits: int, batch_bytes: int) -> DataFrame:
    """``(chunk, batch, keys, target, background)``: a batch's n-grams and its counts of them.

    A batch that two tasks read, or a very long one, sends several such rows per chunk.
    """

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        held: dict[bool, list[np.ndarray]] = {True: [], False: []}
        number, size = None, 0

        def send() -> Iterator[pa.RecordBatch]:
            both = [np.concatenate(held[k]) if held[k] else np.empty(0, np.uint64)
                    for k in (True, False)]
            held[True], held[False] = [], []
            if not len(both[0]) + len(both[1]):
                return
            keys, place = np.unique(np.concatenate(both), return_inverse=True)
            mine = np.bincount(place[: len(both[0])], minlength=len(keys)).astype(np.uint32)
            every = np.bincount(place, minlength=len(keys)).astype(np.uint32)
            chunk = (keys >> np.uint64(64 - bits)).astype(np.int64)
            numbers, starts = np.unique(chunk, return_index=True)
            ends = [*starts[1:].tolist(), len(keys)]
            low = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])
            parts = list(zip(starts.tolist(), ends))
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array(numbers, pa.int64()),
                "batch": pa.array(np.full(len(numbers), number), pa.int64()),
                "keys": pa.array([low[a:b].tobytes() for a, b in parts], pa.binary()),
                "target": pa.array([planes(mine[a:b]) for a, b in parts], pa.binary()),
                "background": pa.array([planes(every[a:b]) for a, b in parts], pa.binary()),
            })

        for batch in batches:
            for value, is_target, own in zip(batch.column(0), batch.column(1).to_pylist(),
                                             batch.column(2).to_pylist()):
                if own != number or size >= batch_bytes:
                    yield from send()
                    number, size = own, 0
                data = utf8(value.as_py())
                hashes = words.of(data)
                if len(hashes):
                    held[is_target] += [word_keys(hashes, bits), pair_keys(hashes, bits)]
                    size += len(data)
        yield from send()

    chosen = rows.select(text, F.coalesce(F.col(target), F.lit(False)).alias("target"), "__batch")
    return chosen.mapInArrow(
        local, "chunk long, batch long, keys binary, target binary, background binary")


def answers(counts: DataFrame, bits: int) -> DataFrame:
    """``(__batch, chunk, target, background)``: the corpus' counts of each batch's n-grams.

    They are in the order of the batch's distinct keys. ``words``, ``n_target`` and
    ``n_background`` are a chunk's distinct words and both models' occurrences of them, told once.
    """

    def merge(rows: pa.Table) -> pa.Table:
        chunk = rows["chunk"][0].as_py()
        low = np.frombuffer(b"".join(rows["keys"].to_pylist()), np.uint8).reshape(-1, KEY_BYTES)
        keys = np.zeros((len(low), 8), np.uint8)
        keys[:, :KEY_BYTES] = low
        top = np.uint64(chunk) << np.uint64(64 - bits) & ~np.uint64((1 << 8 * KEY_BYTES) - 1)
        keys, place = np.unique(keys.view("<u8")[:, 0] | top, return_inverse=True)
        sums = []
        parts: list[np.ndarray] = []
        for name in ("target", "background"):
            parts = [from_planes(x, "<u4") for x in rows[name].to_pylist()]
            sums.append(np.bincount(place, np.concatenate(parts), len(keys)).astype("<i8"))
        batches, number = np.unique(rows["batch"].to_numpy(), return_inverse=True)
        # One entry per batch and key, also where a batch came in several rows.
        pairs = np.unique(np.repeat(number, [len(x) for x in parts]) * len(keys) + place)
        edges = np.searchsorted(pairs, np.arange(1, len(batches)) * len(keys))
        found = [x % len(keys) for x in np.split(pairs, edges)]
        word = keys & np.uint64(1) == 0
        once = lambda x: pa.array([int(x)] + [0] * (len(batches) - 1), pa.int64())
        return pa.table({
            "__batch": pa.array(batches, pa.int64()),
            "chunk": pa.array([chunk] * len(batches), pa.int64()),
            "target": pa.array([planes(sums[0][x]) for x in found], pa.binary()),
            "background": pa.array([planes(sums[1][x]) for x in found], pa.binary()),
            "words": once(word.sum()), "n_target": once(sums[0][word].sum()),
            "n_background": once(sums[1][word].sum()),
        })

    return stored(counts.groupBy("chunk").applyInArrow(
        merge, "__batch long, chunk long, target binary, background binary, words long, "
               "n_target long, n_background long"), "lm-counts", compression="zstd")


def batch_losses(texts: Iterable[str | None], counts: pa.Table, bits: int, vocabulary: int,
                 totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's number of words and its mean loss per word under both models."""
    words = Words()
    each = [words.of(utf8(x)) for x in texts]
    sizes = np.array([len(x) for x in each], np.int64)
    if not sizes.sum():
        return sizes, np.zeros((len(sizes), 2))
    filled = [x for x in each if len(x)]
    own = np.concatenate([word_keys(x, bits) for x in filled])
    keys, place = np.unique(
        np.concatenate([own, *(pair_keys(x, bits) for x in filled)]), return_inverse=True)
    counts = counts.sort_by("chunk")
    known = np.stack([
        np.concatenate([from_planes(x, "<i8") for x in counts[name].to_pylist()])
        for name in ("target", "background")], axis=1).astype(np.float64)
    if len(known) != len(keys):
        raise ValueError(f"{len(keys)} n-grams were sent and {len(known)} counts came back")
    of_word, of_pair = place[: len(own)], place[len(own) :]
    count = known[of_word]
    single = (count + WORD_WEIGHT / vocabulary) / (totals + WORD_WEIGHT)
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    start = np.zeros(len(own), bool)
    start[np.cumsum(sizes)[sizes > 0] - sizes[sizes > 0]] = True
    later = np.flatnonzero(~start)
    chance = single.copy()
    chance[later] = (known[of_pair] + PAIR_WEIGHT * single[later]) / (count[later - 1] + PAIR_WEIGHT)
    logs = -np.log(chance)
    sums = np.stack([np.bincount(text_of, logs[:, k], len(sizes)) for k in (0, 1)], axis=1)
    return sizes, sums / np.maximum(sizes, 1)[:, None]


@any_names("n_tokens", "target_loss", "background_loss", "score", columns=("text", "target"))
def score_difference(df: DataFrame, text: str, target: str) -> DataFrame:
    """Add ``n_tokens`` (long), ``target_loss``, ``background_loss`` and ``score`` (double).

    ``target`` marks the target's documents (null: not one); the background is the whole
    corpus. A null or empty text has no tokens and losses of 0. With no target its model is
    the uniform one. Very long texts are read whole. Other columns and repeated rows stay;
    columns named as the added ones are replaced. An empty table stays empty.
    """
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = chunk_bits(size)
    batch_bytes = min(MOST_BATCH, max(LEAST_BATCH, size // BATCHES))
    rows = batched(df, text, batch_bytes)
    known = answers(own_counts(rows, text, target, bits, batch_bytes), bits)
    told = known.agg(F.sum("words"), F.sum("n_target"), F.sum("n_background")).first()
    vocabulary = max(1, told[0] or 0)
    totals = np.array([told[1] or 0, told[2] or 0], np.float64)
    names = df.columns

    def score(own: pa.Table, counts: pa.Table) -> pa.Table:
        sizes, each = batch_losses(own[text].to_pylist(), counts, bits, vocabulary, totals)
        return pa.table({n: own[n] for n in names} | {
            "n_tokens": pa.array(sizes, pa.int64()), "target_loss": pa.array(each[:, 0]),
            "background_loss": pa.array(each[:, 1]), "score": pa.array(each[:, 0] - each[:, 1]),
        })

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    counts = known.select("__batch", "chunk", "target", "background")
    return rows.groupBy("__batch").cogroup(counts.groupBy("__batch")).applyInArrow(
        score, f"{fields}, n_tokens long, target_loss double, background_loss double, score double")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; those labelled with quality 1 are the target."""
    good = (
        table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct()
        .withColumn("good", F.lit(True)).hint("merge")
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(good, "doc_id", "left")
    return score_difference(docs, "text", "good").drop("text", "good")


QUERIES = {"op6_lm_scoring": op6_lm_scoring}
ORACLE: dict[str, str] = {}
