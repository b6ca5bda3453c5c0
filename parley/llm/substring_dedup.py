"""Removal of word windows that occur more than once in the corpus, by a count-min prefilter.

A window of 35 words is known by its least 16-word hash (its anchor): equal windows have equal
anchors, each at a place of its own. First pass: every partition sketches the anchors' counts,
the sketches are merged, and since a merged cell never counts too few, a window whose anchor
is estimated to occur once occurs once. Second pass: only the windows of anchors estimated
repeated are grouped exactly, by a 64-bit hash of all 35 words.

Before windows are shuffled, each batch of documents settles those that it holds twice and
sends every distinct hash once. So a window that occurs in a third of all documents costs one
entry per batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import (
    Windows, Words, any_names, mixed, received, row_key, ship, stored, table, utf8, words_of,
)

WINDOW = 35
ANCHOR = 16
# Rows of the sketch; a count is the least of its cells.
DEPTH = 2
# Bounds on a sketch row's cells. The merged sketch is broadcast as one bit per cell, so the
# upper bound is 128 MB; a larger corpus has more windows estimated repeated, and the exact
# pass more to group, but the result stays the same.
LEAST_BITS, MOST_BITS = 16, 29
# Bytes of text per anchor, about, and cells per anchor.
BYTES_PER_ANCHOR, CELLS_PER_ANCHOR = 60, 4
CHUNK_BITS = 16
# Candidate windows that a task holds at a time, and text bytes per exact group.
BATCH_WINDOWS = 1_000_000
GROUP_BYTES = 8 << 20


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value (the first of equals) in every run of ``width`` values."""
    place = np.arange(len(values), dtype=np.int64)
    done = 1
    while done < width and len(values):
        step = min(done, width - done)
        if len(values) <= step:
            return place[:0]
        later = values[step:] < values[:-step]
        place = np.where(later, place[step:], place[:-step])
        values = np.where(later, values[step:], values[:-step])
        done += step
    return place


def cells(anchors: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The anchors' cells in each row of the sketch; rows lie behind one another."""
    for row in range(DEPTH):
        hashed = mixed(anchors + np.uint64(0x632BE59BD9B4E019 * (row + 1) % 2**64))
        yield (hashed >> np.uint64(64 - bits)) + np.uint64(row << bits)


class Sketch:
    """Which cells were counted twice or more."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.twice = np.zeros((DEPTH << bits) // 8, np.uint8)

    def repeated(self, anchors: np.ndarray) -> np.ndarray:
        out = np.ones(len(anchors), bool)
        for place in cells(anchors, self.bits):
            byte = self.twice[(place >> np.uint64(3)).astype(np.int64)]
            out &= (byte >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8)) & 1 > 0
        return out


def sketch_bits(size: int) -> int:
    wanted = max(1, size // BYTES_PER_ANCHOR * CELLS_PER_ANCHOR)
    return min(MOST_BITS, max(LEAST_BITS, int(wanted - 1).bit_length()))


def anchor_sketch(df: DataFrame, text: str, bits: int) -> Sketch:
    """Sketch of all anchors of all texts."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, windows = Words(), Windows()
        for batch in batches:
            found = []
            for value in batch.column(0).to_pylist():
                grams = windows.of(words.of(utf8(value)), ANCHOR)
                places = sliding_argmin(grams, WINDOW - ANCHOR + 1)
                if len(places):
                    first = np.ones(len(places), bool)
                    first[1:] = places[1:] != places[:-1]  # places never go back
                    found += cells(grams[places[first]], bits)
            if found:
                each = np.sort(np.concatenate(found))
                chunk = (each >> np.uint64(CHUNK_BITS)).astype(np.int64)
                low = (each & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.uint16)
                numbers, starts = np.unique(chunk, return_index=True)
                parts = [x.tobytes() for x in np.split(low, starts[1:])]
                yield pa.RecordBatch.from_pydict(
                    {"chunk": pa.array(numbers, pa.int64()), "data": pa.array(parts, pa.binary())}
                )

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                more = np.bincount(np.frombuffer(data.as_buffer(), np.uint16),
                                   minlength=1 << CHUNK_BITS)
                if chunk in counts:
                    more += counts[chunk]
                counts[chunk] = np.minimum(more, 2).astype(np.uint8)
        for chunk, total in counts.items():
            yield pa.RecordBatch.from_pydict(
                {"chunk": pa.array([chunk], pa.int64()),
                 "data": pa.array([np.packbits(total > 1).tobytes()], pa.binary())}
            )

    shape = "chunk long, data binary"
    parts = df.select(text).mapInArrow(count, shape)
    sketch = Sketch(bits)
    step = 1 << CHUNK_BITS >> 3
    for row in parts.repartition("chunk").mapInArrow(merge, shape).toLocalIterator():
        sketch.twice[row.chunk * step :][:step] = np.frombuffer(row.data, np.uint8)
    return sketch


# A batch: its windows' documents and places, and what it settled itself. A share: the hashes
# that a batch sends to one exact group. Both are numpy arrays one after the other.
_PARTS = "batch long, part long, keys binary, counts binary, places binary, settled binary, " \
    "hashes binary, windows binary, twice binary"
_ARROW = pa.schema([(n, pa.int64() if n in ("batch", "part") else pa.binary())
                    for n in (x.split()[0] for x in _PARTS.split(", "))])


def _candidates(shipped, parts: int):
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, windows, sketch = Words(), Windows(), received(shipped)
        base = TaskContext.get().partitionId() << 24
        keys: list[tuple[int, int]] = []
        found: list[np.ndarray] = []
        places: list[np.ndarray] = []
        held = number = 0

        def flush() -> pa.RecordBatch:
            each = np.concatenate(found)
            known, first, inverse, counts = np.unique(
                each, return_index=True, return_inverse=True, return_counts=True)
            rows = [{
                "batch": base + number, "part": None,
                "keys": np.array(keys, np.int64).tobytes(),
                "counts": np.array([len(x) for x in places], np.int32).tobytes(),
                "places": np.concatenate(places).astype(np.int32).tobytes(),
                "settled": np.packbits(counts[inverse] > 1).tobytes(),
            }]
            group = (known % np.uint64(parts)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            numbers, starts = np.unique(group[order], return_index=True)
            for part, own in zip(numbers.tolist(), np.split(order, starts[1:])):
                rows.append({
                    "batch": base + number, "part": part, "hashes": known[own].tobytes(),
                    "windows": first[own].astype(np.int32).tobytes(),
                    "twice": np.packbits(counts[own] > 1).tobytes(),
                })
            return pa.RecordBatch.from_pylist(rows, _ARROW)

        for batch in batches:
            for k1, k2, value in zip(*(c.to_pylist() for c in batch.columns)):
                values = words.of(utf8(value))
                grams = windows.of(values, ANCHOR)
                anchor = sliding_argmin(grams, WINDOW - ANCHOR + 1)
                if not len(anchor):
                    continue
                start = np.flatnonzero(sketch.repeated(grams[anchor]))
                if not len(start):
                    continue
                keys.append((k1, k2))
                places.append(start)
                found.append(windows.of(values, WINDOW)[start])
                held += len(start)
                if held >= BATCH_WINDOWS:
                    yield flush()
                    keys, found, places, held, number = [], [], [], 0, number + 1
        if held:
            yield flush()

    return find


def _group(rows: pa.Table) -> pa.Table:
    """Exact grouping of one part: which windows of which batch occur again."""
    batches = rows["batch"].to_pylist()
    hashes = [np.frombuffer(x, np.uint64) for x in rows["hashes"].to_pylist()]
    twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(h))
             for x, h in zip(rows["twice"].to_pylist(), hashes)]
    known, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(inverse, 1 + np.concatenate(twice), minlength=len(known))
    again = (total[inverse] > 1) & (np.concatenate(twice) == 0)
    ends = np.cumsum([len(h) for h in hashes])
    out = []
    for batch, windows, flag in zip(
        batches, rows["windows"].to_pylist(), np.split(again, ends[:-1])
    ):
        if flag.any():
            out.append({"batch": batch,
                        "windows": np.frombuffer(windows, np.int32)[flag].tobytes()})
    return pa.Table.from_pylist(out, pa.schema([("batch", pa.int64()), ("windows", pa.binary())]))


def _runs(starts: np.ndarray) -> bytes:
    """Sorted starts as first starts and lengths of runs of neighbours."""
    if not len(starts):
        return b""
    first = np.flatnonzero(np.diff(starts, prepend=starts[0] - 2) > 1)
    length = np.diff(first, append=len(starts))
    return np.stack([starts[first], length]).astype(np.int32).tobytes()


def _gone(runs: bytes, n: int) -> np.ndarray:
    """Which of n words the windows of such runs cover."""
    first, length = np.frombuffer(runs, np.int32).reshape(2, -1)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, first + length + (WINDOW - 1), -1)
    return np.cumsum(edges)[:n] > 0


def _collect(rows: pa.Table) -> pa.Table:
    """The repeated windows of one batch, by document."""
    head = next(r for r in rows.to_pylist() if r["keys"] is not None)
    counts = np.frombuffer(head["counts"], np.int32)
    places = np.frombuffer(head["places"], np.int32)
    flag = np.unpackbits(np.frombuffer(head["settled"], np.uint8), count=len(places)) > 0
    for windows in rows["windows"].to_pylist():
        if windows is not None:
            flag[np.frombuffer(windows, np.int32)] = True
    keys = np.frombuffer(head["keys"], np.int64).reshape(-1, 2)
    ends = np.cumsum(counts)[:-1]
    chosen = [_runs(p[f]) for p, f in zip(np.split(places, ends), np.split(flag, ends))]
    table_ = pa.table({"__k1": keys[:, 0], "__k2": keys[:, 1], "__at": pa.array(chosen)})
    return table_.filter(pa.array([len(c) > 0 for c in chosen]))


def repeated_windows(df: DataFrame, text: str) -> DataFrame:
    """``(__k1, __k2, __at)``: runs of repeated windows by text key.

    Equal texts have equal keys; their rows may differ in what their batch knew, never in
    the windows that are repeated.
    """
    spark = df.sparkSession
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shipped = ship(spark, anchor_sketch(df, text, sketch_bits(size)))
    parts = max(1, -(-size // GROUP_BYTES))
    k1, k2 = row_key(text)
    # A pass over all texts whose two kinds of rows are used apart.
    found = stored(df.select(k1, k2, text).mapInArrow(_candidates(shipped, parts), _PARTS),
                   "windows")
    again = (
        found.filter("part IS NOT NULL").select("part", "batch", "hashes", "windows", "twice")
        .groupBy("part").applyInArrow(_group, "batch long, windows binary")
    )
    none = F.lit(None).cast("binary")
    heads = found.filter("part IS NULL").select("batch", "keys", "counts", "places", "settled",
                                                none.alias("windows"))
    again = again.select("batch", *(none.alias(n) for n in
                                    ("keys", "counts", "places", "settled")), "windows")
    return heads.unionByName(again).groupBy("batch").applyInArrow(
        _collect, "__k1 long, __k2 long, __at binary")


@any_names("n_words", "n_removed", "kept", columns=("text",))
def remove_repeats(df: DataFrame, text: str) -> DataFrame:
    """Add ``n_words``, ``n_removed`` (long) and ``kept`` (string) to every row.

    ``kept`` holds the words that no repeated window covers, joined by one space. A null or
    empty text has no words and keeps the empty string; texts under 35 words lose nothing. All
    copies lose their words: no copy is spared. Other columns and repeated rows stay; columns
    named as the added ones are replaced. Very long texts are read whole, an empty table stays
    empty.
    """
    k1, k2 = row_key(text)
    # Stored: a join of two plain exchanges lets Spark split the partition of a hot text.
    at = stored(repeated_windows(df, text).dropDuplicates(["__k1", "__k2"]), "repeats")
    joined = df.withColumns({"__k1": k1, "__k2": k2}).join(at, ["__k1", "__k2"], "left")
    joined = joined.drop("__k1", "__k2")

    def rebuild(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, kept = [], [], []
            for value, starts in zip(batch.column(text).to_pylist(),
                                     batch.column("__at").to_pylist()):
                words = words_of(value)
                totals.append(len(words))
                if starts is not None:
                    gone = _gone(starts, len(words))
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                removed.append(totals[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            columns = {n: batch.column(n) for n in batch.schema.names if n != "__at"}
            yield pa.RecordBatch.from_pydict(columns | {
                "n_words": pa.array(totals, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string()),
            })

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return joined.mapInArrow(rebuild, f"{fields}, n_words long, n_removed long, kept string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated 35-word windows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, "text").select(
        "doc_id", "n_words", "n_removed",
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


SQL = f"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
    FROM (SELECT *, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM words)
), again AS (SELECT g FROM windows GROUP BY g HAVING count(*) > 1),
gone AS (
    SELECT doc_id, list(DISTINCT p) AS gone
    FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM windows JOIN again USING (g))
    GROUP BY doc_id
), kept AS (
    SELECT doc_id, list(w ORDER BY p) AS kept FROM (
        SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM words
    ) a WHERE NOT EXISTS (
        SELECT 1 FROM (SELECT doc_id, unnest(gone) AS p FROM gone) b
        WHERE a.doc_id = b.doc_id AND a.p = b.p)
    GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words,
    len(w)::BIGINT - coalesce(len(kept), 0)::BIGINT AS n_removed,
    sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

QUERIES = {"op9_substring_dedup": op9_substring_dedup}
ORACLE = {"op9_substring_dedup": SQL}
