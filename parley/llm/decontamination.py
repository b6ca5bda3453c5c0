"""Benchmark decontamination by winnowing.

The 5-word hashes of a text are winnowed: of every 6 consecutive ones the smallest is kept.
Two texts that share 10 consecutive words share those 6 hashes and therefore a kept one, so
no shared span of 10 words is missed. Documents with a fingerprint of some benchmark item are
searched for the items' 10-word windows, whose hits are extended to the words they cover.

The benchmark is the query set: it is cut into blocks of bounded size, and each block's
index is broadcast for one pass over the documents. A pass needs no shuffle, so neither hot
documents nor repeated rows matter. Items under 10 words are one window each and are looked
up by exact hashes of that length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import (
    Windows, Words, any_names, covered, received, ship, stored, table, utf8,
)

WINDOW = 10
GRAM = 5
GUARANTEE = WINDOW - GRAM + 1
# UTF-8 bytes of benchmark text in one broadcast block; its index takes some four times that.
BLOCK_BYTES = 32 << 20

# Words are runs of 0-9, a-z and non-ASCII bytes after A-Z is lower-cased.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def plain(text: str | None) -> bytes:
    """The words of a text, with blanks between them."""
    return utf8(text).translate(_TABLE)


def winnowed(grams: np.ndarray) -> np.ndarray:
    """The smallest hash of every run of GUARANTEE hashes, each value once."""
    if len(grams) < GUARANTEE:
        return np.empty(0, np.uint64)
    return np.unique(np.lib.stride_tricks.sliding_window_view(grams, GUARANTEE).min(axis=1))


class Index:
    """Fingerprints and windows of one block of items."""

    def __init__(self, items: Iterable[tuple[str, str | None]]) -> None:
        words, windows = Words(), Windows()
        prints: list[np.ndarray] = [np.empty(0, np.uint64)]
        owners: dict[int, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            values = words.of(plain(text))
            length = min(WINDOW, len(values))
            if not length:
                continue
            if length == WINDOW:
                prints.append(winnowed(windows.of(values, GRAM)))
            for window in windows.of(values, length).tolist():
                owners[length][window].add(item)
        self.prints = np.unique(np.concatenate(prints))
        self.windows = {n: np.array(sorted(own), np.uint64) for n, own in owners.items()}
        self.owners = {n: [sorted(own[w]) for w in sorted(own)] for n, own in owners.items()}

    def search(self, values: np.ndarray, windows: Windows) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and by which items."""
        hit, items = np.zeros(len(values), bool), set()
        for length, known in self.windows.items():
            if length == WINDOW and not _found(
                winnowed(windows.of(values, GRAM)), self.prints
            )[0].any():
                continue
            match, place = _found(windows.of(values, length), known)
            if match.any():
                hit |= covered(np.flatnonzero(match), length, len(values))
                for number in np.unique(place[match]).tolist():
                    items.update(self.owners[length][number])
        return hit, items


def _found(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are among the sorted known ones, and where."""
    if not len(known) or not len(values):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    place = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[place] == values, place


def _pass(index, text: str):
    """One pass of documents against a broadcast block; earlier passes' hits are joined."""

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, windows = Words(), Windows()
        block: Index = received(index)
        for batch in batches:
            bits, lists, counts, hits = [], [], [], []
            seen = zip(
                batch.column(text).to_pylist(), batch.column("__bits").to_pylist(),
                batch.column("__items").to_pylist(),
            )
            for value, before, known in seen:
                values = words.of(plain(value))
                hit, items = block.search(values, windows)
                if before:
                    hit |= np.unpackbits(np.frombuffer(before, np.uint8), count=len(hit)) > 0
                bits.append(np.packbits(hit).tobytes() if hit.any() else None)
                lists.append(sorted(items | set(known)))
                counts.append(len(values))
                hits.append(int(hit.sum()))
            new = {
                "__bits": pa.array(bits, pa.binary()),
                "__items": pa.array(lists, pa.list_(pa.string())),
                "n_words": pa.array(counts, pa.int64()),
                "n_hit": pa.array(hits, pa.int64()),
            }
            kept = {n: batch.column(n) for n in batch.schema.names if n not in new}
            yield pa.RecordBatch.from_pydict(kept | new)

    return search


@any_names("n_words", "n_hit", "items", columns=("text",))
def find_contamination(
    df: DataFrame, text: str, benchmark: DataFrame, item: str, item_text: str,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add ``n_words``, ``n_hit`` (long) and ``items`` (sorted array of item ids as text).

    A null or empty text has no words and no hits. Items without words or with a null id are
    ignored; an id in several rows counts once. An empty benchmark hits nothing. Very long
    texts are searched whole. Other columns and repeated rows of ``df`` stay; columns named as
    the added ones are replaced. An empty table stays empty.
    """
    spark = df.sparkSession
    source = benchmark.select(
        F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")
    ).filter("item IS NOT NULL AND text IS NOT NULL")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    source = source.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    plain = T.StructType(df.schema.fields)
    out = df.withColumns(
        {
            "__bits": F.lit(None).cast("binary"),
            "__items": F.array().cast("array<string>"),
            "n_words": F.lit(0).cast("long"),
            "n_hit": F.lit(0).cast("long"),
        }
    )
    names = [*plain.names, "__bits", "__items", "n_words", "n_hit"]
    schema = T.StructType(
        [T.StructField(f.name, f.dataType, True) for f in out.select(*names).schema.fields]
    )
    for number in range(blocks):
        if number:
            out = stored(out, "decontamination")  # only one block's index is in memory
        rows = source.filter(F.col("block") == number).select("item", "text").collect()
        index = ship(spark, Index((r.item, r.text) for r in rows))
        out = out.select(*names).mapInArrow(_pass(index, text), schema)
    return out.withColumnRenamed("__items", "items").drop("__bits")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return (
        f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), "
        r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )


def sql(documents: str = "documents") -> str:
    """One row per document with its hits, in DuckDB."""
    return f"""
    WITH dw AS (SELECT doc_id, {_words('text')} AS w FROM {documents}),
    iw AS (
        SELECT item_id, w, least(len(w), {WINDOW}) AS k
        FROM (SELECT item_id, {_words('text')} AS w FROM benchmark) WHERE len(w) > 0
    ), ig AS (
        SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
        FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM iw)
    ), dg AS (
        SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (
            SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i
            FROM dw, (SELECT DISTINCT k FROM ig) WHERE len(w) >= k)
    ), found AS (SELECT doc_id, k, i, item_id FROM dg JOIN ig USING (k, g)),
    words AS (
        SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id
    ), items AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
        coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AS contaminated
    FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


QUERIES = {"op7_decontamination": op7_decontamination}
ORACLE = {"op7_decontamination": sql()}
