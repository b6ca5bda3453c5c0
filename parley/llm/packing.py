"""Packing of tokenised documents into sequences by the sum-of-squares rule.

With N(g) open sequences of gap g, a piece of length s goes into a sequence of the gap g >= s
that makes the sum of N(g)**2 smallest. A new sequence is begun only where no open one fits:
taken as one more choice of the rule it left 1.5 % more sequences. Pieces as long as a
sequence are sequences of their own. The others are packed in groups of bounded size, each in
one task; a group leaves few sequences open, so grouping costs next to nothing.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import stored, table

CAPACITY = 1024
END_ID = 2
# Pieces that one task packs (some 10 MB).
GROUP_PIECES = 150_000

PIECES = "piece int, start long, length long, ids_crc32 long"


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, in the given order, and the number of sequences.

    Of equally good places the smallest gap wins, of sequences of one gap the latest.
    """
    counts = np.zeros(capacity + 1, np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    used = 0
    for i, size in enumerate(lengths.tolist()):
        # Moving a sequence from gap g to g - size changes the sum by 2 (N(g-size) - N(g)) + 2;
        # a closed one (gap 0) no longer counts.
        change = 2 * (counts[: capacity + 1 - size] - counts[size:]) + 2
        change[0] = 1 - 2 * counts[size]
        change[counts[size:] == 0] = np.iinfo(np.int64).max
        gap = size + int(np.argmin(change))
        if not counts[gap]:
            gap = capacity
        if gap == capacity:
            place, used = used, used + 1
        else:
            place = open_[gap].pop()
            counts[gap] -= 1
        sequence[i], offset[i] = place, capacity - gap
        if gap > size:
            open_[gap - size].append(place)
            counts[gap - size] += 1
    return sequence, offset, used


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of n ids: only the first may be short."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


class Tokens:
    """Ids of the byte-level BPE: the same vocabulary as ranks, read by the faster library.

    Texts that hold the special token's string go through the file's own tokenizer, which
    treats that string as one id, and so do texts on which the faster library gives up: its
    pattern runs out of stack on some million blanks or line feeds in a row.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.special = "<|endoftext|>"
        self.fast = tiktoken.Encoding(
            "bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(path)

    def of(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self.special not in text:
            try:
                ids = self.fast.encode_to_numpy(text, disallowed_special=())
                return ids.astype(np.uint32, copy=False)
            except Exception:  # whatever stops it, the file's own tokenizer decides
                pass
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


def token_pieces(
    df: DataFrame, id_column: str, text: str, tokenizer: str, capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``, one row per piece of a document.

    ``tokenizer`` is the path of the vocabulary on every worker. Null and empty texts are the
    end id alone.
    """
    kind = dict(df.dtypes)[id_column]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(tokenizer)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            rows: list[int] = []
            columns: tuple[list, ...] = ([], [], [], [])
            for row, value in enumerate(batch.column(1).to_pylist()):
                ids = np.concatenate([tokens.of(value), end])
                for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                    crc = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
                    rows.append(row)
                    for column, item in zip(columns, (piece, start, length, crc)):
                        column.append(item)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())),
                 *(pa.array(c, k) for c, k in zip(columns, kinds))],
                [batch.schema.names[0], "piece", "start", "length", "ids_crc32"],
            )

    return df.select(id_column, text).mapInArrow(cut, f"`{id_column}` {kind}, {PIECES}")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY,
                group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (long) to rows with a ``length`` of 1 to capacity.

    The rows are stored first with a number each, so a lost task cannot number them anew.
    Groups are dealt by that number: equal rows spread evenly. Within a group longer pieces
    come first. Extra columns are kept, an empty table stays empty.
    """
    numbered = stored(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    full = F.col("length") == capacity
    whole = numbered.filter(full).select(
        pieces.columns + [(-1 - F.col("__row")).alias("sequence_id"),
                          F.lit(0).cast("long").alias("offset")])
    short = numbered.filter(~full)
    groups = max(1, -(-short.count() // group_pieces))
    names = [*pieces.columns, "sequence_id", "offset"]

    def place(rows: pa.Table) -> pa.Table:
        order = np.lexsort((rows["__row"].to_numpy(), -rows["length"].to_numpy()))
        rows = rows.take(pa.array(order))
        group = rows["__group"][0].as_py()
        sequence, offset, _ = pack(rows["length"].to_numpy(), capacity)
        rows = rows.append_column("sequence_id", pa.array(sequence + (group << 40)))
        return rows.append_column("offset", pa.array(offset)).select(names)

    packed = (
        short.withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups)).cast("long"))
        .groupBy("__group").applyInArrow(place, whole.schema)
    )
    return whole.unionByName(packed)


def best_fit_packing(
    df: DataFrame, id_column: str, text: str, tokenizer: str, capacity: int = CAPACITY,
    end_id: int = END_ID, group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Every document's pieces with their places; see ``token_pieces`` and ``pack_pieces``.

    Ids may be null or repeated: each row is packed for itself. Other columns are not carried.
    """
    pieces = token_pieces(df, id_column, text, tokenizer, capacity, end_id)
    return pack_pieces(pieces, capacity, group_pieces)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return best_fit_packing(docs, "doc_id", "text", tokenizer_path())


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
ORACLE: dict[str, str] = {}
