"""Helpers shared by the training-data operators.

Rows are recognised by a 128-bit key over the columns that decide their result, never by an
id alone: ids may be null or repeated, and equal rows have equal results.
"""

from __future__ import annotations

import functools
import inspect
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.session import staged

# Words: runs of bytes other than space, tab, LF, VT, FF and CR.
BLANKS = r"[\x20\x09-\x0D]+"
# Most words that one worker remembers something about (some 60 MB).
MEMO_WORDS = 400_000
# Bytes of a long text that are hashed at a time.
PART_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*columns: str) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the columns; never null."""
    return (
        F.xxhash64(*columns).alias("__k1"),
        F.xxhash64(F.lit("second key"), *columns).alias("__k2"),
    )


def crc32_of_id(column: str) -> Column:
    """CRC-32 of an id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def unused(df: DataFrame, name: str) -> str:
    """The name, or a longer one where ``df`` has it (names differ by more than case)."""
    taken = {n.lower() for n in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# Plain names that operators use inside, beside those that begin with an underscore.
_INSIDE = frozenset("id node text_key first block item component batch chunk rank size column".split())


def any_names(*added: str, columns: Sequence[str], keyed: str | None = None):
    """Let the first table of an operator have columns of any names.

    ``added`` are the names of the result's columns: columns of the caller that have one of them
    (in any case) give way. ``columns`` are the operator's arguments that name columns, and
    ``keyed`` is one that is another table with the first of them. The operator sees numbered
    names in place of those that would clash, and the caller's come back in the result.
    """
    results = {n.lower() for n in added}

    def clashes(name: str) -> bool:
        return name.lower() in results or name.lower() in _INSIDE or name.startswith("_")

    def wrap(operator):
        signature = inspect.signature(operator)

        @functools.wraps(operator)
        def run(df: DataFrame, *args, **kwargs) -> DataFrame:
            names = df.columns
            if not any(map(clashes, names)):
                return operator(df, *args, **kwargs)
            inner = {n: unused(df, f"column{i}") if clashes(n) else n for i, n in enumerate(names)}
            bound = signature.bind(df, *args, **kwargs)
            if keyed:
                key = bound.arguments[columns[0]]
                bound.arguments[keyed] = bound.arguments[keyed].withColumnRenamed(key, inner[key])
            for argument in columns:
                if isinstance(value := bound.arguments.get(argument), str):
                    bound.arguments[argument] = inner[value]
                elif value is not None:
                    bound.arguments[argument] = [inner[v] for v in value]
            out = operator(df.toDF(*inner.values()), *bound.args[1:], **bound.kwargs)
            kept = [F.col(inner[n]).alias(n) for n in names if n.lower() not in results and inner[n] in out.columns]
            return out.select(*kept, *(n for n in added if n in out.columns))

        return run

    return wrap


def words_of(text: str | None) -> list[bytes]:
    """Blank-separated words in UTF-8; none for a null text."""
    return utf8(text).split()


class Words:
    """64-bit hashes of the blank-separated words of a text, without a Python object per word.

    A word's hash is a polynomial of its bytes, taken from running sums over the text, mixed
    with its length.
    """

    def __init__(self) -> None:
        self.powers = Powers()
        self.blank = np.zeros(256, bool)
        self.blank[[0x20, *range(0x09, 0x0E)]] = True

    def of(self, data: bytes) -> np.ndarray:
        if not data:
            return np.empty(0, np.uint64)
        text = np.frombuffer(data, np.uint8)
        word = np.zeros(len(text) + 2, bool)
        np.logical_not(self.blank[text], out=word[1:-1])
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edges[::2], edges[1::2]
        out = np.empty(len(starts), np.uint64)
        first = 0
        while first < len(starts):
            # Long texts are hashed in parts that end with a word.
            low = starts[first]
            last = max(first + 1, int(np.searchsorted(ends, low + PART_BYTES, side="right")))
            begin, end = starts[first:last] - low, ends[first:last] - low
            power, inverse = self.powers.upto(int(end[-1]))
            sums = np.zeros(end[-1] + 1, np.uint64)
            np.cumsum((text[low : low + end[-1]] + np.uint64(1)) * power, out=sums[1:])
            length = (end - begin).astype(np.uint64)
            out[first:last] = mixed(
                (sums[end] - sums[begin]) * inverse[begin] + length * np.uint64(0xD6E8FEB86659FD93))
            first = last
        return out


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


class Powers:
    """Powers of an odd constant and of its inverse modulo 2**64."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.power) < n:
            size = max(n, 2 * len(self.power), 4096)
            self.power = np.cumprod(np.full(size, _ODD, np.uint64)) * _ODD_INVERSE
            self.inverse = np.cumprod(np.full(size, _ODD_INVERSE, np.uint64)) * _ODD
        return self.power[:n], self.inverse[:n]


class Windows:
    """Hashes of all runs of k consecutive values, in constant time per run."""

    def __init__(self) -> None:
        self.powers = Powers()

    def of(self, values: np.ndarray, k: int) -> np.ndarray:
        n = len(values) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        power, inverse = self.powers.upto(len(values))
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power, out=sums[1:])
        return mixed((sums[k:] - sums[:n]) * inverse[:n])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the public SplitMix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions lie in a run of ``length`` that begins at one of the starts."""
    edges = np.zeros(n + length + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + length, -1)
    return np.cumsum(edges)[:n] > 0


def chunks(table_: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """The parts of a table that hold anything, with their numbers."""
    for number in range(0, len(table_), size):
        part = table_[number : number + size]
        if part.any():
            yield number // size, part


def merged_chunks(parts: DataFrame, dtype: str, out: str, limit: int) -> DataFrame:
    """Add up equal chunks: ``(chunk int, data binary)`` rows of one per task and chunk.

    Each task holds its own chunks only and reads the rest as a stream. Sums stop at ``limit``.
    """
    source, target = np.dtype(dtype), np.dtype(out)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data")):
                part = np.frombuffer(data.as_buffer(), source).astype(np.int64)
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        for chunk, total in sums.items():
            blob = np.minimum(total, limit).astype(target).tobytes()
            yield pa.RecordBatch.from_pydict(
                {"chunk": pa.array([chunk], pa.int32()), "data": pa.array([blob], pa.binary())}
            )

    return parts.repartition("chunk").mapInArrow(add, "chunk int, data binary")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """A table in the shared folder; see ``parley.session.staged``."""
    return staged(df, f"llm-{name}", options=options)


def ship(spark: SparkSession, value) -> Broadcast:
    """Broadcast a value of bounded size, its classes included; see ``received``."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shipped: Broadcast):
    return cloudpickle.loads(shipped.value)
