"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered once in a total order. A keyed permutation of ``0 .. n-1`` then gives each
row a place; ``place mod shards`` is its shard and ``place div shards`` its slot, so any row's
shard and slot follow from its number, the row count and the seed alone.

The permutation is a Feistel network over a grid of ``a x b`` cells, the smallest near-square
grid that holds n. Cells beyond n are left by cycle walking: the network is applied again
until the value is below n. How many steps the longest walk needs is found beforehand from
the fewer than ``sqrt(n) + 1`` surplus cells, so the expression for rows is exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import any_names, table
from parley.operators.rowindex import index_by_order

ROUNDS = 6
SEED = 20_240_607
SHARDS = 16
_LOW31 = (1 << 31) - 1


def round_keys(seed: int) -> list[tuple[int, int, int, int]]:
    """Per round two odd multipliers and two offsets below 2**30, from a linear recurrence."""
    state, keys = seed & _LOW31, []
    for _ in range(ROUNDS):
        values = []
        for _ in range(4):
            state = (state * 48271 + 11) % _LOW31
            values.append(state >> 1)
        m1, c1, m2, c2 = values
        keys.append((m1 | 1, c1, m2 | 1, c2))
    return keys


def grid(n: int) -> tuple[int, int]:
    """Sides of the grid: ``n <= a * b < n + a``."""
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, max(1, -(-n // a))


def network_sql(x: str, a: int, b: int, seed: int) -> str:
    """One pass of the network over the cells ``0 .. a*b-1``, as a Spark SQL expression."""
    keys = ", ".join(
        f"named_struct('left', {str(i % 2 == 0).lower()}, "
        f"'m1', {m1}L, 'c1', {c1}L, 'm2', {m2}L, 'c2', {c2}L)"
        for i, (m1, c1, m2, c2) in enumerate(round_keys(seed))
    )

    def low(value: str) -> str:
        return f"(({value}) ^ shiftright({value}, 29)) & {_LOW31}L"

    def mix(half: str) -> str:
        first = low(f"({half}) * k.m1 + k.c1")
        return low(f"({first}) * k.m2 + k.c2")

    return f"""aggregate(array({keys}),
        named_struct('l', ({x}) % {a}L, 'r', ({x}) div {a}L),
        (p, k) -> if(k.left,
            named_struct('l', (p.l + ({mix('p.r')})) % {a}L, 'r', p.r),
            named_struct('l', p.l, 'r', (p.r + ({mix('p.l')})) % {b}L)),
        p -> p.l + p.r * {a}L)"""


def longest_walk(spark: SparkSession, n: int, seed: int) -> int:
    """Most further passes that any surplus cell needs to fall below n."""
    a, b = grid(n)
    outside = spark.range(n, a * b).withColumnRenamed("id", "x")
    steps = 0
    while not outside.isEmpty():
        steps += 1
        outside = outside.selectExpr(f"{network_sql('x', a, b, seed)} AS x").filter(f"x >= {n}")
    return steps


def place_sql(row: str, n: int, steps: int, seed: int) -> str:
    """The place of a row number under the permutation of ``0 .. n-1``."""
    a, b = grid(n)
    first = network_sql(row, a, b, seed)
    if not steps:
        return first
    again = network_sql("x", a, b, seed)
    return f"aggregate(sequence(1, {steps}), {first}, (x, i) -> if(x < {n}L, x, {again}))"


@any_names("row", "shard", "slot", columns=("order",))
def shard_rows(
    df: DataFrame, order: Sequence[str], shards: int = SHARDS, seed: int = SEED
) -> DataFrame:
    """Add ``row``, ``shard`` and ``slot``; shard sizes differ by one row at most.

    ``order`` names the columns that fix the row order, nulls first. Rows equal in all of them
    are numbered in any order among themselves, so pass what tells rows apart; select narrow
    columns, as every column of ``df`` is sorted. An empty table gives an empty result. The
    columns named as the added ones are replaced.
    """
    spark = df.sparkSession
    # The last sort column spreads a large group of equal rows over range partitions.
    rows = df.withColumn("__tie", F.xxhash64(F.monotonically_increasing_id()))
    numbered = index_by_order(rows, [F.col(c).asc_nulls_first() for c in (*order, "__tie")], "row")
    numbered = numbered.drop("__tie")
    n = numbered.count()
    place = place_sql("row", n, longest_walk(spark, n, seed), seed) if n else "0L"
    return (
        numbered.withColumn("__place", F.expr(place))
        .withColumn("shard", (F.col("__place") % shards).cast("int"))
        .withColumn("slot", F.expr(f"__place div {shards}L"))
        .drop("__place")
    )


def write_shards(df: DataFrame, order: Sequence[str], path: str, shards: int = SHARDS,
                 seed: int = SEED) -> None:
    """Write whole rows into one folder per shard, each sorted by slot within its files."""
    rows = shard_rows(df, order, shards, seed)
    (
        rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard").parquet(path)
    )


def op1_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law ``rows``.

    A null text has size 1 and the CRC of no bytes; a null id sorts first.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shard_rows(docs, ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _duckdb_network(source: str, x: str) -> str:
    """The same pass in DuckDB: one nested query per half and round."""

    def low(value: str) -> str:
        return f"(xor({value}, ({value}) >> 29) & {_LOW31})"

    query = f"SELECT row, n, a, b, {x} % a AS l, {x} // a AS r FROM {source}"
    for i, (m1, c1, m2, c2) in enumerate(round_keys(SEED)):
        half = "r" if i % 2 == 0 else "l"
        first = low(f"{half} * {m1} + {c1}")
        query = f"SELECT *, {first} AS f FROM ({query})"
        mixed = low(f"f * {m2} + {c2}")
        sides = f"(l + {mixed}) % a AS l, r" if i % 2 == 0 else f"l, (r + {mixed}) % b AS r"
        query = f"SELECT row, n, a, b, {sides} FROM ({query})"
    return f"SELECT row, n, a, b, l + r * a AS x FROM ({query})"


# DuckDB has no CRC: it is folded over the bytes in hexadecimal form, eight bit steps each.
_BIT = "xor(v >> 1, 3988292384 * (v & 1))"
_CRC = f"""xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(
        regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, o: list_reduce([xor(c, o), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: {_BIT})))"""

SQL = f"""
WITH RECURSIVE sized AS MATERIALIZED (
    SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
        {_CRC} AS text_crc32
    FROM documents
), numbered AS (
    SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row,
        count(*) OVER () AS n
    FROM sized
), grid AS (
    SELECT row, n, floor(sqrt(n - 1))::BIGINT + 1 AS a,
        (n + floor(sqrt(n - 1))::BIGINT) // (floor(sqrt(n - 1))::BIGINT + 1) AS b
    FROM numbered
), walk AS (
    {_duckdb_network("grid", "row")}
    UNION ALL
    {_duckdb_network("(SELECT * FROM walk WHERE x >= n)", "x")}
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (x % {SHARDS})::INTEGER AS shard,
    x // {SHARDS} AS slot, NULL::INTEGER AS grown_shard
FROM numbered JOIN walk USING (row) WHERE x < walk.n
"""

QUERIES = {"op1_feistel_shards": op1_feistel_shards}
ORACLE = {"op1_feistel_shards": SQL}
