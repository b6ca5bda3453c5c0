"""Contiguous row numbers without a global window, at any distribution of the keys.

A row's number is its place in its file, split or sorted part plus the rows of those before, so
the only unpartitioned step is a running sum over one row per file, split or part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.session import COMPACT, scratch_path, staged

# Tables of files or splits up to this size (some 20 MB) are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000


def running_offsets(sizes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``__offset``, the ``__rows`` of all rows before. ``sizes`` has one row per file, file
    split or sorted part: the only table that a single task sees whole."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("__offset", F.coalesce(F.sum("__rows").over(before), F.lit(0)))


def with_small_table(rows: DataFrame, small: DataFrame, keys: Sequence[str],
                     in_order: bool = False) -> DataFrame:
    """Join a stored table of one row per file, split or part.

    It is broadcast up to BROADCAST_ROWS rows and shuffled beyond. ``in_order`` keeps each key's
    rows together and in the order in which they are read.
    """
    if small.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), list(keys))
    if not in_order:
        return rows.join(small, list(keys))
    placed = rows.withColumn("__at", F.monotonically_increasing_id())
    return (
        placed.join(small.hint("merge"), list(keys)).repartition(*keys)
        .sortWithinPartitions(*keys, "__at").drop("__at")
    )


def with_numbers(rows: DataFrame, numbers: DataFrame, key: str, number: str) -> DataFrame:
    """``rows.join(numbers, key)`` for a stored table that numbers keys in their order, without gaps.

    Wide rows are not shuffled for it: 64 keys in a row become one bit mask with the number of the
    first, and these are joined as a small table. Repeated keys are joined as they are.
    """
    chunk = F.shiftright(key, 6).alias("__chunk")
    bits = F.expr(f"bit_or(shiftleft(1L, cast(`{key}` & 63 AS int)))")
    packed = staged(
        numbers.filter(F.col(key).isNotNull()).groupBy(chunk)
        .agg(bits.alias("__mask"), F.min(number).alias("__first"), F.count(F.lit(1)).alias("__rows")),
        "packed",
    )
    if not packed.filter(F.col("__rows") != F.bit_count("__mask")).isEmpty():
        return rows.join(numbers, key)
    before = F.expr(f"~shiftleft(-1L, cast(`{key}` & 63 AS int))")
    place = F.bit_count(F.col("__mask").bitwiseAND(before))
    joined = with_small_table(rows.withColumn("__chunk", F.shiftright(key, 6)), packed.drop("__rows"), ["__chunk"])
    return (
        joined.filter(F.expr(f"shiftright(`__mask`, cast(`{key}` & 63 AS int)) & 1") == 1)
        .withColumn(number, F.col("__first") + place)
        .drop("__chunk", "__mask", "__first")
    )


def index_by_key(df: DataFrame, key: str, out: str, start: int = 0) -> DataFrame:
    """Number rows in the order of a unique key, whatever its values are."""
    return index_by_order(df, [F.col(key)], out, start)


def number_parquet_rows(df: DataFrame, out: str, start: int = 0) -> DataFrame:
    """Number the rows of Parquet files, in file name and file order, without rewriting them.

    ``df`` must be a direct file read: the format knows each row's place in its file.
    """
    rows = df.select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    sizes = rows.groupBy("__file").agg(F.count(F.lit(1)).alias("__rows"))
    offsets = staged(running_offsets(sizes, ["__file"]).drop("__rows"), "files")
    return (
        with_small_table(rows, offsets, ["__file"])
        .withColumn(out, (F.col("__offset") + F.col("__row") + start).cast("long"))
        .drop("__file", "__row", "__offset")
    )


def number_file_rows(df: DataFrame, out: str, start: int = 0, generate: Column | None = None,
                     generated: str = "value") -> DataFrame:
    """Number the rows of a file or of a folder of files, in file name and file order.

    ``df`` must be a direct file read. It is stored once as Parquet with the position of each
    row in its input split (``monotonically_increasing_id`` grows by one within a split). All
    later steps use the stored positions, so a re-read with other splits cannot shift them.
    ``generate`` may explode one column into several rows first.
    """
    rows = df.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__split"),
    )
    if generate is not None:
        rows = rows.withColumn(generated, generate)
    rows = staged(rows.withColumn("__id", F.monotonically_increasing_id()), "rows")
    # One small row per input split, stored so that its size is known before it is joined.
    splits = staged(
        rows.groupBy("__file", "__split").agg(
            F.count(F.lit(1)).alias("__rows"), F.min("__id").alias("__first")
        ),
        "splits",
    )
    offsets = staged(running_offsets(splits, ["__file", "__split"]).drop("__rows"), "offsets")
    number = F.col("__id") - F.col("__first") + F.col("__offset") + start
    return (
        with_small_table(rows, offsets, ["__file", "__split"])
        .withColumn(out, number.cast("long"))
        .drop("__id", "__first", "__offset", "__split", "__file")
    )


def index_by_order(df: DataFrame, order: Sequence[Column], out: str, start: int = 0) -> DataFrame:
    """Number rows in a global sort order.

    The sort is written once to the shared folder. Its files are consecutive key ranges, so a
    row's number is its position in its file plus the rows of the files before it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "sorted")
    df.sort(*order).write.options(**COMPACT).parquet(path)
    name = F.col("_metadata.file_name")
    rows = (
        spark.read.schema(df.schema)
        .parquet(path)
        .select(
            "*",
            F.regexp_extract(name, r"^part-(\d+)", 1).cast("int").alias("__part"),
            F.regexp_extract(name, r"-c(\d+)\.", 1).cast("int").alias("__chunk"),
            F.col("_metadata.row_index").alias("__row"),
        )
    )
    sizes = rows.groupBy("__part", "__chunk").agg(F.count(F.lit(1)).alias("__rows"))
    offsets = staged(running_offsets(sizes, ["__part", "__chunk"]).drop("__rows"), "offsets")
    return (
        with_small_table(rows, offsets, ["__part", "__chunk"])
        .withColumn(out, (F.col("__offset") + F.col("__row") + start).cast("long"))
        .drop("__part", "__chunk", "__row", "__offset")
    )
