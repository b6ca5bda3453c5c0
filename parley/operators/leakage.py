"""Texts shared between splits."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.errors import ValidationError

EXAMPLES = 10


def split_hash_overlap(
    df: DataFrame, splits: Sequence[str], hash_columns: Sequence[str] = ("text_hash_raw", "text_hash_normalized")
) -> DataFrame:
    """Per hash kind and pair of splits: shared hashes, and the ten smallest as examples.

    A hash is reduced to a bit mask of its splits in one aggregation with partial sums. Pairs
    without overlap are listed with zero.
    """
    names = sorted(splits)
    bit = F.lit(0)
    for i, name in enumerate(names):
        bit = F.when(F.col("split") == name, F.lit(1 << i).cast("long")).otherwise(bit)
    tall = df.select(
        bit.cast("long").alias("bit"),
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("hash")) for c in hash_columns])
        ).alias("h"),
    ).filter(F.col("h.hash").isNotNull())
    masks = tall.groupBy("h.kind", "h.hash").agg(F.bit_or("bit").alias("mask"))
    pairs = [(f"{names[i]}__{names[j]}", (1 << i) | (1 << j)) for i, j in combinations(range(len(names)), 2)]
    hits = masks.filter(F.bit_count("mask") > 1).select(
        "kind",
        "hash",
        F.explode(
            F.filter(
                F.array(*[F.struct(F.lit(p).alias("pair"), F.lit(m).alias("need")) for p, m in pairs]),
                lambda x: F.col("mask").bitwiseAND(x["need"]) == x["need"],
            )
        ).alias("p"),
    ).select("kind", F.col("p.pair").alias("pair"), "hash")
    counts = hits.groupBy("kind", "pair").agg(F.count(F.lit(1)).alias("overlap_count"))
    # The rank limit is applied per task before the shuffle.
    rank = F.row_number().over(Window.partitionBy("kind", "pair").orderBy("hash"))
    examples = (
        hits.withColumn("__r", rank)
        .filter(F.col("__r") <= EXAMPLES)
        .groupBy("kind", "pair")
        .agg(F.array_sort(F.collect_list("hash")).alias("example_hashes"))
    )
    # One row per kind and pair of splits.
    wanted = df.sparkSession.createDataFrame(
        [(c, p) for c in hash_columns for p, _ in pairs], "kind string, pair string"
    )
    return (
        wanted.join(counts, ["kind", "pair"], "left")
        .join(examples, ["kind", "pair"], "left")
        .select(
            "kind",
            "pair",
            F.coalesce("overlap_count", F.lit(0).cast("long")).alias("overlap_count"),
            F.coalesce("example_hashes", F.array().cast("array<string>")).alias("example_hashes"),
        )
    )


def _finding(overlaps: DataFrame) -> Column:
    """The overlapping pairs as one text, a scalar subquery; empty if there are none."""
    listed = F.concat_ws(" ", "kind", F.concat("pair", F.lit(":")), F.col("overlap_count").cast("string"))
    return overlaps.filter(F.col("overlap_count") > 0).agg(
        F.array_join(F.array_sort(F.collect_list(listed)), ", ").alias("found")).scalar()


def gated(df: DataFrame, overlaps: DataFrame, source: str) -> DataFrame:
    """``df`` with the gate in its plan: whatever reads it fails if a pair overlaps.

    ``overlaps`` has one row per kind and pair and should be a stored table.
    """
    found = _finding(overlaps)
    message = F.concat(F.lit(f"{source} leakage detected by hash overlap: "), found, F.lit("."))
    return df.filter(F.when(found != "", F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def leakage_warnings(overlaps: DataFrame, source: str) -> DataFrame:
    """``(message)``: one row that lists the overlapping pairs, if there are any."""
    found = overlaps.sparkSession.range(1).select(_finding(overlaps).alias("found"))
    return found.filter("found <> ''").select(
        F.concat(F.lit(f"{source} leakage detected by hash overlap: "), "found", F.lit(".")).alias("message"))


def leakage_gate(overlaps: DataFrame, source: str, strict: bool = True) -> list[str]:
    """Warnings for overlapping pairs; an error when strict."""
    messages = [r["message"] for r in leakage_warnings(overlaps, source).collect()]
    if messages and strict:
        raise ValidationError(messages[0])
    return messages


def pool_external_overlap(
    left: DataFrame, right: DataFrame, hash_column: str = "text_hash_normalized"
) -> DataFrame:
    """Hashes that occur in both tables."""
    return left.select(hash_column).intersect(right.select(hash_column))


def overlap_report(overlap: DataFrame, hash_column: str = "text_hash_normalized") -> DataFrame:
    """Count and ten examples of an overlap, as one row."""
    examples = overlap.orderBy(hash_column).limit(EXAMPLES).select(
        F.lit(0).cast("long").alias("n"), F.col(hash_column).alias("hash")
    )
    count = overlap.agg(F.count(F.lit(1)).alias("n")).withColumn("hash", F.lit(None).cast("string"))
    # At most eleven rows.
    return count.unionByName(examples).agg(
        F.sum("n").alias("overlap_count"),
        F.array_sort(F.collect_list("hash")).alias("example_hashes"),
    )


def pool_external_gate(report: DataFrame, source: str, strict: bool = True) -> list[str]:
    """The warning for texts shared by the pool and the external test; an error when strict."""
    row = report.first()
    if not row["overlap_count"]:
        return []
    message = (
        f"{source}: {row['overlap_count']} normalised texts of the augmentation pool are in the "
        f"external test as well, among them {', '.join(row['example_hashes'][:3])}.")
    if strict:
        raise ValidationError(message)
    return [message]
