"""Exact, reproducible stratified splits and samples.

Every row gets a hash key from the seed and its id. A part takes the rows with the smallest
keys of each class. The largest key taken (the cut) is found by narrowing the key range digit
by digit on class histograms, so no class is ever sorted or gathered as a whole, and the final
assignment is a comparison inside a narrow projection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.rowindex import index_by_order
from parley.session import staged
from parley.settings import PrepSettings

# Hex digits fixed per narrowing pass and in a whole key, and the class size at which ranking
# takes over.
_DIGITS = 3
_KEY_DIGITS = 64
_RANKABLE = 20_000


def order_key(seed: int, id_column: str = "sample_id") -> Column:
    """A seeded pseudo-random order that does not depend on partitioning."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), F.col(id_column).cast("string")), 256)


def part_sizes(n: int, share: float) -> tuple[int, int]:
    """``(rest, part)`` with the part rounded up."""
    part = math.ceil(share * n)
    return n - part, part


def class_quotas(counts: dict, draws: int) -> dict:
    """Split ``draws`` over the classes in proportion, by largest remainder."""
    total = sum(counts.values())
    exact = {c: counts[c] * draws / total for c in counts}
    quotas = {c: math.floor(exact[c]) for c in counts}
    missing = draws - sum(quotas.values())
    by_remainder = sorted(counts, key=lambda c: (-(exact[c] - quotas[c]), c))
    for c in by_remainder[:missing]:
        quotas[c] += 1
    return quotas


def _in_prefix(strata: Column, key: Column, prefixes: dict) -> Column:
    tests = [(strata == c) & key.startswith(p) for c, p in prefixes.items()]
    return reduce(or_, tests, F.lit(False))


def _repeated(stratum, wanted: int, equal: int) -> ValueError:
    return ValueError(
        f"{equal} rows of class {stratum!r} share one id, and a part would take {wanted} of them: "
        "ids must be unique")


def key_cuts(df: DataFrame, strata: str, key: str, takes: dict, counts: dict) -> dict:
    """Per class, the ``takes[c]``-th smallest key.

    Only histograms with at most 4096 cells per class and one key per class reach the driver.
    Rows of equal keys are taken all or none; a cut that would divide them is an error.
    """
    cuts = {c: "" for c, k in takes.items() if k == 0}
    left = {c: k for c, k in takes.items() if k > 0}
    prefixes = {c: "" for c in left}
    sizes = {c: counts[c] for c in left}
    label, value = F.col(strata), F.col(key)
    while any(sizes[c] > _RANKABLE for c in left):
        depth = min(len(next(iter(prefixes.values()))) + _DIGITS, _KEY_DIGITS)
        cells = (
            df.filter(_in_prefix(label, value, prefixes))
            .groupBy(label.alias("c"), F.substring(value, 1, depth).alias("p"))
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()
        )
        for c in list(left):
            for cell in sorted((x for x in cells if x["c"] == c), key=lambda x: x["p"]):
                if left[c] <= cell["n"]:
                    prefixes[c], sizes[c] = cell["p"], cell["n"]
                    break
                left[c] -= cell["n"]
        if depth == _KEY_DIGITS:  # each cell is one key
            for c in list(left):
                if left[c] < sizes[c]:
                    raise _repeated(c, left[c], sizes[c])
                cuts[c] = prefixes[c]
            return cuts
    if left:
        rank = F.row_number().over(Window.partitionBy(strata).orderBy(key))
        at_cut = reduce(or_, [(label == c) & (F.col("__r") == k) for c, k in left.items()])
        equal = Window.partitionBy(strata, key)
        found = (
            df.filter(_in_prefix(label, value, prefixes))
            .select(strata, key)
            .withColumn("__r", rank)
            .withColumns({"__n": F.count(F.lit(1)).over(equal), "__last": F.max("__r").over(equal)})
            .filter(at_cut)
            .collect()
        )
        for row in found:
            if row["__last"] > row["__r"]:
                raise _repeated(row[strata], row["__n"] - row["__last"] + row["__r"], row["__n"])
            cuts[row[strata]] = row[key]
    return cuts


def _at_most(strata: str, key: Column, cuts: dict) -> Column:
    tests = [(F.col(strata) == c) & (key <= cut) for c, cut in cuts.items() if cut]
    return reduce(or_, tests, F.lit(False))


def _class_counts(df: DataFrame, strata: str) -> dict:
    return {r[0]: r[1] for r in df.groupBy(strata).count().collect()}


def _check(counts: dict, *parts: int) -> None:
    if None in counts:
        raise ValueError(f"{counts[None]} rows have no class to stratify by")
    if any(n < 2 for n in counts.values()):
        raise ValueError(f"every class needs at least 2 rows, found {counts}")
    if any(p < len(counts) for p in parts):
        raise ValueError(f"each part needs at least one row per class, sizes {parts}")


def _stage(slim: DataFrame, strata: str, share: float, seed: int, id_column: str, counts: dict):
    """The condition selecting one stratified part, and the class counts of the rest."""
    rest, part = part_sizes(sum(counts.values()), share)
    _check(counts, rest, part)
    rest_quota = class_quotas(counts, rest)
    takes = {c: counts[c] - rest_quota[c] for c in counts}
    keyed = slim.withColumn("__key", order_key(seed, id_column))
    cuts = key_cuts(keyed, strata, "__key", takes, counts)
    return _at_most(strata, order_key(seed, id_column), cuts), rest_quota


def split3_column(
    slim: DataFrame,
    test_size: float = PrepSettings.test_size,
    val_size: float = PrepSettings.val_size,
    seed: int = PrepSettings.seed,
    strata: str = "binary_label",
    id_column: str = "sample_id",
) -> Column:
    """The ``split`` of :func:`stratified_split3`, found from classes and ids."""
    is_test, rest = _stage(slim, strata, test_size, seed, id_column, _class_counts(slim, strata))
    relative = val_size / (1.0 - test_size)
    is_val, _ = _stage(slim.filter(~is_test), strata, relative, seed + 1, id_column, rest)
    return F.when(is_test, "test").when(is_val, "val").otherwise("train")


def stratified_split3(
    df: DataFrame,
    test_size: float = PrepSettings.test_size,
    val_size: float = PrepSettings.val_size,
    seed: int = PrepSettings.seed,
    strata: str = "binary_label",
    id_column: str = "sample_id",
) -> DataFrame:
    """Add ``split`` (train, val, test): test is drawn first, then val from what is left.

    ``df`` should be a stored table: only its class and id columns are read before the final
    projection.
    """
    slim = df.select(strata, id_column)
    return df.withColumn("split", split3_column(slim, test_size, val_size, seed, strata, id_column))


def split2_column(
    slim: DataFrame,
    external_size: float = PrepSettings.external_size,
    seed: int = PrepSettings.seed + 2,
    strata: str = "binary_label",
    id_column: str = "sample_id",
) -> Column:
    """The ``split`` of :func:`stratified_split2`, found from classes and ids."""
    external, _ = _stage(slim, strata, external_size, seed, id_column, _class_counts(slim, strata))
    return F.when(external, "external_test").otherwise("aug_pool")


def stratified_split2(
    df: DataFrame,
    external_size: float = PrepSettings.external_size,
    seed: int = PrepSettings.seed + 2,
    strata: str = "binary_label",
    id_column: str = "sample_id",
) -> DataFrame:
    """Add ``split`` (aug_pool, external_test)."""
    slim = df.select(strata, id_column)
    return df.withColumn("split", split2_column(slim, external_size, seed, strata, id_column))


def capped_condition(
    df: DataFrame, rows: int, seed: int = PrepSettings.seed + 4, id_column: str = "sample_id"
) -> Column:
    """What the rows of :func:`capped_sample` fulfil, and no other row of ``df``."""
    keyed = df.select(id_column).withColumns(
        {"__all": F.lit(0), "__key": order_key(seed, id_column)}
    )
    total = keyed.count()
    if rows >= total:
        return F.lit(True)
    cuts = key_cuts(keyed, "__all", "__key", {0: rows}, {0: total})
    return order_key(seed, id_column) <= cuts[0]


def capped_sample(
    df: DataFrame, rows: int, seed: int = PrepSettings.seed + 4, id_column: str = "sample_id"
) -> DataFrame:
    """Exactly ``min(rows, count)`` rows without replacement."""
    return df.filter(capped_condition(df, rows, seed, id_column))


def split_summary(
    df: DataFrame, method: str, seeds: Sequence[int], targets: dict[str, float],
    strata: str = "binary_label",
) -> DataFrame:
    """Rows per split next to how the split was made."""
    target = F.lit(None).cast("double")
    for name, share in targets.items():
        target = F.when(F.col("split") == name, F.lit(float(share))).otherwise(target)
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows")).select(
        "split",
        "rows",
        target.alias("target_ratio"),
        F.lit(method).alias("method"),
        F.lit(strata).alias("stratify_column"),
        F.lit(",".join(str(s) for s in seeds)).alias("random_seeds"),
    )


# Rows that the transformer run takes from each split.
HEAD_ROWS = {"train": 20_000, "val": 3_000, "test": 3_000}


def head_subset(
    df: DataFrame, limits: dict[str, int] = HEAD_ROWS, order: str = "sample_id"
) -> DataFrame:
    """The first rows of each split in source order; ``order`` must be unique.

    Ids order by length first: their numbers are padded, but may outgrow the padding. Ids are
    numbered by a distributed sort, so no task gathers the heads of all others; the chosen ids
    are as many as the limits say.
    """
    slim = df.select("split", order).filter(F.col("split").isin(*limits))
    keys = [F.col("split"), F.length(order), F.col(order)]
    numbered = staged(index_by_order(slim, keys, "__n"), "numbered")
    # One row per split.
    first = numbered.groupBy("split").agg(F.min("__n").alias("__first"))
    limit = F.lit(0)
    for name, n in limits.items():
        limit = F.when(F.col("split") == name, n).otherwise(limit)
    chosen = numbered.join(F.broadcast(first), "split").filter(F.col("__n") - F.col("__first") < limit)
    return df.join(F.broadcast(chosen.select(order)), order, "left_semi").select(*df.columns)
