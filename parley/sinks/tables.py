"""Table outputs of corpus preparation."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators.splits import capped_condition
from parley.session import COMPACT, move_folder, remove_scratch
from parley.settings import PrepSettings

SLICE_FLAGS = {
    "identity_slice": "has_identity_term",
    "obfuscation_slice": "has_obfuscation",
    "implicit_proxy_slice": "implicit_proxy",
}


# Published tables, which are most of what a run writes: 7 % smaller than at the default level.
TABLE = {**COMPACT, "parquet.compression.codec.zstd.level": "6"}


def write_both(df: DataFrame, path: str) -> None:
    """Parquet, and a CSV copy made from it."""
    df.write.mode("overwrite").options(**TABLE).parquet(f"{path}.parquet")
    stored = df.sparkSession.read.parquet(f"{path}.parquet")
    write_csv(stored, f"{path}.csv")


# Cells are written as they are, blanks at their edges included. A row's texts are copies of each
# other but for a few characters: compressed, the files are a fifth as large.
CSV = {
    "compression": "gzip", "header": True, "quote": '"', "escape": '"', "emptyValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV).csv(path)


def write_split_tables(df: DataFrame, folder: str) -> None:
    """One pass writes all splits, one folder ``part=...`` each, with ``split`` in the files too."""
    store_by_split(df, f"{folder}/splits.parquet")
    write_split_copy(df.sparkSession, folder)


def store_by_split(df: DataFrame, path: str) -> DataFrame:
    """Writes all rows, one folder ``part=...`` for each split, and reads them back."""
    kept = df.withColumn("part", F.col("split"))
    kept.write.mode("overwrite").options(**TABLE).partitionBy("part").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def write_split_copy(spark: SparkSession, folder: str) -> None:
    """The CSV copy of the stored split tables."""
    stored = spark.read.parquet(f"{folder}/splits.parquet")
    stored.write.mode("overwrite").partitionBy("part").options(**CSV).csv(f"{folder}/splits.csv")


def write_slice_tables(df: DataFrame, folder: str) -> None:
    """The rows of each challenge slice."""
    for name, flag in SLICE_FLAGS.items():
        write_both(df.filter(F.col(flag) == 1), f"{folder}/{name}")


def simple_export(df: DataFrame) -> DataFrame:
    """The three-column hand-off table, with its split."""
    return tx.add_export_text(df, "text_clean").select(
        "raw_text", "clean_text", F.col("binary_label").alias("label"), "split"
    )


def export_simple(df: DataFrame, folder: str) -> None:
    """The hand-off table as CSV, one folder per split."""
    simple_export(df).write.mode("overwrite").partitionBy("split").options(**CSV).csv(
        f"{folder}/simple.csv")


def scored_conditions(
    df: DataFrame, main_train_rows: int, settings: PrepSettings = PrepSettings()
) -> dict[str, Column]:
    """Which rows of a split scored source each of its tables holds."""
    pool = F.col("split") == "aug_pool"
    return {
        "aug_pool_full": pool,
        "external_test": F.col("split") == "external_test",
        "aug_pool_capped": pool & capped_condition(
            df.filter(pool), main_train_rows, settings.seed + 4),
        "aug_pool_identity": pool & (F.col("has_identity_term") == 1),
        "obfuscation_slice": F.col("has_obfuscation") == 1,
        "implicit_proxy_slice": F.col("implicit_proxy") == 1,
    }


def scored_outputs(
    df: DataFrame, main_train_rows: int, settings: PrepSettings = PrepSettings()
) -> dict[str, DataFrame]:
    """The tables derived from a split scored source."""
    conditions = scored_conditions(df, main_train_rows, settings)
    return {name: df.filter(holds) for name, holds in conditions.items()}


def scored_output_counts(df: DataFrame, main_train_rows: int) -> DataFrame:
    """Rows of the first four scored outputs, from one aggregation."""
    pool = F.col("split") == "aug_pool"
    row = df.agg(
        F.count_if(pool).alias("aug_pool_full"),
        F.count_if(F.col("split") == "external_test").alias("external_test"),
        F.least(F.lit(main_train_rows).cast("long"), F.count_if(pool)).alias("aug_pool_capped"),
        F.count_if(pool & (F.col("has_identity_term") == 1)).alias("aug_pool_identity"),
    )
    return row.unpivot([], row.columns, "artefact", "rows")


# The scored tables that share no row, with their splits; the others hold rows of these.
DISJOINT = {"aug_pool_full": "aug_pool", "external_test": "external_test"}


def store_scored(df: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of a split scored source in one pass, as the disjoint tables, and reads them back."""
    spark = df.sparkSession
    parts = f"{folder}/rows-{uuid.uuid4().hex}"
    try:
        store_by_split(df, parts)
        for name, split in DISJOINT.items():
            if not move_folder(spark, f"{parts}/part={split}", f"{folder}/{name}.parquet"):
                df.limit(0).write.mode("overwrite").options(**TABLE).parquet(f"{folder}/{name}.parquet")
    finally:
        remove_scratch(spark, parts)
    tables = [spark.read.schema(df.schema).parquet(f"{folder}/{name}.parquet") for name in DISJOINT]
    return reduce(DataFrame.unionByName, tables)


def write_scored_outputs(
    df: DataFrame, folder: str, main_train_rows: int, settings: PrepSettings = PrepSettings(),
    index: DataFrame | None = None,
) -> dict[str, Column]:
    """Writes the tables, and returns which rows each of them holds.

    The rows are made in one pass, which writes the disjoint tables; all else is read from these.
    So ``df`` need not be stored, if an ``index`` of its ids and splits is.
    """
    spark = df.sparkSession
    conditions = scored_conditions(df if index is None else index, main_train_rows, settings)
    table = F.lit("rest")
    for name in DISJOINT:
        table = F.when(conditions[name], name).otherwise(table)
    parts = f"{folder}/rows-{uuid.uuid4().hex}"
    try:
        df.withColumn("__table", table).write.partitionBy("__table").options(**TABLE).parquet(parts)
        rows = spark.read.schema(df.schema).parquet(parts)
        for name, holds in conditions.items():
            if name not in DISJOINT:
                write_both(rows.filter(holds).select(*df.columns), f"{folder}/{name}")
        for name in DISJOINT:
            if not move_folder(spark, f"{parts}/__table={name}", f"{folder}/{name}.parquet"):
                df.limit(0).write.mode("overwrite").options(**TABLE).parquet(f"{folder}/{name}.parquet")
            write_csv(spark.read.parquet(f"{folder}/{name}.parquet"), f"{folder}/{name}.csv")
    finally:
        remove_scratch(spark, parts)
    return conditions


def _json_safe(column: str, kind: str) -> Column:
    value = F.col(column)
    if kind in ("double", "float"):
        return F.when(~F.isnan(value), value).alias(column)
    return value


def summary_json(df: DataFrame) -> DataFrame:
    """A summary table as JSON texts: sorted keys, nulls kept, NaN as null."""
    kinds = dict(df.dtypes)
    fields = [_json_safe(c, kinds[c]) for c in sorted(df.columns)]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def write_summaries(tables: dict[str, DataFrame], folder: str) -> None:
    """Each summary (a handful of rows) as JSON lines."""
    for name, table in tables.items():
        summary_json(table).coalesce(1).write.mode("overwrite").text(f"{folder}/{name}.json")


def artefact_counts(df: DataFrame, splits: Sequence[str]) -> DataFrame:
    """Rows of every split and slice table, from one aggregation."""
    row = df.agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in splits],
        *[F.count_if(F.col(flag) == 1).alias(name) for name, flag in SLICE_FLAGS.items()],
    )
    return row.unpivot([], row.columns, "artefact", "rows")
