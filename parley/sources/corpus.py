"""Labelled comment tables: mandatory multi-label, optional scored, and plain batches to score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley import settings as cfg
from parley.errors import SchemaError
from parley.operators.modeling import Scorer, score_comments
from parley.operators.rowindex import number_parquet_rows
from parley.sources.records import CsvTable, read_csv


@dataclass(frozen=True)
class ScoredSchema:
    """Which columns of a scored source play which part."""

    text_column: str
    label_column: str
    identity_columns: tuple[str, ...]


@dataclass(frozen=True)
class _Source:
    """An opened table of either format."""

    columns: tuple[str, ...]
    table: CsvTable | DataFrame

    def numbered(self, columns: list[str]) -> DataFrame:
        """The chosen columns with ``source_row_index``; files count in name order."""
        if isinstance(self.table, CsvTable):
            rows = self.table.rows("source_row_index", columns)
        else:
            rows = number_parquet_rows(self.table.select(*columns), "source_row_index")
        return rows.select("source_row_index", *_missing_as_null(rows, columns))


def _open(spark: SparkSession, path: str, fmt: str) -> _Source | None:
    try:
        if fmt == "csv":
            table = read_csv(spark, path)
            return _Source(table.columns, table)
        rows = spark.read.format(fmt).load(path)
        return _Source(tuple(rows.columns), rows)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _check_records(source: _Source, path: str, name: str, on_malformed: str,
                  warnings: list[tuple[str, str, str]] | None = None) -> None:
    """Malformed CSV records end the load, or are left out and counted in a warning."""
    if on_malformed not in ("fail", "drop"):
        raise ValueError(f"on_malformed is 'fail' or 'drop', not {on_malformed!r}")
    if not isinstance(source.table, CsvTable):
        return
    found = source.table.malformed().agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "line", "problem")).alias("first")).first()
    if not found.n:
        return
    at = f"the first on line {found.first.line} of {found.first.file}: {found.first.problem}"
    if on_malformed == "fail":
        raise SchemaError(f"{path} has {found.n} malformed rows, {at}")
    if warnings is not None:
        warnings.append((name, "malformed_rows", f"{name}: {found.n} malformed rows left out, {at}."))


def _missing_as_null(df: DataFrame, columns: list[str]) -> list:
    kinds = dict(df.dtypes)
    return [
        F.when(~F.col(c).isin(*cfg.MISSING_TOKENS), F.col(c)).alias(c)
        if kinds[c] == "string"
        else F.col(c)
        for c in columns
    ]


def _schema_error(path: str, expected, found) -> SchemaError:
    return SchemaError(
        f"{path} lacks required columns: expected {list(expected)}. Found columns: {list(found)}.")


def load_multilabel(
    spark: SparkSession, path: str, fmt: str = "csv", on_malformed: str = "fail",
    warnings: list[tuple[str, str, str]] | None = None, name: str = "multilabel",
) -> DataFrame:
    """Read the mandatory source: ``id`` if present, the text and the six labels.

    Adds ``source_row_index``; the files of a folder count as one table in name order, and rows
    that are left out as malformed keep their number.
    """
    source = _open(spark, path, fmt)
    if source is None:
        raise FileNotFoundError(f"mandatory multi-label source is missing: {path}")
    expected = [cfg.MULTILABEL_TEXT, *cfg.MULTILABEL_LABELS]
    if any(c not in source.columns for c in expected):
        raise _schema_error(path, expected, source.columns)
    _check_records(source, path, name, on_malformed, warnings)
    return source.numbered([c for c in ("id", *expected) if c in source.columns])


def load_scored_optional(
    spark: SparkSession, path: str, fmt: str = "csv", on_malformed: str = "fail",
    warnings: list[tuple[str, str, str]] | None = None, name: str = "scored",
) -> tuple[DataFrame | None, ScoredSchema | None]:
    """Read the optional scored source; ``(None, None)`` if it does not exist.

    The first present candidate names the text and the score; identity scores are kept.
    """
    source = _open(spark, path, fmt)
    if source is None:
        return None, None
    columns = source.columns
    text = next((c for c in cfg.SCORED_TEXT_CANDIDATES if c in columns), None)
    label = next((c for c in cfg.SCORED_LABEL_CANDIDATES if c in columns), None)
    if text is None or label is None:
        expected = (
            f"one of {list(cfg.SCORED_TEXT_CANDIDATES)}",
            f"one of {list(cfg.SCORED_LABEL_CANDIDATES)}",
        )
        raise _schema_error(path, expected, columns)
    _check_records(source, path, name, on_malformed, warnings)
    identity = tuple(c for c in cfg.IDENTITY_SCORE_COLUMNS if c in columns)
    wanted = [c for c in ("id", text, label, *identity) if c in columns]
    return source.numbered(wanted), ScoredSchema(text, label, identity)


def batch_score_csv(
    spark: SparkSession, path: str, scorer: Scorer, text_column: str = "text",
    threshold: float = 0.5, on_malformed: str = "fail",
) -> DataFrame:
    """Append prediction columns to every row of a CSV."""
    table = read_csv(spark, path)
    if text_column not in table.columns:
        raise KeyError(
            f"column {text_column!r} not found in {path}; available columns: {list(table.columns)}"
        )
    _check_records(_Source(table.columns, table), path, path, on_malformed)
    rows = table.rows("__row").drop("__row")
    return score_comments(
        rows.select(*_missing_as_null(rows, list(table.columns))), text_column, scorer, threshold)
