"""Comment uploads: CSV with a text column, or one comment per line of a TXT file."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.errors import UploadError
from parley.functions import text as tx
from parley.operators.rowindex import number_file_rows
from parley.settings import UPLOAD_TEXT_CANDIDATES
from parley.sources.records import CsvTable, read_csv

_BOM = "\\A\\x{FEFF}"
# Line ends other than CR and LF.
_MORE_LINE_ENDS = r"[\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"


def file_type(path: str) -> str:
    for kind in ("csv", "txt"):
        if path.lower().endswith(f".{kind}"):
            return kind
    raise UploadError(f"Only CSV and TXT files can be read, not {path!r}.")


def _read_csv(spark: SparkSession, path: str) -> CsvTable:
    """All cells as text; nothing is read as missing, and one malformed row refuses the file."""
    table = read_csv(spark, path)
    if not table.columns:
        raise UploadError("This CSV has no header.")
    bad = table.malformed().agg(F.min(F.struct("line", "problem")).alias("first")).first().first
    if bad is not None:
        raise UploadError(f"The CSV cannot be read: line {bad.line} has {bad.problem}.")
    return table


def _check_content(spark: SparkSession, path: str) -> None:
    text = F.make_valid_utf8("value")
    if spark.read.text(path).filter(~tx.is_blank(F.regexp_replace(text, _BOM, ""))).isEmpty():
        raise UploadError("The file is empty.")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_number, text)`` of every physical line, blank ones included."""
    pieces = F.explode(F.split(F.make_valid_utf8("value"), _MORE_LINE_ENDS, -1))
    numbered = number_file_rows(
        spark.read.text(path), "line_number", start=1, generate=pieces, generated="value"
    )
    text = F.when(F.col("line_number") == 1, F.regexp_replace("value", _BOM, ""))
    return numbered.select("line_number", text.otherwise(F.col("value")).alias("text"))


def guess_text_column(columns: list[str]) -> str | None:
    """The first well-known name (any case), else the only column."""
    by_lower = {c.lower(): c for c in columns}
    known = next((by_lower[c] for c in UPLOAD_TEXT_CANDIDATES if c in by_lower), None)
    if known is None and len(columns) == 1:
        return columns[0]
    return known


def upload_inspect(spark: SparkSession, path: str) -> DataFrame:
    """One row: file type, columns, guessed text column, number of usable comments."""
    kind = file_type(path)
    _check_content(spark, path)
    if kind == "txt":
        columns, guess = [], None
        source = _lines(spark, path).select("text")
        usable = ~tx.is_blank(F.col("text"))
    else:
        table = _read_csv(spark, path)
        columns, source = list(table.columns), table.records
        guess = guess_text_column(columns)
        checked = [table.cell(guess)] if guess else [table.cell(c) for c in columns]
        usable = reduce(or_, [~tx.is_blank(c) for c in checked])
    return source.agg(F.count_if(usable).alias("valid_comment_count")).select(
        F.lit(kind).alias("file_type"),
        F.lit(",".join(columns)).alias("columns"),
        F.lit(guess).cast("string").alias("default_text_column"),
        "valid_comment_count",
    )


def upload_csv_comments(
    spark: SparkSession, path: str, text_column: str | None = None
) -> DataFrame:
    """``(row_id, text)``: data rows numbered from 1, then blank ones dropped."""
    table = _read_csv(spark, path)
    if len(table.columns) == 1:
        chosen = table.columns[0]
    elif not text_column:
        raise UploadError("Name the CSV column that has the comments.")
    elif text_column not in table.columns:
        raise UploadError(f"The CSV has no column {text_column!r}.")
    else:
        chosen = text_column
    return _usable(table.records.select(
        (F.col("number") + 1).alias("row_id"), table.cell(chosen).alias("text")))


def upload_txt_comments(spark: SparkSession, path: str) -> DataFrame:
    """``(row_id, text)``: physical lines numbered from 1, blank ones dropped."""
    return _usable(_lines(spark, path).withColumnRenamed("line_number", "row_id"))


def _usable(rows: DataFrame) -> DataFrame:
    return rows.select("row_id", tx.strip_cell(F.col("text")).alias("text")).filter(
        F.col("text") != ""
    )


def parse_upload(spark: SparkSession, path: str, text_column: str | None = None) -> DataFrame:
    """Comments of an upload of either type; an upload without comments is an error."""
    kind = file_type(path)
    _check_content(spark, path)
    if kind == "txt":
        comments = upload_txt_comments(spark, path)
    else:
        comments = upload_csv_comments(spark, path, text_column)
    if comments.isEmpty():
        raise UploadError("The file has no comment that is not blank.")
    return comments
