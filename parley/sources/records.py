"""Quoted CSV as a table, with one file read by many tasks.

A quoted cell may hold line breaks, so whether a line begins a record depends on every line
before it. Lines are read in parallel, as Spark splits the files, in two passes. The first finds
for each block of lines what it does to the state "inside quotes": the state that it leaves, and
the records that it begins, for either state that it may be entered in. These small functions
are composed file by file, which gives each block its true state, record number and line
number. The second pass parses from true record starts. A record that crosses blocks comes out
as pieces, at most two of them per block, which are put together by its number.

Records are stored as Parquet once. Each has its number, its file and line, its cells, and what
is wrong with it.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.errors import SchemaError
from parley.operators.rowindex import running_offsets, with_small_table
from parley.session import staged

_BOM = b"\xef\xbb\xbf"
# A cell without quotes at its start, or a closed one and what follows it up to the comma.
_QUOTED = rb'[^"]*+(?:""[^"]*+)*+"[^,]*+'
_CELL = rb'(?:[^",][^,]*+|"' + _QUOTED + rb")?+"
_CLOSED_FROM_START = re.compile(_CELL + rb"(?:," + _CELL + rb")*+")
_CLOSED_FROM_INSIDE = re.compile(_QUOTED + rb"(?:," + _CELL + rb")*+")

_BLOCK = ("file string, split long, lines long, left_from_start boolean, left_from_inside boolean, "
          "records_from_start long, records_from_inside long")
_PLACE = "file string, split long, lines long, inside boolean, before long, line long, records long"
_RECORD = ("file string, record long, number long, line long, cells array<string>, problem string, "
           "piece long, raw binary")

TOO_MANY = "more cells than the header"
NOT_CLOSED = "a quote is not closed"
STRAY_END = "a line end outside quotes"


# Lines and states

def _effects(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether each line ends inside quotes, if it begins a record, and if it begins inside."""
    start, inside = np.zeros(len(lines), bool), np.ones(len(lines), bool)
    quoted = pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(quoted):
        line = lines[i].as_py()
        start[i] = _CLOSED_FROM_START.fullmatch(line) is None
        inside[i] = _CLOSED_FROM_INSIDE.fullmatch(line) is None
    return start, inside


def _states(start: np.ndarray, inside: np.ndarray, state: bool) -> np.ndarray:
    """The state before each line and, last, after all of them."""
    states = np.empty(len(start) + 1, bool)
    done = 0
    for i in np.flatnonzero(start | ~inside):  # the other lines change nothing
        states[done : i + 1] = state
        state, done = bool(inside[i] if state else start[i]), i + 1
    states[done:] = state
    return states


def _blank(lines: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(lines, r"^[ \t\r]*$").to_numpy(zero_copy_only=False)


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bool, dict, pa.Array]]:
    """``(whether a new block begins, its first row, lines)`` for runs of lines of one block."""
    last = None
    for batch in batches:
        files = batch.column("file").dictionary_encode()
        codes = files.indices.to_numpy(zero_copy_only=False)
        splits = batch.column("split").to_numpy(zero_copy_only=False)
        turns = 1 + np.flatnonzero((codes[1:] != codes[:-1]) | (splits[1:] != splits[:-1]))
        edges = [0, *turns.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            first = batch.slice(a, 1).to_pylist()[0]
            block = (first["file"], first["split"])
            lines = batch.column("value").slice(a, b - a)
            if block != last and block[1] == 0 and (head := lines[0].as_py()).startswith(_BOM):
                lines = pa.concat_arrays([pa.array([head[3:]], lines.type), lines.slice(1)])
            yield block != last, first, lines
            last = block


def _scan_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block: dict | None = None

    def done() -> Iterator[pa.RecordBatch]:
        if block:
            yield pa.RecordBatch.from_pylist([block])

    for new, first, lines in _segments(batches):
        if new:
            yield from done()
            block = {"file": first["file"], "split": first["split"], "lines": 0,
                     "left_from_start": False, "left_from_inside": True,
                     "records_from_start": 0, "records_from_inside": 0}
        start, inside = _effects(lines)
        text = ~_blank(lines)
        block["lines"] += len(lines)
        for entered in ("start", "inside"):
            states = _states(start, inside, block[f"left_from_{entered}"])
            block[f"left_from_{entered}"] = bool(states[-1])
            block[f"records_from_{entered}"] += int((text & ~states[:-1]).sum())
    yield from done()


def _place_blocks(blocks: pd.DataFrame) -> pd.DataFrame:
    """One file's blocks, each with the state and the counts that it is entered with."""
    inside, before, line, out = False, 0, 0, []
    for b in blocks.sort_values("split").itertuples():
        records = b.records_from_inside if inside else b.records_from_start
        out.append((b.file, b.split, b.lines, inside, before, line, records))
        inside = b.left_from_inside if inside else b.left_from_start
        before, line = before + records, line + b.lines
    return pd.DataFrame(out, columns=[
        "file", "split", "lines", "inside", "before", "line", "records"])


# Records

def _parse(texts: list[bytes]) -> list[tuple[list[str] | None, str | None]]:
    """``(cells, problem)`` of whole records."""
    csv.field_size_limit(sys.maxsize)
    decoded = [t.decode("utf-8", "replace") for t in texts]
    try:
        return [(cells, None) for cells in csv.reader(decoded)]
    except csv.Error:
        out: list[tuple[list[str] | None, str | None]] = []
        for text in decoded:
            try:
                out += [(cells, None) for cells in csv.reader([text])]
            except csv.Error:
                out.append((None, STRAY_END))
        return out


class _Block:
    """Records of one block of lines; the open record is carried from batch to batch."""

    def __init__(self, place: dict) -> None:
        self.place, self.seen, self.inside = place, 0, place["inside"]
        self.record = place["before"] - 1  # the number of the open or last record in its file
        self.open: list[bytes] = []
        self.open_line, self.head = 0, self.inside

    def rows(self, numbers: list[int], lines: list[int], parsed: list) -> pa.RecordBatch:
        n = len(numbers)
        nothing = pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())
        return self._batch(numbers, lines, [c for c, _ in parsed], [p for _, p in parsed], *nothing)

    def piece(self) -> pa.RecordBatch:
        """What this block has of a record that begins or ends in another block."""
        line = [None if self.head else self.open_line]
        return self._batch([self.record], line, [None], [None],
                           pa.array([self.place["split"]], pa.int64()),
                           pa.array([b"\n".join(self.open)], pa.binary()))

    def _batch(self, numbers, lines, cells, problems, pieces, raw) -> pa.RecordBatch:
        records = np.array(numbers, np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array([self.place["file"]] * len(numbers), pa.string()), pa.array(records),
            pa.array(records - 1 + self.place["offset"]), pa.array(lines, pa.int64()),
            pa.array(cells, pa.list_(pa.string())), pa.array(problems, pa.string()), pieces, raw,
        ], ["file", "record", "number", "line", "cells", "problem", "piece", "raw"])

    def add(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        states = _states(*_effects(lines), self.inside)
        before, after, text = states[:-1], states[1:], ~_blank(lines)
        starts = text & ~before
        numbers = self.record + np.cumsum(starts)
        at = self.place["line"] + self.seen + 1 + np.arange(len(lines))
        alone = np.flatnonzero(starts & ~after)
        if len(alone):
            yield self.rows(numbers[alone].tolist(), at[alone].tolist(),
                            _parse(lines.take(pa.array(alone)).to_pylist()))
        # The lines of records of several lines: first ones and those entered inside quotes.
        for i in np.flatnonzero(before | (starts & after)):
            if starts[i]:
                self.open, self.open_line, self.head = [], int(at[i]), False
            self.open.append(lines[i].as_py())
            if not after[i]:
                self.record = int(numbers[i])
                if self.head:
                    yield self.piece()
                else:
                    yield self.rows([self.record], [self.open_line], _parse([b"\n".join(self.open)]))
                self.open, self.head = [], False
        self.record, self.inside = int(numbers[-1]), bool(states[-1])
        self.seen += len(lines)

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.seen != self.place["lines"]:
            raise RuntimeError(f"{self.place['file']} changed, or was split anew, while it was read")
        if self.open:
            yield self.piece()


def _read_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block: _Block | None = None
    for new, first, lines in _segments(batches):
        if new:
            if block:
                yield from block.close()
            block = _Block(first)
        yield from block.add(lines)
    if block:
        yield from block.close()


def _join_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            raw = row.pop("raw")
            if _CLOSED_FROM_START.fullmatch(raw) is None:
                row["cells"], row["problem"] = None, NOT_CLOSED
            else:
                ((row["cells"], row["problem"]),) = _parse([raw])
        yield pa.RecordBatch.from_pylist(rows, pa.schema([
            ("number", pa.int64()), ("file", pa.string()), ("record", pa.int64()),
            ("line", pa.int64()), ("cells", pa.list_(pa.string())), ("problem", pa.string())]))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"))


@dataclass(frozen=True)
class CsvTable:
    """A CSV file, or a folder of files in name order, with a header line in each.

    ``records`` has ``(number, file, line, cells, problem)`` rows: the number among all data
    records from 0, the line on which the record begins, and what is wrong with it (null if
    nothing is). Records of too few cells are not wrong: the others are null.
    """

    path: str
    columns: tuple[str, ...]
    records: DataFrame

    def cell(self, name: str) -> Column:
        return F.get("cells", F.lit(self.columns.index(name)))

    def rows(self, number: str, columns: Iterable[str] | None = None, start: int = 0) -> DataFrame:
        """The well-formed records as a table of text cells, with their numbers."""
        names = self.columns if columns is None else columns
        return self.records.filter(F.col("problem").isNull()).select(
            (F.col("number") + start).alias(number), *(self.cell(c).alias(c) for c in names))

    def malformed(self) -> DataFrame:
        """``(file, line, problem)`` of the records that are wrong."""
        return self.records.filter(F.col("problem").isNotNull()).select("file", "line", "problem")


def _unique_names(cells: list[str]) -> tuple[str, ...]:
    """Header names; a repeated one gets a number, an empty one its place."""
    names: list[str] = []
    for i, name in enumerate(cells):
        name = base = name or f"column {i}"
        k = 0
        while name in names:
            k += 1
            name = f"{base}.{k}"
        names.append(name)
    return tuple(names)


def read_csv(spark: SparkSession, path: str) -> CsvTable:
    """Find, number and store all records. Lines end with LF or CR LF; blank lines between
    records do not count; broken UTF-8 becomes U+FFFD. The files' headers must be equal."""
    lines = _lines(spark, path)
    blocks = staged(lines.mapInArrow(_scan_blocks, _BLOCK), "csv-blocks")
    # One small row per block of a file.
    places = staged(blocks.groupBy("file").applyInPandas(_place_blocks, _PLACE), "csv-places")
    # The header of a file is no data record.
    totals = places.groupBy("file").agg(F.greatest(F.sum("records") - 1, F.lit(0)).alias("__rows"))
    offsets = running_offsets(totals, ["file"]).select("file", F.col("__offset").alias("offset"))
    placed = staged(places.join(offsets, "file"), "csv-offsets")
    found = staged(
        with_small_table(lines, placed, ["file", "split"], in_order=True)
        .mapInArrow(_read_blocks, _RECORD), "csv-records")
    names = ("number", "file", "record", "line", "cells", "problem")
    pieces = (
        found.filter("piece IS NOT NULL").groupBy("number", "file", "record")
        .agg(F.min("line").alias("line"), F.array_sort(F.collect_list(F.struct("piece", "raw"))).alias("p"))
        .select("number", "file", "record", "line",
                F.expr(r"concat_ws('\n', transform(p, x -> decode(x.raw, 'ISO-8859-1')))").alias("t"))
        .select("number", "file", "record", "line", F.encode("t", "ISO-8859-1").alias("raw"))
        .mapInArrow(_join_pieces, "number long, file string, record long, line long, "
                                  "cells array<string>, problem string")
    )
    records = found.filter("piece IS NULL").select(*names).unionByName(pieces)
    headers = records.filter("record = 0").groupBy("cells").agg(F.min("file").alias("file")).limit(2).collect()
    if len(headers) > 1:
        listed = "; ".join(f"{h.file}: {h.cells}" for h in headers)
        raise SchemaError(f"the files of {path} have different headers: {listed}")
    columns = _unique_names(headers[0].cells or []) if headers else ()
    too_many = F.when(F.size("cells") > len(columns), F.lit(TOO_MANY))
    return CsvTable(path, columns, records.filter("record > 0").select(
        "number", "file", "line", "cells", F.coalesce("problem", too_many).alias("problem")))
