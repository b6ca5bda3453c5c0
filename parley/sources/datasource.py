"""Uploads as a data source: ``spark.read.format("parley_upload").load(path)``.

An upload is one file that the driver can read as well. Planning reads it once, line by line, to
find blocks of whole records with their record and line numbers; each block is a partition. Rows
are those of :func:`parley.sources.uploads.parse_upload`. Corpora of any size are read by
:mod:`parley.sources.records`, which scans in tasks too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from parley.errors import UploadError
from parley.sources.records import (
    _BOM, NOT_CLOSED, TOO_MANY, _blank, _Block, _effects, _parse, _states, _unique_names,
)
from parley.sources.uploads import file_type

NAME = "parley_upload"
SCHEMA = "row_id long, text string"
BLOCK_BYTES = 32 << 20
_ROWS = pa.schema([("row_id", pa.int64()), ("text", pa.string())])


class FileBlock(InputPartition):
    """Bytes of the file that hold whole lines or records, and what comes before them."""

    def __init__(self, begin: int, end: int, lines: int, line: int, records: int,
                 column: int = 0, columns: int = 0) -> None:
        self.begin, self.end, self.lines, self.line, self.records = begin, end, lines, line, records
        self.column, self.columns = column, columns


def _lines(data: bytes) -> list[bytes]:
    lines = data.split(b"\n")
    return lines[:-1] if lines and not lines[-1] else lines


class UploadReader(DataSourceReader):
    """Options: ``path``, ``textColumn`` (of a CSV of several columns) and ``blockBytes``."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options.get("path", "")
        self.kind = file_type(self.path)
        self.text_column = options.get("textcolumn") or options.get("textColumn")
        self.block_bytes = int(options.get("blockbytes") or options.get("blockBytes") or BLOCK_BYTES)

    def _open(self) -> pa.NativeFile:
        if "://" in self.path or self.path.startswith("file:"):
            store, path = fs.FileSystem.from_uri(self.path)
        else:
            store, path = fs.LocalFileSystem(), self.path
        return store.open_input_file(path)

    def _pieces(self) -> Iterator[tuple[int, bytes]]:
        """The file in pieces of whole lines, with their places."""
        with self._open() as file:
            at, rest = 0, b""
            while True:
                data = file.read(self.block_bytes)
                cut = data.rfind(b"\n") + 1 if data else 0
                if data and not cut:
                    rest += data
                    continue
                if rest or data:
                    piece = rest + data[:cut]
                    yield at, piece
                    at += len(piece)
                rest = data[cut:]
                if not data:
                    return

    def partitions(self) -> list[FileBlock]:
        blocks = list(self._text_blocks() if self.kind == "txt" else self._csv_blocks())
        if not blocks:
            raise UploadError("The file is empty.")
        return blocks

    def _text_blocks(self) -> Iterator[FileBlock]:
        line, some = 0, False
        for at, data in self._pieces():
            text = data.decode("utf-8", "replace")
            lines = len(text.splitlines())
            some |= bool(text.removeprefix("﻿").strip())
            if some:
                yield FileBlock(at, at + len(data), lines, line, 0)
            line += lines

    def _csv_blocks(self) -> Iterator[FileBlock]:
        header: list[str] | None = None
        inside, records, line, begun = False, 0, 0, None
        held: list[bytes] = []
        for at, data in self._pieces():
            lines = _lines(data)
            if at == 0:
                lines = [lines[0].removeprefix(_BOM), *lines[1:]]
            column = pa.array(lines, pa.binary())
            states = _states(*_effects(column), inside)
            if begun is None:
                begun = [at, line, records]
            if header is None:  # its lines may reach into later pieces
                blank = _blank(column)
                for i in np.flatnonzero(states[:-1] | ~blank):
                    held.append(lines[i])
                    if not states[i + 1]:
                        header = self._header(b"\n".join(held))
                        break
            records += int((~_blank(column) & ~states[:-1]).sum())
            line, inside = line + len(lines), bool(states[-1])
            if not inside and header is not None:
                yield self._block(begun, at + len(data), line, header)
                begun = None
        if inside:
            raise UploadError(f"The CSV cannot be read: line {line} has {NOT_CLOSED}.")

    def _header(self, raw: bytes) -> list[str]:
        ((cells, _),) = _parse([raw])
        return list(_unique_names(cells or []))

    def _block(self, begun: list[int], end: int, line: int, header: list[str]) -> FileBlock:
        if len(header) > 1 and not self.text_column:
            raise UploadError("Name the CSV column that has the comments.")
        name = header[0] if len(header) == 1 else self.text_column
        if name not in header:
            raise UploadError(f"The CSV has no column {name!r}.")
        return FileBlock(begun[0], end, line - begun[1], begun[1], begun[2], header.index(name), len(header))

    def read(self, partition: FileBlock) -> Iterator[pa.RecordBatch]:
        with self._open() as file:
            file.seek(partition.begin)
            data = file.read(partition.end - partition.begin)
        if partition.begin == 0:
            data = data.removeprefix(_BOM)
        if self.kind == "txt":
            lines = data.decode("utf-8", "replace").splitlines()
            numbers: list[int] = [partition.line + 1 + i for i in range(len(lines))]
            yield self._rows(numbers, lines)
            return
        block = _Block({"file": self.path, "split": partition.begin, "inside": False, "offset": 0,
                           "before": partition.records, "line": partition.line, "lines": partition.lines})
        found: dict[int, str | None] = {}
        for batch in block.add(pa.array(_lines(data), pa.binary())):
            for row in batch.to_pylist():
                cells, problem = row["cells"], row["problem"]
                if problem is None and len(cells) > partition.columns:
                    problem = TOO_MANY
                if problem:
                    raise UploadError(f"The CSV cannot be read: line {row['line']} has {problem}.")
                if row["record"]:  # the header is record 0
                    found[row["number"] + 1] = cells[partition.column] if partition.column < len(cells) else None
        numbers = sorted(found)
        yield self._rows(numbers, [found[n] for n in numbers])

    def _rows(self, numbers: list[int], texts: list[str | None]) -> pa.RecordBatch:
        rows = [(n, t.strip()) for n, t in zip(numbers, texts) if t and t.strip()]
        return pa.RecordBatch.from_arrays(
            [pa.array([n for n, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], schema=_ROWS)


class UploadDataSource(DataSource):
    """``(row_id, text)`` of the comments of one uploaded CSV or TXT file."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> UploadReader:
        return UploadReader(self.options)


def register_upload_source(spark: SparkSession) -> None:
    spark.dataSource.register(UploadDataSource)
