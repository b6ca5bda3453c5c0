"""Quoted CSV read by many tasks: the same records as a reader that sees the whole file."""

import csv
import io

import numpy as np
import pytest

from parley.errors import SchemaError
from parley.operators import rowindex
from parley.sources import records


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def rows_of(table):
    rows = table.records.orderBy("number").collect()
    assert [r.number for r in rows] == list(range(len(rows)))
    return rows


def random_file(seed, end="\n", rows=400):
    """Cells with line breaks, commas, quotes and blank edges, and records over several blocks."""
    random = np.random.default_rng(seed)
    parts = ["word", " ", ",", '"', '""', "\n", "é日", "\n\n", "'", "x" * 40, ""]
    table = [["id", "text", "more"]] + [
        [str(i), "".join(random.choice(parts, random.integers(0, 12 if i % 50 else 400))),
         random.choice(["", "z", "q\nr"])] for i in range(rows)]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    for row in table:
        writer.writerow(row)
        if random.random() < 0.1:
            out.write(random.choice(["", " ", "\t"]) + end)
    return table, out.getvalue()


@pytest.mark.parametrize("seed, end, broadcast", [(1, "\n", 100_000), (2, "\r\n", 100_000), (3, "\n", 0)])
def test_one_file_in_many_tasks(spark, small_blocks, tmp_path, monkeypatch, seed, end, broadcast):
    monkeypatch.setattr(rowindex, "BROADCAST_ROWS", broadcast)
    table, text = random_file(seed, end)
    path = tmp_path / "a.csv"
    path.write_bytes(text.encode())
    lines = records._lines(spark, str(path))
    assert lines.rdd.getNumPartitions() > 15
    got = records.read_csv(spark, str(path))
    rows = rows_of(got)
    assert got.columns == ("id", "text", "more")
    assert [r.cells for r in rows] == table[1:] and not any(r.problem for r in rows)
    # Line numbers: as a reader of the whole file counts them.
    reader, begins, before = csv.reader(io.StringIO(text, newline="")), [], 0
    for cells in reader:
        if cells and (len(cells) > 1 or cells[0].strip()):
            begins.append(before + 1)
        before = reader.line_num
    assert [r.line for r in rows] == begins[1:]


def test_same_rows_as_the_one_task_reader(spark, small_blocks, tmp_path):
    _, text = random_file(5)
    (tmp_path / "a.csv").write_text(text)
    whole = spark.read.options(header=True, multiLine=True, quote='"', escape='"', emptyValue="",
                               nullValue="\x00").csv(str(tmp_path / "a.csv"))
    mine = records.read_csv(spark, str(tmp_path / "a.csv")).rows("n")
    want = [tuple(x or "" for x in r) for r in whole.collect() if r.id.strip()]
    assert [tuple(r)[1:] for r in mine.orderBy("n").collect()] == want


def test_quotes_inside_cells_open_nothing(spark, small_blocks, tmp_path):
    text = 'a,b\n5" pipe,x\n"q"uoted,"y\n,z" tail\nit"s,"""in"" out"\n' * 1 + 'k,"v"\n' * 80
    (tmp_path / "a.csv").write_text(text)
    rows = rows_of(records.read_csv(spark, str(tmp_path / "a.csv")))
    assert [r.cells for r in rows[:4]] == [
        ['5" pipe', "x"], ["quoted", "y\n,z tail"], ['it"s', '"in" out'], ["k", "v"]]
    assert len(rows) == 83


def test_malformed_records_keep_their_line(spark, small_blocks, tmp_path):
    text = "id,text\n1,hello,world,more\n2,ok\n3\n\n4,a\rb\n" + "5,fine\n" * 60 + '6,"open\nto the end\n'
    (tmp_path / "a.csv").write_text(text)
    table = records.read_csv(spark, str(tmp_path / "a.csv"))
    bad = {(r.line, r.problem) for r in table.malformed().collect()}
    assert bad == {(2, records.TOO_MANY), (6, records.STRAY_END), (67, records.NOT_CLOSED)}
    good = table.rows("n", ["text"], start=1).orderBy("n").collect()
    assert [tuple(r) for r in good[:3]] == [(2, "ok"), (3, None), (5, "fine")] and len(good) == 62


def test_folders_headers_and_marks(spark, small_blocks, tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    (folder / "b.csv").write_bytes(b'\xef\xbb\xbf"a",a,\n3,"x\ny",\n')
    (folder / "a.csv").write_bytes(b"a,a,\n1,\xff,\n2,b,\n")
    (folder / "c.csv").write_bytes(b"a,a,\n")
    (folder / "d.csv").write_bytes(b"")
    table = records.read_csv(spark, str(folder))
    assert table.columns == ("a", "a.1", "column 2")
    assert [r.cells[:2] for r in rows_of(table)] == [["1", "�"], ["2", "b"], ["3", "x\ny"]]
    (folder / "e.csv").write_bytes(b"a,b,\n")
    with pytest.raises(SchemaError, match="different headers"):
        records.read_csv(spark, str(folder))


@pytest.mark.parametrize("text", [b"", b"\n \n", b"a,b\n"])
def test_no_records(spark, tmp_path, text):
    (tmp_path / "a.csv").write_bytes(text)
    table = records.read_csv(spark, str(tmp_path / "a.csv"))
    assert table.records.isEmpty() and table.columns == (("a", "b") if b"a" in text else ())


def test_effects_agree_with_the_cell_machine():
    """Every short line, by a plain machine over its characters."""
    import itertools

    import pyarrow as pa

    def machine(line, inside):
        state = "quoted" if inside else "start"
        for i, c in enumerate(line):
            if state == "quoted":
                state = "closing" if c == '"' else "quoted"
            elif state == "closing" and c == '"':
                state = "quoted"
            elif c == ",":
                state = "start"
            else:
                state = "quoted" if c == '"' and state == "start" else "plain"
        return state == "quoted"

    lines = ["".join(x) for n in range(7) for x in itertools.product('",a', repeat=n)]
    start, inside = records._effects(pa.array([x.encode() for x in lines], pa.binary()))
    assert start.tolist() == [machine(x, False) for x in lines]
    assert inside.tolist() == [machine(x, True) for x in lines]


def sparse_ids(spark, n):
    from pyspark.sql import functions as F

    return spark.range(0, n, 1, 16).select(F.xxhash64("id").alias("key"))


def test_row_numbers_of_sparse_keys(spark, monkeypatch):
    """The unpartitioned window sees one row per sorted part, however the keys are spread."""
    seen = []
    whole = rowindex.running_offsets
    monkeypatch.setattr(rowindex, "running_offsets", lambda s, o: (seen.append(s.count()), whole(s, o))[1])
    keys = sparse_ids(spark, 50_000)
    got = rowindex.index_by_key(keys, "key", "n", start=5).orderBy("key").collect()
    assert [r["n"] for r in got] == list(range(5, 50_005))
    assert seen and max(seen) <= 200


def test_parquet_rows_are_numbered_in_place(spark, tmp_path, monkeypatch):
    staged = []
    keep = rowindex.staged
    monkeypatch.setattr(rowindex, "staged", lambda df, name: (staged.append(df.columns), keep(df, name))[1])
    path = str(tmp_path / "p")
    spark.range(0, 5000, 1, 7).selectExpr("id", "repeat('x', int(id % 50)) AS t").write.parquet(path)
    got = rowindex.number_parquet_rows(spark.read.parquet(path), "n").orderBy("n").collect()
    assert [(r["n"], r["id"]) for r in got] == [(i, i) for i in range(5000)]
    assert staged == [["__file", "__offset"]]  # only the small table is written
