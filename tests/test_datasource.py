"""The upload data source gives the loader's rows."""

import csv
import io

import numpy as np
import pytest

from parley.sources import uploads
from parley.sources.datasource import UploadReader, register_upload_source


@pytest.fixture(scope="module")
def source(spark):
    register_upload_source(spark)
    return spark


def rows(df):
    return [tuple(r) for r in df.orderBy("row_id").collect()]


def write(tmp_path, name, data):
    (tmp_path / name).write_bytes(data)
    return str(tmp_path / name)


def sample_csv(seed=7, n=500):
    random = np.random.default_rng(seed)
    parts = ["word", " ", ",", '"', "\n", "é日", "\n\n", "x" * 30, ""]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\r\n")
    writer.writerow(["id", "a\nb", "text"])
    for i in range(n):
        writer.writerow([i, "", "".join(random.choice(parts, random.integers(0, 15)))][: 3 if i % 40 else 2])
    return b"\xef\xbb\xbf" + out.getvalue().encode() + b"\r\n \r\n"


@pytest.mark.parametrize("block", [64, 1000, 1 << 25])
def test_csv_rows_equal_the_loader(source, tmp_path, block):
    path = write(tmp_path, "a.csv", sample_csv())
    df = source.read.format("parley_upload").option("textColumn", "text").option("blockBytes", block).load(path)
    assert rows(df) == rows(uploads.parse_upload(source, path, "text"))
    assert (df.rdd.getNumPartitions() > 5) == (block < 1 << 20)
    assert df.schema.simpleString() == "struct<row_id:bigint,text:string>"


@pytest.mark.parametrize("block", [16, 1 << 25])
def test_txt_rows_equal_the_loader(source, tmp_path, block):
    data = b"\xef\xbb\xbf one \r\n\r\ntwo\xe2\x80\xa8three\x0b\nbad \xff byte\n" + b"line\n" * 50 + b"last"
    path = write(tmp_path, "a.txt", data)
    df = source.read.format("parley_upload").option("blockBytes", block).load(path)
    assert rows(df) == rows(uploads.parse_upload(source, path))


def test_single_columns_and_errors(source, tmp_path):
    load = source.read.format("parley_upload").load
    assert rows(load(write(tmp_path, "one.csv", b"anything\nx\n\n y \n"))) == [(1, "x"), (2, "y")]
    for name, data, message in (
        ("m.csv", b"t\na\nb,c\n", "line 3 has more cells"), ("q.csv", b't\n"a\n', "not closed"),
        ("c.csv", b"a,b\n1,2\n", "Name the CSV column"), ("e.csv", b"", "is empty"), ("e.txt", b" \n", "is empty"),
    ):
        with pytest.raises(Exception, match=message):
            load(write(tmp_path, name, data)).collect()
    with pytest.raises(Exception, match="Only CSV and TXT"):
        UploadReader({"path": "x.pdf"})
