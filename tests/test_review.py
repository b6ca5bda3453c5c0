import csv
import io

import pytest
from pyspark.sql import functions as F

from parley.errors import UploadError
from parley.operators import triage
from parley.plans import prep, review
from parley.settings import MULTILABEL_LABELS
from parley.sinks.queue import HEADER, write_review_queue
from parley.sources import uploads
from parley.streaming import triage as streaming

EDGES = [0.85, 0.849999, 0.65, 0.50, 0.499999, 0.0, 1.0]


def items(spark, probabilities, texts=None):
    rows = [(i + 1, (texts or {}).get(i, f"comment {i}"), p) for i, p in enumerate(probabilities)]
    return triage.build_review_items(spark.createDataFrame(rows, "row_id long, original_text string, toxic_probability double"))


def length_scorer(df, text_column):
    return df.withColumn("toxic_probability", (F.length(text_column) % 10) / 10.0)


def test_bands_use_the_unrounded_probability(spark):
    got = items(spark, EDGES).orderBy("row_id").collect()
    assert [r["risk_level"] for r in got] == ["High", "Medium", "Medium", "Borderline", "Low", "Low", "High"]
    assert [r["review_priority"] for r in got] == [1, 2, 2, 3, 4, 4, 1]
    assert got[1]["risk_score"] == 0.85 and got[4]["risk_score"] == 0.5
    assert got[4]["prediction"] == "non-toxic" and got[4]["risk_score_percent"] == "50.0%"


def test_item_fallbacks(spark):
    df = spark.createDataFrame(
        [(None, None, None, None, None), ("0.7", "x", "", "bad", "0.9"), ("0.3", "0.6", "custom", "1", None)],
        "toxic_probability string, non_toxic_probability string, predicted_label string, numeric_label string, threshold string")
    got = [r["advanced"] for r in triage.build_review_items(df).collect()]
    assert (got[0]["toxic_probability"], got[0]["non_toxic_probability"], got[0]["numeric_label"], got[0]["confidence"]) == (0.0, 1.0, 0, 1.0)
    assert (got[1]["numeric_label"], got[1]["predicted_label"], got[1]["threshold"]) == (0, "non-toxic", 0.9)
    assert abs(got[1]["non_toxic_probability"] - 0.3) < 1e-12
    assert (got[2]["numeric_label"], got[2]["predicted_label"], got[2]["confidence"]) == (1, "custom", 0.6)


def test_queue_is_stable_and_ranks(spark):
    queue = items(spark, [0.2, 0.90001, 0.90002, 0.95, 0.2])
    assert [r["row_id"] for r in triage.review_queue(queue).collect()] == [4, 2, 3, 1, 5]
    ranked = triage.queue_rank(queue.select("row_id", "risk_score", "risk_level")).collect()
    assert {r["row_id"]: r["rank"] for r in ranked} == {4: 1, 2: 2, 3: 3, 1: 4, 5: 5}
    top = triage.queue_rank(queue, "High", 2).collect()
    assert [(r["row_id"], r["rank"]) for r in top] == [(4, 1), (2, 2)]
    assert triage.queue_topk(queue, "Medium", 10).isEmpty()
    with pytest.raises(ValueError):
        triage.queue_filter(queue, "Extreme")
    with pytest.raises(ValueError):
        triage.apply_threshold(queue, 1.5)


def test_summaries(spark):
    row = triage.queue_summary(items(spark, EDGES)).first()
    scores = [round(p, 4) for p in EDGES]
    assert (row["total_comments"], row["needs_review"], row["high_risk"], row["low_risk"]) == (7, 5, 2, 2)
    assert row["average_risk_score"] == round(sum(scores) / 7, 4)
    empty = triage.queue_summary(items(spark, EDGES).filter("row_id < 0")).first()
    assert empty["total_comments"] == 0 and empty["average_risk_score"] == 0.0 and empty["average_risk_score_percent"] == "0.0%"
    shares = {r[0]: (r[1], r[2]) for r in triage.risk_distribution(items(spark, [0.9, 0.1])).collect()}
    assert shares == {"High": (1, 0.5), "Medium": (0, 0.0), "Borderline": (0, 0.0), "Low": (1, 0.5)}
    level = spark.createDataFrame([("High",), ("Odd",), (None,)], "l string").select(triage.risk_explanation(F.col("l")))
    assert [r[0] for r in level.collect()] == [triage.BANDS[0][4], triage.BANDS[3][4], triage.BANDS[3][4]]


def test_queue_csv(spark, tmp_path):
    texts = {0: 'say "hi",\nyou idiot, idiot', 2: "shut up"}
    path = tmp_path / "queue"
    write_review_queue(items(spark, [0.2, 1.0, 0.00005], texts), str(path))
    whole = "".join(p.read_text() for p in sorted(path.glob("part-*")))
    assert whole.startswith(HEADER + "\n")
    rows = list(csv.DictReader(io.StringIO(whole)))
    assert [r["row_id"] for r in rows] == ["2", "1", "3"]
    assert rows[1]["original_text"] == texts[0] and rows[1]["keyword_cues"] == "idiot (Direct insult, High) x2"
    assert rows[0]["risk_score"] == "1" and rows[2]["toxic_probability"] == "0.00005"
    assert whole.splitlines()[1].startswith('"2","comment 1","toxic","High","1","100.0%"')
    empty = tmp_path / "empty"
    write_review_queue(items(spark, [0.1]).filter("row_id < 0"), str(empty))
    assert "".join(p.read_text() for p in sorted(empty.glob("part-*"))) == HEADER + "\n"


def upload(tmp_path, name, data):
    (tmp_path / name).write_bytes(data)
    return str(tmp_path / name)


def pairs(df):
    return [tuple(r) for r in df.orderBy("row_id").collect()]


def test_csv_upload(spark, tmp_path):
    path = upload(tmp_path, "a.csv", b'\xef\xbb\xbfid,Comment\n1, first \n\n2,\n3,"two\nlines ""q"""\n4,NA\n')
    assert pairs(uploads.parse_upload(spark, path, "Comment")) == [(1, "first"), (3, 'two\nlines "q"'), (4, "NA")]
    row = uploads.upload_inspect(spark, path).first()
    assert tuple(row) == ("csv", "id,Comment", "Comment", 3)
    for column, message in ((None, "Name the CSV column"), ("nope", "no column 'nope'")):
        with pytest.raises(UploadError, match=message):
            uploads.parse_upload(spark, path, column)
    single = upload(tmp_path, "b.csv", b"anything\nx\ny\n")
    assert pairs(uploads.parse_upload(spark, single, "ignored")) == [(1, "x"), (2, "y")]
    other = upload(tmp_path, "c.csv", b"p,q\n,\n1,\n")
    assert tuple(uploads.upload_inspect(spark, other).first()) == ("csv", "p,q", None, 1)
    blank = upload(tmp_path, "d.csv", b"t\n \n")
    with pytest.raises(UploadError, match="no comment"):
        uploads.parse_upload(spark, blank)
    with pytest.raises(UploadError, match="Only CSV and TXT"):
        uploads.parse_upload(spark, "x.pdf")


def test_malformed_and_empty_uploads(spark, tmp_path):
    path = upload(tmp_path, "a.csv", b'id,text\n0,"two\nlines"\n1,hello,world,more\n')
    for read in (lambda: uploads.parse_upload(spark, path, "text"), lambda: uploads.upload_inspect(spark, path)):
        with pytest.raises(UploadError, match="line 4 has more cells"):
            read()
    short = upload(tmp_path, "b.csv", b"id,text\n1\n2,hello\n")
    assert pairs(uploads.parse_upload(spark, short, "text")) == [(2, "hello")]
    for name, data in (("c.csv", b""), ("d.csv", b" \n\t\r\n"), ("e.txt", b"\xef\xbb\xbf\n \n")):
        empty = upload(tmp_path, name, data)
        for read in (uploads.parse_upload, uploads.upload_inspect):
            with pytest.raises(UploadError, match="is empty"):
                read(spark, empty)


def test_txt_upload(spark, tmp_path):
    data = b"\xef\xbb\xbf one \r\n\r\ntwo\xe2\x80\xa8three\x0b\nbad \xff byte\n"
    path = upload(tmp_path, "a.txt", data)
    assert pairs(uploads.parse_upload(spark, path)) == [(1, "one"), (3, "two"), (4, "three"), (6, "bad � byte")]
    assert tuple(uploads.upload_inspect(spark, path).first()) == ("txt", "", None, 4)


def test_rows_are_numbered_across_file_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(20_000)]
    path = upload(tmp_path, "big.txt", "\n".join(lines).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got = pairs(uploads.parse_upload(spark, path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i + 1, line.strip()) for i, line in enumerate(lines)]


def test_stream_and_batch_agree_and_blanks_are_counted(spark, tmp_path):
    rows = [(1, "you idiot"), (2, "  "), (3, None), (4, "hello www.x.com")]
    df = spark.createDataFrame(rows, "row_id long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streaming.comment_stream(spark, str(tmp_path / "in"), "row_id long, text string")
    out = streaming.analyze_stream(stream, length_scorer)
    query = streaming.start(out, str(tmp_path / "out"), str(tmp_path / "marks"))
    query.awaitTermination()
    seen = [p["observedMetrics"]["comments"] for p in query.recentProgress if p["observedMetrics"]]
    assert sum(m["rejected_blank"] for m in seen) == 2
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("row_id").collect()
    batch = review.triage_comments(df.filter("row_id in (1, 4)"), length_scorer).orderBy("row_id").collect()
    assert got == batch
    streaming.start(out, str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_gate_fails_before_anything_is_written(spark, tmp_path):
    from parley.errors import ValidationError
    from parley.settings import PrepSettings

    zero = ",".join("0" for _ in MULTILABEL_LABELS[1:])
    rows = [f'"text {i // 2}",{i % 2},{zero}' for i in range(400)]
    (tmp_path / "raw.csv").write_text("\n".join(["comment_text," + ",".join(MULTILABEL_LABELS), *rows]))
    settings = PrepSettings(remove_duplicates=False)
    with pytest.raises(ValidationError):
        prep.run_prep(spark, str(tmp_path / "raw.csv"), None, str(tmp_path / "out"), settings)
    assert not (tmp_path / "out").exists()
    lenient = PrepSettings(remove_duplicates=False, fail_on_leakage=False)
    result = prep.run_prep(spark, str(tmp_path / "raw.csv"), str(tmp_path / "none.csv"), str(tmp_path / "out"), lenient)
    codes = [w[1] for w in result.warnings]
    assert codes[0] == "missing_source" and "leakage" in codes
    assert spark.read.parquet(str(tmp_path / "out/main/splits.parquet")).count() == 400
    clean = prep.run_prep(spark, str(tmp_path / "raw.csv"), None, str(tmp_path / "ok"))
    assert clean.main.corpus.count() == 200
    assert (tmp_path / "ok/metadata/main/audit.json").exists()
