"""Corpus preparation writes its texts once: what is stored, joined and shuffled on the way."""

import random
import re

import pytest
from pyspark.sql import functions as F

from parley.catalog import files, inputs
from parley.operators import rowindex
from parley.plans import prep
from parley.settings import MULTILABEL_LABELS
from parley.session import scratch_scope, staged
from parley.sources import corpus as src

TEXTS = {"raw_text", "text_clean", "text_tfidf", "comment_text", "text"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def sources(tmp_path, n=300):
    zero = ",".join("0" for _ in MULTILABEL_LABELS[1:])
    main = [f'"a, ""text"" {i % (n - 20)} &amp; more",{i % 2},{zero}' for i in range(n)]
    (tmp_path / "raw.csv").write_text("\n".join(["comment_text," + ",".join(MULTILABEL_LABELS), *main, f'" ",1,{zero}']))
    scored = [f'"words {i % (n - 30)}",{(i % 10) / 10},{(i % 7) / 7}' for i in range(n)]
    (tmp_path / "scored.csv").write_text("\n".join(["text,toxicity,female", *scored, ",0.9,0.1"]))
    return str(tmp_path / "raw.csv"), str(tmp_path / "scored.csv")


def test_preparation_stores_no_text_but_in_its_outputs(spark, tmp_path, monkeypatch):
    stored = []
    monkeypatch.setattr(prep, "staged", lambda df, *a, **k: stored.append(set(df.columns)) or staged(df, *a, **k))
    output = str(tmp_path / "out")
    with scratch_scope(spark):
        result = prep.run_prep(spark, *sources(tmp_path), output)
        assert stored and not any(TEXTS & columns for columns in stored)
        main = result.main.corpus
        assert main.count() == 280 and result.scored.corpus.count() == 270
        # The summaries can still be read, and tell of the published rows.
        counts = {r.artefact: r.rows for r in result.main.summaries["artefact_counts"].collect()}
        assert {r.split: r["count"] for r in main.groupBy("split").count().collect()} == {
            s: counts[s] for s in prep.MAIN_SPLITS}
        assert result.main.summaries["missing_after_prep"].first()[0] == 0
        assert "token_length_diagnostics" in result.scored.summaries
    rows = spark.read.parquet(f"{output}/main/splits.parquet")
    assert rows.columns == [*main.columns, "part"]
    assert sorted(r[0] for r in rows.select("sample_id").collect()) == [f"multilabel_{i:08d}" for i in range(280)]
    assert {r[0] for r in rows.select("text_clean").collect()} == {f'a, "text" {i} & more' for i in range(280)}
    whole = [spark.read.parquet(f"{output}/scored/{n}.parquet") for n in ("aug_pool_full", "external_test")]
    assert [t.count() for t in whole] == [216, 54]
    for name in ("aug_pool_full", "external_test", "aug_pool_capped", "aug_pool_identity"):
        table = spark.read.parquet(f"{output}/scored/{name}.parquet")
        assert table.columns == result.scored.corpus.columns
        copy = files._read_csv(spark, f"{output}/scored/{name}.csv")
        assert sorted(copy.select("sample_id", "raw_text").collect()) == sorted(table.select("sample_id", "raw_text").collect())
    assert not [p for p in (tmp_path / "out/scored").iterdir() if p.name.startswith("rows-")]


def test_prepared_sources_stand_alone(spark, tmp_path):
    """The parts of the run give the corpora that the run publishes."""
    main_path, scored_path = sources(tmp_path)
    with scratch_scope(spark):
        run = prep.run_prep(spark, main_path, scored_path, str(tmp_path / "out"))
        main = prep.prepare_main(src.load_multilabel(spark, main_path))
        raw, schema = src.load_scored_optional(spark, scored_path)
        scored = prep.prepare_scored(raw, schema, main.thresholds, main.corpus.filter("split = 'train'").count())
        for one, other in ((run.main, main), (run.scored, scored)):
            assert sorted(map(repr, one.corpus.collect())) == sorted(map(repr, other.corpus.collect()))
            assert one.summaries.keys() == other.summaries.keys()
    assert prep.PrepResult(main, scored).warnings == []


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_numbers_are_joined_by_masks(spark, monkeypatch, broadcast):
    monkeypatch.setattr(rowindex, "BROADCAST_ROWS", broadcast)
    draw = random.Random(3)
    keys = sorted(draw.sample(range(-500, 1500), 900)) + [2**62, 2**62 + 63, 2**63 - 1]
    numbers = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, n long")
    rows = spark.createDataFrame([(k, f"t{k}") for k in [*range(-600, 1600), *keys[-3:], 2**62 + 1]] + [(None, "none"), (7, "again")], "k long, t string")
    found = rowindex.with_numbers(rows, numbers, "k", "n")
    assert sorted(found.select("k", "t", "n").collect()) == sorted(rows.join(numbers, "k").select("k", "t", "n").collect())
    assert dict(found.dtypes)["n"] == "bigint" and set(found.columns) == {"k", "t", "n"}
    if broadcast:
        assert not re.search(r"(?<!Broadcast)Exchange", plan(found))


def test_repeated_keys_are_joined_as_they_are(spark):
    numbers = spark.createDataFrame([(None, 0), (5, 1), (5, 2), (70, 3)], "k long, n long")
    rows = spark.createDataFrame([(5, "a"), (5, "b"), (6, "c"), (70, "d"), (None, "e")], "k long, t string")
    found = rowindex.with_numbers(rows, numbers, "k", "n").select("k", "t", "n").collect()
    assert sorted(found) == sorted(rows.join(numbers, "k").select("k", "t", "n").collect())


def tables(spark, folder, parts):
    """Documents in as many files as there are lists of ids, every other one with a label."""
    for ids in parts:
        rows = [(i, f'text {i}, "quoted"\nline of {i}', "en", "s", 9) for i in ids]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").coalesce(1).write.mode("append").parquet(f"{folder}/documents.parquet")
    labels = [(i, i % 3 % 2, i % 5 % 2) for ids in parts for i in ids if i is not None and i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")


PARTS = [[10 * k + i for i in range(10)] for k in range(16)]  # two files a task, on 8 cores


@pytest.mark.parametrize("parts, kept", [
    ([list(reversed(p)) for p in random.Random(1).sample(PARTS, 16)], True),  # ranges, in any order of files and rows
    ([*PARTS[:15], [5, 200]], False),  # ranges overlap, and an id repeats
    ([*PARTS[:15], [None, 200]], False),
    (PARTS[:3], False),  # fewer files than cores: dealt anew
])
def test_sources_are_written_in_order(spark, tmp_path, parts, kept):
    tables(spark, str(tmp_path), parts)
    for rows, make in ((inputs.labelled, files._multilabel_csv), (inputs.scored, files._scored_csv)):
        # A document without an id has no labels.
        ranges = files._ranges(rows(spark, str(tmp_path), inputs.SPLIT), "source_row_index")
        assert (ranges is not None) == (kept or (None in parts[-1] and rows is inputs.labelled))
        path = make(spark, str(tmp_path), compression="gzip")
        raw = src.load_multilabel(spark, path) if make is files._multilabel_csv else src.load_scored_optional(spark, path)[0]
        text = "comment_text" if "comment_text" in raw.columns else "text"
        got = [r[0] for r in raw.orderBy("source_row_index").select(text).collect()]
        made = rows(spark, str(tmp_path))
        assert got == [r[0] for r in made.orderBy("source_row_index").select(text).collect()]
        assert raw.agg(F.max("source_row_index")).first()[0] == len(got) - 1
