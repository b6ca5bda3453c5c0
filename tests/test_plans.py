"""The plans behind the queries: what they read, how they join, what reaches Python."""

import re

import pytest
from pyspark.sql import functions as F

from parley import catalog
from parley.catalog import inputs
from parley.operators import leakage, splits, triage



def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["standardize", "audit_dataset", "dedup_normalized", "slice_summary", "split_hash_overlap", "label_drift",
     "detect_cues", "queue_summary", "tfidf_vocab", "evaluate_slices", "class_distribution", "pool_external_overlap"],
)
def test_no_cross_products(spark, sf, name):
    text = plan(catalog.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_scans_are_pruned(spark, sf):
    text = plan(catalog.QUERIES["sample_id"](spark, sf).select("sample_id"))
    read = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert read and all("lang" not in r and "n_chars" not in r for r in read)
    text = plan(catalog.QUERIES["queue_filter"](spark, sf))
    assert "text" not in "".join(re.findall(r"ReadSchema: struct<([^>]*)>", text))


def test_label_filters_reach_the_scan(spark, sf):
    rows = inputs.table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    assert "EqualTo(toxic,1)" in plan(rows)


def test_native_operators_never_leave_the_jvm(spark, sf):
    for name in ("has_obfuscation", "has_identity_term", "word_count", "detect_cues", "build_review_item", "tfidf_weights"):
        assert "EvalPython" not in plan(catalog.QUERIES[name](spark, sf)), name


def test_top_k_is_distributed(spark, sf):
    assert "TakeOrderedAndProject" in plan(triage.queue_topk(triage.build_review_items(inputs.predictions(spark, sf)), "High", 10))


def test_example_hashes_are_limited_before_the_shuffle(spark):
    df = spark.range(100).select(F.lit("a").alias("split"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    assert "WindowGroupLimit" in plan(leakage.split_hash_overlap(df, ("a", "b"), ("h",)))


def test_split_assignment_is_a_projection(spark):
    df = spark.range(0, 1000, 1, 4).select(F.col("id").cast("string").alias("sample_id"), (F.col("id") % 2).cast("int").alias("binary_label"))
    text = plan(splits.stratified_split3(df))
    assert "Exchange" not in text and "Window" not in text


def test_scratch_tables_go_to_the_configured_folder(spark, shared_folder):
    from parley.session import scratch_path

    assert scratch_path(spark, "x").startswith(f"{shared_folder}/x-")


def test_cue_expression_stands_once_in_exploding_plans(spark, sf):
    for name in ("cue_statistics", "detect_cues", "resolve_highlight_spans"):
        text = plan(catalog.QUERIES[name](spark, sf))
        assert text.count("regexp_extract_all") <= 16, name  # one for each of the 16 terms


def test_a_runs_scratch_folder_is_removed(spark, sf):
    from pathlib import Path

    from parley.session import scratch_path, scratch_scope

    before = scratch_path(spark, "x").rsplit("/", 1)[0]
    with scratch_scope(spark) as folder:
        rows = catalog.QUERIES["sample_id"](spark, sf).count()
        assert rows and list(Path(folder.removeprefix("file:")).iterdir())
        assert scratch_path(spark, "x").startswith(folder)
    assert not Path(folder.removeprefix("file:")).exists()
    assert scratch_path(spark, "x").rsplit("/", 1)[0] == before


def test_facts_read_each_text_once(spark, sf, tmp_path):
    """One scan and one normalisation node per source; what follows reads narrow columns."""
    from parley.functions import labels as lb
    from parley.operators.audit import audit_facts
    from parley.operators.facts import text_facts
    from parley.operators.standardize import removals_from_facts
    from parley.session import staged

    raw = inputs.labelled(spark, sf)
    facts = text_facts(raw, "comment_text", inputs.main_label(), lb.multilabel_json(["toxic"]))
    text = plan(facts)
    nodes = [x for x in text.splitlines() if "ArrowEvalPython" in x]
    assert len(nodes) == 2  # entities and NFKC once, case folding once
    assert len(re.findall(r"FileScan parquet \[[^]]*text#", text)) == 1
    stored = staged(facts, "facts")
    for table in (audit_facts(stored), removals_from_facts(stored)):
        text = plan(table)
        read = "".join(re.findall(r"ReadSchema: struct<([^>]*)>", text))
        assert "ArrowEvalPython" not in text
        assert "raw_text:" not in read and "text_clean:" not in read


def test_selection_has_no_funnel(spark, sf):
    for name in ("tfidf_vocab", "head_subset"):
        found = re.findall(r"TakeOrderedAndProject\(limit=(\d+)", plan(catalog.QUERIES[name](spark, sf)))
        assert all(int(n) <= 1000 for n in found), name


def test_preparation_leaves_only_what_its_tables_read(spark, tmp_path):
    """Records and facts go before the outputs are written, and the outputs are compressed."""
    from pathlib import Path

    from parley.plans import prep
    from parley.session import scratch_scope
    from parley.settings import MULTILABEL_LABELS

    zero = ",".join("0" for _ in MULTILABEL_LABELS[1:])
    lines = [f'"a, ""text"" {i}",{i % 2},{zero}' for i in range(200)]
    (tmp_path / "raw.csv").write_text("\n".join(["comment_text," + ",".join(MULTILABEL_LABELS), *lines]))
    with scratch_scope(spark) as folder:
        result = prep.run_prep(spark, str(tmp_path / "raw.csv"), None, str(tmp_path / "out"))
        left = {p.name.split("-")[0] for p in Path(folder.removeprefix("file:")).iterdir()}
        assert result.main.corpus.count() == 200
    assert left == {"corpus", "audit", "removal", "overlaps"}
    copies = [p for p in (tmp_path / "out/main").rglob("part-*") if ".csv/" in str(p)]
    assert copies and all(p.name.endswith(".csv.gz") for p in copies)
    tables = list((tmp_path / "out/main").rglob("part-*.parquet"))
    assert tables and all(p.name.endswith(".zstd.parquet") for p in tables)
    texts = spark.read.options(header=True, quote='"', escape='"').csv(str(tmp_path / "out/main/splits.csv"))
    assert {r.raw_text for r in texts.collect()} == {f'a, "text" {i}' for i in range(200)}
