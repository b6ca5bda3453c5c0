import json
import math

import pytest
from pyspark.sql import functions as F

from parley import catalog
from parley.catalog import files, inputs
from parley.errors import SchemaError, ValidationError
from parley.functions import labels as lb
from parley.operators import audit, dedup, leakage, metrics, slices, splits, tfidf, validation
from parley.operators import standardize as standardize_module
from parley.operators.modeling import LinearScorer, balanced_class_weights, fit_logistic, score_comments
from parley.operators.rowindex import index_by_key, index_by_order
from parley.operators.standardize import removal_summary, standardize
from parley.settings import PrepSettings
from parley.sinks import tables as out


def corpus(spark, rows, settings=PrepSettings()):
    raw = spark.createDataFrame(rows, "source_row_index long, text string, label int")
    return standardize(raw, "s", "text", F.col("label"), F.lit("{}"), settings), raw


ROWS = [
    (5, "A  b", 1), (6, "a b", 0), (7, None, 0), (8, " \t", 1), (9, "&nbsp;", 0),
    (11, "Straße", 1), (12, "STRASSE", 0), (20, "www.x.com", 0), (21, "other", 1),
]


def test_standardize_keeps_the_first_row_and_numbers_survivors(spark):
    out, raw = corpus(spark, ROWS)
    got = [(r["sample_id"], r["text_clean"], r["binary_label"]) for r in out.orderBy("sample_id").collect()]
    assert got == [
        ("s_00000000", "A b", 1), ("s_00000001", "Straße", 1), ("s_00000002", "<URL>", 0), ("s_00000003", "other", 1),
    ]
    again, _ = corpus(spark, [(i, t, b) for i, (_, t, b) in enumerate(got)])
    assert again.count() == 4
    summary = removal_summary(raw, "text", F.col("label")).first().asDict()
    assert summary == {
        "input_rows": 9, "removed_missing_text": 3, "removed_missing_labels": 0,
        "removed_normalized_duplicates": 2, "output_rows": 4,
    }


def test_removal_counters_with_switches_off(spark):
    settings = PrepSettings(remove_missing_text=False, remove_duplicates=False, fold_duplicates=False)
    out, raw = corpus(spark, ROWS, settings)
    assert out.count() == 9
    summary = removal_summary(raw, "text", F.col("label"), settings).first()
    # Blank rows count once raw and once after cleaning; "", " " and "&nbsp;" share one key.
    assert (summary["removed_missing_text"], summary["removed_normalized_duplicates"], summary["output_rows"]) == (5, 2, 9)


def test_missing_labels_are_removed_only_if_strict(spark):
    from parley.plans.prep import main_label

    df = spark.createDataFrame([("1", None), (None, None), ("x", "0"), ("0", "0.5"), ("nan", None)], "a string, b string")
    label = lb.multilabel_to_binary(["a", "b"])
    assert [r[0] for r in df.select(label).collect()] == [1, 0, 0, 1, 0]
    strict = main_label(PrepSettings(strict_missing_labels=True), ("a", "b"))
    assert [r[0] for r in df.select(strict).collect()] == [1, None, 0, 1, None]


def test_scores_and_label_json(spark):
    df = spark.createDataFrame([(0.5, 1), (0.4999, None), (None, 0), (0.00001, 2)], "s double, k int")
    assert [r[0] for r in df.select(lb.score_to_binary("s", 0.5)).collect()] == [1, 0, 0, 0]
    assert [r[0] for r in df.select(lb.score_json("s")).collect()] == ['{"s":0.5}', '{"s":0.4999}', '{"s":null}', '{"s":1e-05}']
    assert [r[0] for r in df.withColumn("a", F.lit(3)).select(lb.multilabel_json(["k", "a"])).collect()][1] == '{"a":3,"k":null}'


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("A",)], "t string")
    assert tuple(audit.duplicate_counts(df, "t").first()) == (2, 3)
    assert df.agg(dedup.surplus_rows(F.col("t"))[0]).first()[0] == 2


def test_first_row_wins_when_one_key_holds_most_rows(spark):
    df = spark.range(0, 5000, 1, 16).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    kept = dedup.keep_first(df, "k", "id")
    assert kept.count() == 1667 + 1
    assert kept.filter("k = 'hot'").first()["id"] == 1


def test_row_numbers_are_contiguous(spark):
    ids = spark.range(0, 40_000_000, 9999, 7)
    got = index_by_key(ids, "id", "n", start=1).orderBy("id").collect()
    assert [r["n"] for r in got] == list(range(1, len(got) + 1))
    df = ids.withColumn("score", F.col("id") % 3)
    got = index_by_order(df, [F.desc("score"), F.asc("id")], "rank", start=1).collect()
    expected = sorted(((-(r["score"]), r["id"]) for r in got))
    assert [(-r["score"], r["id"]) for r in sorted(got, key=lambda r: r["rank"])] == expected
    assert sorted(r["rank"] for r in got) == list(range(1, len(got) + 1))


def test_quotas_reproduce_the_published_split():
    counts = {0: 143_138, 1: 16_175}
    rest, test = splits.part_sizes(159_313, 0.15)
    quota = splits.class_quotas(counts, rest)
    assert test == 23_897 and {c: counts[c] - quota[c] for c in counts} == {0: 21_471, 1: 2_426}
    train, val = splits.part_sizes(rest, 0.15 / 0.85)
    assert (train, val) == (111_519, 23_897)
    assert splits.class_quotas(quota, train) == {0: 100_196, 1: 11_323}


@pytest.fixture(scope="module")
def big(spark):
    return spark.range(0, 130_000, 1, 6).select(
        F.format_string("s_%08d", "id").alias("sample_id"), (F.col("id") % 11 == 0).cast("int").alias("binary_label")
    )


def test_split_is_exact_disjoint_and_independent_of_partitioning(spark, big):
    one = splits.stratified_split3(big)
    got = {tuple(r[:2]): r[2] for r in one.groupBy("split", "binary_label").count().collect()}
    n, pos = 130_000, 11_819
    rest, test = splits.part_sizes(n, 0.15)
    train, val = splits.part_sizes(rest, 0.15 / 0.85)
    assert {s: got[(s, 0)] + got[(s, 1)] for s in ("train", "val", "test")} == {"train": train, "val": val, "test": test}
    assert all(abs(got[(s, 1)] / (got[(s, 0)] + got[(s, 1)]) - pos / n) < 1e-4 for s in ("train", "val", "test"))
    two = splits.stratified_split3(big.repartition(3, "sample_id"))
    assert one.exceptAll(two).isEmpty()


def test_radix_cut_equals_a_full_sort(spark, big, monkeypatch):
    keyed = big.withColumn("k", splits.order_key(7))
    expected = {
        c: sorted(r["k"] for r in keyed.filter(F.col("binary_label") == c).select("k").collect())[n - 1]
        for c, n in ((0, 70_000), (1, 17))
    }
    counts = {0: 118_181, 1: 11_819}
    assert splits.key_cuts(keyed, "binary_label", "k", {0: 70_000, 1: 17}, counts) == expected
    monkeypatch.setattr(splits, "_RANKABLE", 3)
    assert splits.key_cuts(keyed, "binary_label", "k", {0: 70_000, 1: 17}, counts) == expected


def test_samples_and_split_guards(spark, big):
    assert splits.capped_sample(big, 33_333).count() == 33_333
    assert splits.capped_sample(big, 999_999).count() == 130_000
    assert splits.capped_sample(big, 1).count() == 1
    assert splits.capped_sample(big, 0).count() == 0
    small = big.filter("sample_id < 's_00000012'").filter("sample_id <> 's_00000000'")
    with pytest.raises(ValueError):
        splits.stratified_split2(small)


def test_repeated_ids_split_exactly_or_fail(spark, monkeypatch):
    """30,000 rows of one id: taken whole where a cut allows it, else a clear error."""
    rows = spark.range(0, 30_000, 1, 4).select(F.lit("same").alias("sample_id"), F.lit(0).alias("binary_label"))
    with pytest.raises(ValueError, match="30000 rows of class 0 share one id"):
        splits.stratified_split2(rows)
    few = rows.limit(30)
    with pytest.raises(ValueError, match="share one id"):
        splits.stratified_split2(few)
    # 30,000 of 37,500 rows share an id; a cut that takes all or none of them is exact.
    others = spark.range(0, 7_500, 1, 4).select(F.col("id").cast("string").alias("sample_id"), F.lit(0).alias("binary_label"))
    keyed = rows.union(others).withColumn("k", splits.order_key(44))
    before = keyed.filter(F.col("k") < keyed.filter("sample_id = 'same'").first().k).count()
    cuts = splits.key_cuts(keyed, "binary_label", "k", {0: before + 30_000}, {0: 37_500})
    assert keyed.filter(F.col("k") <= cuts[0]).count() == before + 30_000
    with pytest.raises(ValueError, match="share one id"):
        splits.key_cuts(keyed, "binary_label", "k", {0: before + 29_999}, {0: 37_500})


def test_rows_without_a_class_are_an_error(spark):
    rows = spark.createDataFrame([(str(i), i % 2 if i else None) for i in range(50)], "sample_id string, binary_label int")
    with pytest.raises(ValueError, match="1 rows have no class"):
        splits.stratified_split3(rows)


def test_head_subset_takes_the_first_ids_of_each_split(spark):
    rows = spark.range(0, 3000, 1, 6).select(
        F.concat(F.lit("s_"), F.col("id").cast("string")).alias("sample_id"),
        F.when(F.col("id") % 3 == 0, "test").when(F.col("id") % 3 == 1, "train").otherwise("other").alias("split"), "id")
    head = splits.head_subset(rows, {"test": 7, "train": 2000, "val": 5})
    got = sorted((r.split, r.id) for r in head.collect())
    assert got == [("test", 3 * i) for i in range(7)] + [("train", 3 * i + 1) for i in range(1000)]
    assert "TakeOrdered" not in head._jdf.queryExecution().executedPlan().toString()


def test_length_buckets(spark):
    df = spark.createDataFrame([(n,) for n in (0, 5, 6, 9, 10)], "word_len int")
    limits = slices.LengthThresholds(5, 9)
    assert [r[0] for r in df.select(slices.length_bucket(F.col("word_len"), limits)).collect()] == [
        "short", "short", "medium", "medium", "long"]
    flat = spark.createDataFrame([(4,)] * 5, "word_len int")
    assert slices.length_thresholds(flat) == slices.LengthThresholds(4, 5)
    zero = spark.createDataFrame([(0,)] * 5, "word_len int")
    assert slices.length_thresholds(zero) == slices.LengthThresholds(1, 2)


def test_flags(spark):
    df = spark.createDataFrame(
        [("a black cat", 1, 0.2, None), ("you idiot", 1, 0.5, "x"), ("fine", 0, None, "0.9")],
        "text_clean string, binary_label int, female double, muslim string")
    by_term = slices.add_flags(df).collect()
    assert [(r["has_identity_term"], r["implicit_proxy"]) for r in by_term] == [(1, 1), (0, 0), (0, 0)]
    by_score = slices.add_flags(df, score_columns=("female", "muslim", "absent")).collect()
    assert [r["has_identity_term"] for r in by_score] == [0, 1, 1]


def test_slice_summary_keeps_the_null_group(spark):
    df = spark.createDataFrame([(1, "a", 1), (None, "a", 0), (1, "b", 0)], "f int, g string, binary_label int")
    got = {(r["slice"], r["value"]): (r["row_count"], r["label_0"], r["label_1"]) for r in slices.slice_summary(df, ("f", "g")).collect()}
    assert got == {("f", "1"): (2, 1, 1), ("f", None): (1, 1, 0), ("g", "a"): (2, 1, 1), ("g", "b"): (1, 1, 0)}


def test_overlap_and_gate(spark):
    rows = [("train", f"h{i:02d}") for i in range(15)] + [("test", f"h{i:02d}") for i in range(12)] + [("val", "v"), ("val", "h03"), ("val", "h03")]
    df = spark.createDataFrame(rows, "split string, h string")
    got = {r["pair"]: (r["overlap_count"], r["example_hashes"]) for r in leakage.split_hash_overlap(df, ("train", "val", "test"), ("h",)).collect()}
    assert got["test__train"] == (12, [f"h{i:02d}" for i in range(10)])
    assert got["test__val"] == (1, ["h03"]) and got["train__val"] == (1, ["h03"])
    clean = leakage.split_hash_overlap(df.filter("h > 'h11'"), ("train", "val", "test"), ("h",))
    assert all(r["overlap_count"] == 0 and r["example_hashes"] == [] for r in clean.collect()) and clean.count() == 3
    assert leakage.leakage_gate(clean, "x") == []
    with pytest.raises(ValidationError):
        leakage.leakage_gate(leakage.split_hash_overlap(df, ("train", "val", "test"), ("h",)), "x")


def test_gates_stand_in_the_plan(spark):
    rows = spark.createDataFrame([("train", "a"), ("test", "a"), ("val", "b")], "split string, h string")
    overlaps = leakage.split_hash_overlap(rows, ("train", "val", "test"), ("h",))
    strict = leakage.gated(rows, overlaps, "x")
    for read in (strict.collect, lambda: strict.write.format("noop").mode("overwrite").save()):
        with pytest.raises(Exception, match="x leakage detected by hash overlap: h test__train: 1"):
            read()
    assert [r.message for r in leakage.leakage_warnings(overlaps, "x").collect()] == [
        "x leakage detected by hash overlap: h test__train: 1."]
    clean = leakage.split_hash_overlap(rows.filter("split <> 'test'"), ("train", "val", "test"), ("h",))
    assert leakage.gated(rows, clean, "x").count() == 3 and leakage.leakage_warnings(clean, "x").isEmpty()
    report = leakage.overlap_report(leakage.pool_external_overlap(
        *[rows.filter(F.col("split") == s).select(F.col("h").alias("text_hash_normalized")) for s in ("train", "test")]))
    with pytest.raises(ValidationError, match="1 normalised texts"):
        leakage.pool_external_gate(report, "scored")
    assert len(leakage.pool_external_gate(report, "scored", strict=False)) == 1
    none = leakage.overlap_report(rows.select(F.col("h").alias("text_hash_normalized")).limit(0))
    assert leakage.pool_external_gate(none, "scored") == []


def test_token_lengths_can_be_required(spark, tmp_path):
    from parley.plans import prep
    from parley.settings import MULTILABEL_LABELS

    zero = ",".join("0" for _ in MULTILABEL_LABELS[1:])
    lines = [f"text {i},{i % 2},{zero}" for i in range(400)]
    (tmp_path / "raw.csv").write_text("\n".join(["comment_text," + ",".join(MULTILABEL_LABELS), *lines]))
    from parley.sources.corpus import load_multilabel

    raw = load_multilabel(spark, str(tmp_path / "raw.csv"))
    with pytest.raises(ValidationError, match="token lengths are required"):
        prep.prepare_main(raw, PrepSettings(require_token_lengths=True))
    codes = [w[1] for w in prep.prepare_main(raw).validation.warnings]
    assert codes[0] == "token_lengths_missing"
    measured = prep.prepare_main(raw, PrepSettings(require_token_lengths=True), lambda c: F.length(c))
    assert "token_lengths_missing" not in [w[1] for w in measured.validation.warnings]


def test_token_diagnostics_and_empty_profiles(spark):
    none = spark.createDataFrame([(None,)], "bert_token_len int")
    assert validation.token_length_diagnostics(none).first()["available"] is False
    empty = spark.createDataFrame([], "t string")
    assert tuple(audit.feature_fractions(empty, "t").first()) == (0.0,) * 5
    assert audit.length_stats(empty, "t").count() == 0


def test_drift_and_small_splits(spark):
    rows = [("a", i % 2) for i in range(200)] + [("b", 1)] * 50
    by_split = validation.class_distribution_by_split(spark.createDataFrame(rows, "split string, binary_label int"))
    drift = {r["split"]: r for r in validation.label_drift(by_split).collect()}
    assert drift["a"]["overall_ratio"] == 0.6 and math.isclose(drift["b"]["drift"], 0.4) and drift["b"]["exceeds_limit"]
    assert [tuple(r) for r in validation.small_splits(by_split).collect()] == [("b", 50)]


def test_validate_dataset_returns_drift_warnings(spark, sf, monkeypatch):
    split = F.when(F.col("binary_label") == 1, "val").otherwise("train")
    drifting = inputs.split_corpus(spark, sf).withColumn("split", split).cache()
    monkeypatch.setattr(inputs, "split_corpus", lambda *_: drifting)
    found = [r for r in catalog.QUERIES["validate_dataset"](spark, sf).collect() if r["code"] == "label_drift"]
    share = drifting.agg(F.avg("binary_label")).first()[0]
    assert [tuple(r) for r in found] == [(
        "multilabel", "label_drift", "multilabel label-ratio drift across splits exceeds 0.03: "
        f"train {share:.6f}, val {1 - share:.6f}.")]


TRAIN = [("you are an idiot idiot", 1), ("what an idiot", 1), ("lovely day today", 0), ("a lovely idea", 0), ("lovely lovely people", 0)]


def test_tfidf_weights_by_hand(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TRAIN)], "id long, text string")
    vocab = {r["term"]: (r["tf"], r["df"]) for r in tfidf.vocabulary(df, "text").collect()}
    assert vocab == {"idiot": (3, 2), "an": (2, 2), "an idiot": (2, 2), "lovely": (4, 3)}
    model = tfidf.fit_tfidf(df, "text", max_features=3)
    assert model.terms == ("an", "idiot", "lovely")
    idf = {"an": math.log(6 / 3) + 1, "idiot": math.log(6 / 3) + 1, "lovely": math.log(6 / 4) + 1}
    raw = {"idiot": (1 + math.log(2)) * idf["idiot"], "an": idf["an"]}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    got = {r["term"]: r["weight"] for r in tfidf.tfidf_long(df, "id", "text", model).filter("id = 0").collect()}
    assert got.keys() == raw.keys() and all(math.isclose(got[t], raw[t] / norm) for t in raw)


def _loss(weights, rows, penalty):
    value = sum(w * w for w in weights[:-1]) / 2
    for x, y, s in rows:
        z = weights[-1] + sum(weights[i] * v for i, v in x)
        value += penalty * s * math.log1p(math.exp(-z if y else z))
    return value


def test_logistic_minimises_the_balanced_penalised_loss(spark, tmp_path):
    df = spark.createDataFrame(TRAIN, "text_tfidf string, binary_label int")
    weights = {r["binary_label"]: r["weight"] for r in balanced_class_weights(df).collect()}
    assert weights == {0: 5 / 6, 1: 5 / 4}
    scorer = fit_logistic(df)
    rows = [
        (list(zip(r["tfidf"]["indices"], r["tfidf"]["weights"])), r["binary_label"], weights[r["binary_label"]])
        for r in scorer.features.weights(df, "text_tfidf").collect()
    ]
    best = [*scorer.coefficients, scorer.intercept]
    base = _loss(best, rows, 1.0)
    for i in range(len(best)):
        for step in (-0.02, 0.02):
            moved = list(best)
            moved[i] += step
            assert _loss(moved, rows, 1.0) > base
    path = str(tmp_path / "model")
    scorer.save(spark, path)
    assert LinearScorer.load(spark, path) == scorer
    scored = score_comments(df.select(F.col("text_tfidf").alias("t")), "t", scorer).collect()
    assert [r["numeric_label"] for r in scored] == [1, 1, 0, 0, 0]
    for r, (x, _, _) in zip(scored, rows):
        z = scorer.intercept + sum(scorer.coefficients[i] * v for i, v in x)
        assert math.isclose(r["toxic_probability"], 1 / (1 + math.exp(-z)))
    with pytest.raises(ValueError):
        score_comments(df.withColumn("threshold", F.lit(1)), "text_tfidf", scorer)


def test_metrics_of_degenerate_predictions(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "y int, p int")
    row = metrics.binary_metrics(df, "y", "p").first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"]) == (0.5, 0.0, 0.0, 0.0)
    cells = {(r[0], r[1]): r[2] for r in metrics.confusion_matrix(df, "y", "p").collect()}
    assert cells == {(0, 0): 1, (0, 1): 0, (1, 0): 1, (1, 1): 0}


def test_json_summary(spark):
    from parley.sinks.tables import summary_json

    df = spark.createDataFrame([("b", float("nan"), None)], "z string, a double, m long")
    assert json.loads(summary_json(df).first()[0]) == {"a": None, "m": None, "z": "b"}


def test_schema_error_lists_columns(spark, tmp_path):
    from parley.sources.corpus import load_multilabel, load_scored_optional

    path = str(tmp_path / "bad.csv")
    (tmp_path / "bad.csv").write_text("comment_text,toxic\na,1\n")
    with pytest.raises(SchemaError, match="severe_toxic.*Found columns"):
        load_multilabel(spark, path)
    with pytest.raises(FileNotFoundError):
        load_multilabel(spark, str(tmp_path / "none.csv"))
    assert load_scored_optional(spark, str(tmp_path / "none.csv")) == (None, None)
    (tmp_path / "s.csv").write_text('text,comment_text,toxicity,target,white\n"a,""b""\nc",NA,0.1,0.7,\n')
    df, schema = load_scored_optional(spark, str(tmp_path / "s.csv"))
    assert (schema.text_column, schema.label_column, schema.identity_columns) == ("comment_text", "target", ("white",))
    assert tuple(df.first()) == (0, None, "0.7", None)


def test_malformed_corpus_rows_fail_or_are_counted(spark, tmp_path):
    from parley.settings import MULTILABEL_LABELS
    from parley.sources.corpus import batch_score_csv, load_multilabel, load_scored_optional

    head = "comment_text," + ",".join(MULTILABEL_LABELS)
    (tmp_path / "m.csv").write_text(f'{head}\n"a\nb",1,0,0,0,0,0\nc,1,0,0,0,0,0,9\nd,0\n')
    with pytest.raises(SchemaError, match="1 malformed rows, the first on line 4"):
        load_multilabel(spark, str(tmp_path / "m.csv"))
    warnings = []
    rows = load_multilabel(spark, str(tmp_path / "m.csv"), on_malformed="drop", warnings=warnings)
    got = [(r.source_row_index, r.comment_text, r.toxic, r.threat) for r in rows.orderBy("source_row_index").collect()]
    assert got == [(0, "a\nb", "1", "0"), (2, "d", "0", None)]
    ((source, code, message),) = warnings
    assert (source, code) == ("multilabel", "malformed_rows") and "line 4" in message
    (tmp_path / "s.csv").write_text("text,toxicity\nx,0.5\ny,0.1,z\n")
    with pytest.raises(SchemaError, match="malformed"):
        load_scored_optional(spark, str(tmp_path / "s.csv"))
    with pytest.raises(SchemaError, match="malformed"):
        batch_score_csv(spark, str(tmp_path / "s.csv"), inputs.length_scorer)
    scored = batch_score_csv(spark, str(tmp_path / "s.csv"), inputs.length_scorer, on_malformed="drop")
    assert [r.text for r in scored.collect()] == ["x"]


def test_terms_are_counted_and_weighed_in_steps(monkeypatch):
    """Steps of any size give the same counts; pairs do not cross texts."""
    import pyarrow as pa

    texts = [["a1", "b1", "a1", "b1"], [], ["b1"], ["b1", "a1"], ["zz", "b1", "zz"]]
    words = pa.array(texts, pa.list_(pa.string()))
    wanted = {}
    for text in texts:
        terms = text + [f"{a} {b}" for a, b in zip(text, text[1:])]
        for term in set(terms):
            tf, df = wanted.get(term, (0, 0))
            wanted[term] = (tf + terms.count(term), df + 1)
    known, idf = ("a1", "a1 b1", "b1"), (1.5, 2.0, 1.25)
    for size in (1, 3, 1 << 19):
        monkeypatch.setattr(tfidf, "STEP_WORDS", size)
        found = {}
        for batch in tfidf._term_counts([pa.record_batch([words], ["words"])]):
            for r in batch.to_pylist():
                tf, df = found.get(r["term"], (0, 0))
                found[r["term"]] = (tf + r["tf"], df + r["df"])
        assert found == wanted
        got = tfidf._weigher(known, idf)(words).to_pylist()
        assert [r["indices"] for r in got] == [[0, 1, 2], [], [2], [0, 2], [2]]
        raw = [(math.log(2) + 1) * 1.5, (math.log(2) + 1) * 2.0, (math.log(2) + 1) * 1.25]
        norm = math.sqrt(sum(x * x for x in raw))
        assert got[0]["weights"] == pytest.approx([x / norm for x in raw])
    assert tfidf._weigher(known, idf)(words.slice(0, 0)).to_pylist() == []


def test_weights_count_without_rows_of_terms(spark):
    """Neither the vocabulary nor the weights make a row, or a JVM vector, of every term."""
    df = spark.createDataFrame([("ab cd ab",), ("cd ef",), (None,)], "text string")
    model = tfidf.fit_tfidf(df, "text", min_df=1)
    weighed = model.weights(df, "text")
    plan = weighed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "UDF(" not in plan
    assert [len(r.tfidf.indices) for r in weighed.collect()] == [4, 3, 0]


SCORED_ROWS = "sample_id string, split string, binary_label int, has_identity_term int, has_obfuscation int, implicit_proxy int, raw_text string, text_clean string"


def scored_rows(spark, n=40):
    return spark.createDataFrame([
        (f"s_{i:08d}", None if i == 7 else "external_test" if i % 5 == 0 else "aug_pool", i % 2,
         None if i == 3 else int(i % 3 == 0), int(i % 4 == 0), int(i % 7 == 0), f' "a", {i}\nb ', f"a {i} b")
        for i in range(n)], SCORED_ROWS)


def test_scored_outputs_are_written_from_one_pass(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        made.add(1)
        return text

    df = scored_rows(spark)
    expected = {n: sorted(t.collect()) for n, t in out.scored_outputs(df, 9).items()}
    texts = df.withColumn("raw_text", told.asNondeterministic()("raw_text"))
    for _ in range(2):  # the second run writes over the first
        made.value = 0
        out.write_scored_outputs(texts, str(tmp_path), 9, index=df)
        assert made.value == 40
        assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == sorted(
            f"{n}.{kind}" for n in expected for kind in ("parquet", "csv"))
        for name, rows in expected.items():
            stored = spark.read.parquet(f"{tmp_path}/{name}.parquet")
            assert stored.columns == df.columns
            assert sorted(map(repr, stored.collect())) == sorted(map(repr, rows))
            copy = files._read_csv(spark, f"{tmp_path}/{name}.csv")
            assert sorted(copy.select("sample_id", "raw_text").collect()) == [(r[0], r[6]) for r in rows]
    assert len(expected["aug_pool_capped"]) == 9
    out.write_scored_outputs(df.filter("split = 'aug_pool'"), str(tmp_path), 9)
    assert spark.read.parquet(f"{tmp_path}/external_test.parquet").count() == 0


def test_copies_of_a_row_are_returned_side_by_side(spark):
    home = scored_rows(spark)
    holds = {"all": F.lit(True), "odd": F.col("binary_label") == 1, "other": F.col("has_obfuscation") == 1}
    tables = {n: {f: home.filter(c) for f in ("parquet", "csv")} for n, c in holds.items()}
    # One cell of a copy differs: this table is returned as it is read.
    tables["other"]["csv"] = tables["other"]["csv"].withColumn(
        "raw_text", F.when(F.col("sample_id") == "s_00000008", "x").otherwise(F.col("raw_text")))
    rows = files._side_by_side(tables, home, holds).collect()
    expected = [(f, *r) for n in holds for f, t in tables[n].items() for r in t.select(
        *files._CELLS, F.lit(n).alias("artefact")).collect()]
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, expected))
    ids = [r["sample_id"] for r in rows if r["artefact"] != "other"]
    assert sum(a != b for a, b in zip(ids, ids[1:])) == len(set(ids)) - 1 == 39


def test_standardize_once_stores_no_text(spark, monkeypatch):
    stored = []
    keep = standardize_module.staged
    monkeypatch.setattr(standardize_module, "staged", lambda df, *a: stored.append(df.columns) or keep(df, *a))
    twice = [*ROWS, (30, "more", None), (31, "two of one row", 1), (31, "two of one row", 1), (31, "else", 0), (None, "none", 1)]
    expected, raw = corpus(spark, twice)
    stored.clear()
    index, rows = standardize_module.standardize_once(raw, "s", "text", F.col("label"), F.lit("{}"))
    assert rows.columns == expected.columns
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, expected.collect()))
    assert sorted(map(repr, index.collect())) == sorted(map(repr, expected.select("sample_id", "binary_label").collect()))
    assert stored and not {"raw_text", "text_clean", "text_tfidf"} & {c for columns in stored for c in columns}
