"""The whole corpus preparation: load, audit, standardise, slice, split, validate, write."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley import settings as cfg
from parley.errors import ValidationError
from parley.functions import labels as lb
from parley.operators import leakage, slices, splits
from parley.operators.audit import audit_facts
from parley.operators.facts import text_facts
from parley.operators.standardize import corpus_from_slim_facts, removals_from_facts
from parley.operators.validation import Validation, text_tables, validate_dataset
from parley.session import remove_scratch, scratch_in, scratch_path, staged, unsorted_writes
from parley.sinks import tables as out
from parley.sources.corpus import ScoredSchema, load_multilabel, load_scored_optional

MAIN_SPLITS = ("train", "val", "test")
SCORED_SPLITS = ("aug_pool", "external_test")
# Adds ``bert_token_len`` given the text column.
TokenLength = Callable[[Column], Column]


@dataclass
class PreparedSource:
    """A split corpus with everything learned about it."""

    corpus: DataFrame
    summaries: dict[str, DataFrame]
    validation: Validation
    thresholds: slices.LengthThresholds


@dataclass
class PrepResult:
    main: PreparedSource
    scored: PreparedSource | None = None
    warnings: list[tuple[str, str, str]] = field(default_factory=list)


def main_label(settings: cfg.PrepSettings, columns: tuple[str, ...] = cfg.MULTILABEL_LABELS) -> Column:
    label = lb.multilabel_to_binary(columns)
    if settings.strict_missing_labels:
        return F.when(~lb.all_missing(columns), label)
    return label


def _token_warnings(
    source: str, settings: cfg.PrepSettings, token_length: TokenLength | None
) -> list[tuple[str, str, str]]:
    """A missing length function is an error where lengths are required, else a warning."""
    if token_length is not None:
        return []
    if settings.require_token_lengths:
        raise ValidationError(f"{source}: token lengths are required, but no length function is given")
    return [(source, "token_lengths_missing",
             f"{source}: no length function is given; bert_token_len is empty.")]


def _gated(split: DataFrame, checks: Validation, settings: cfg.PrepSettings) -> DataFrame:
    """The corpus with the leakage gate in its plan, so that no later step gets around it."""
    if not settings.fail_on_leakage:
        return split
    return leakage.gated(split, checks.tables["hash_overlap_across_splits"], checks.source)


def _flagged(
    corpus: DataFrame,
    settings: cfg.PrepSettings,
    token_length: TokenLength | None,
    score_columns: tuple[str, ...] = (),
) -> DataFrame:
    """The corpus with flags and token lengths."""
    tokens = token_length(F.col("text_clean")) if token_length else F.lit(None).cast("int")
    return slices.add_flags(corpus.withColumn("bert_token_len", tokens), settings, score_columns)


# What the gates and the splits need to know about a row.
_INDEX = ("binary_label", "word_len", "text_hash_raw", "text_hash_normalized")
# Stores a corpus and returns it as a table that reads what was stored.
Store = Callable[[DataFrame], DataFrame]


@dataclass
class _Checked:
    """A source that is past its gates. Its ``corpus`` is a plan, to be written once."""

    corpus: DataFrame
    index: DataFrame
    audit: DataFrame
    removal: DataFrame
    validation: Validation
    thresholds: slices.LengthThresholds


def _checked(
    raw: DataFrame,
    text_column: str,
    label: Column,
    label_info: Column,
    source: str,
    names: tuple[str, ...],
    split_of: Callable[[DataFrame], Column],
    settings: cfg.PrepSettings,
    token_length: TokenLength | None,
    work: str,
    limits: slices.LengthThresholds | None = None,
    identity: tuple[str, ...] = (),
    label_columns: tuple[str, ...] = (),
) -> _Checked:
    """Audit, removals, splits and gates of a source from what is known about its texts.

    No text is stored for it: the corpus normalises those that stay again as it is written. Until
    then it reads tables in the folder ``work``.
    """
    spark = raw.sparkSession
    unmeasured = _token_warnings(source, settings, token_length)
    kept, audit, removal = (scratch_path(spark, n) for n in ("corpus", "audit", "removal"))
    with scratch_in(work):
        known = text_facts(raw, text_column, label, label_info, settings, (), label_columns)
        facts = staged(known.drop("raw_text", "text_clean", "orig_label_info"), "facts")
        index, corpus = corpus_from_slim_facts(
            facts, raw, source, text_column, label, label_info, settings, identity, _INDEX)
        index = staged(index, "corpus", kept)
        audited = staged(audit_facts(facts), "audit", audit)
        removed = staged(removals_from_facts(facts, settings), "removal", removal)
    limits = limits or slices.length_thresholds(index)
    split = split_of(index)
    index = index.withColumn("split", split)
    checks = validate_dataset(index, source, names, settings)
    checks.warnings[:0] = unmeasured
    bucket = slices.length_bucket(F.col("word_len"), limits)
    corpus = (
        _flagged(corpus, settings, token_length, identity)
        .withColumn("length_bucket", bucket).withColumn("split", split)
    )
    return _Checked(_gated(corpus, checks, settings), index, audited, removed, checks, limits)


def _finished(checked: _Checked, store: Store, settings: cfg.PrepSettings,
              summaries: Callable[[DataFrame], dict[str, DataFrame]]) -> PreparedSource:
    """The source with its corpus stored, and summaries that read this."""
    checks = checked.validation
    rows = _gated(store(checked.corpus), checks, settings)
    checks.tables.update(text_tables(rows))
    return PreparedSource(rows, {
        "audit": checked.audit,
        "removal": checked.removal,
        "slice_summary": slices.slice_summary(rows),
        **summaries(rows),
        **checks.tables,
    }, checks, checked.thresholds)


def _check_main(
    raw: DataFrame, settings: cfg.PrepSettings, token_length: TokenLength | None, work: str,
    text_column: str = cfg.MULTILABEL_TEXT, label_columns: tuple[str, ...] = cfg.MULTILABEL_LABELS,
) -> _Checked:
    return _checked(
        raw, text_column, main_label(settings, label_columns), lb.multilabel_json(label_columns),
        settings.multilabel_source, MAIN_SPLITS,
        lambda index: splits.split3_column(index, settings.test_size, settings.val_size, settings.seed),
        settings, token_length, work, label_columns=label_columns)


def _finish_main(checked: _Checked, store: Store, settings: cfg.PrepSettings) -> PreparedSource:
    return _finished(checked, store, settings, lambda rows: {
        # The train target is the fixed 0.70 whatever the sizes are set to.
        "split_summary": splits.split_summary(
            rows, "two-stage stratified hash split", (settings.seed, settings.seed + 1),
            {"train": 0.70, "val": settings.val_size, "test": settings.test_size},
        ),
        "artefact_counts": out.artefact_counts(rows, MAIN_SPLITS),
    })


def prepare_main(
    raw: DataFrame,
    settings: cfg.PrepSettings = cfg.PrepSettings(),
    token_length: TokenLength | None = None,
    text_column: str = cfg.MULTILABEL_TEXT,
    label_columns: tuple[str, ...] = cfg.MULTILABEL_LABELS,
) -> PreparedSource:
    """Prepare the multi-label source. Raises before anything is published if a gate fails."""
    spark = raw.sparkSession
    work, rows = scratch_path(spark, "run"), scratch_path(spark, "rows")
    try:
        checked = _check_main(raw, settings, token_length, work, text_column, label_columns)
        return _finish_main(checked, lambda df: out.store_by_split(df, rows), settings)
    finally:
        remove_scratch(spark, work)


def _check_scored(
    raw: DataFrame, schema: ScoredSchema, limits: slices.LengthThresholds, settings: cfg.PrepSettings,
    token_length: TokenLength | None, work: str,
) -> tuple[_Checked, DataFrame]:
    """The source and the texts that its splits share."""
    text, score, identity = schema.text_column, schema.label_column, schema.identity_columns
    label = lb.score_to_binary(score, settings.score_threshold)
    numeric = raw.withColumns({c: lb.to_number(F.col(c)) for c in identity}) if identity else raw
    checked = _checked(
        numeric, text, label, lb.score_json(score), settings.scored_source, SCORED_SPLITS,
        lambda index: splits.split2_column(index, settings.external_size, settings.seed + 2),
        settings, token_length, work, limits, identity, (score,))
    overlap = staged(leakage.overlap_report(
        leakage.pool_external_overlap(
            *[checked.index.filter(F.col("split") == s) for s in SCORED_SPLITS]
        )
    ), "overlap")
    checked.validation.warnings += [
        (settings.scored_source, "pool_external_overlap", message)
        for message in leakage.pool_external_gate(overlap, settings.scored_source, settings.fail_on_leakage)
    ]
    return checked, overlap


def _finish_scored(
    checked: _Checked, overlap: DataFrame, main_train_rows: int, store: Store,
    settings: cfg.PrepSettings,
) -> PreparedSource:
    return _finished(checked, store, settings, lambda rows: {
        "split_summary": splits.split_summary(
            rows, "stratified hash split", (settings.seed + 2,),
            {"aug_pool": 1.0 - settings.external_size, "external_test": settings.external_size},
        ),
        "pool_external_overlap": overlap,
        "scored_output_counts": out.scored_output_counts(rows, main_train_rows),
    })


def prepare_scored(
    raw: DataFrame,
    schema: ScoredSchema,
    limits: slices.LengthThresholds,
    main_train_rows: int,
    settings: cfg.PrepSettings = cfg.PrepSettings(),
    token_length: TokenLength | None = None,
) -> PreparedSource:
    """Prepare the scored source with the main source's length thresholds."""
    spark = raw.sparkSession
    work, rows = scratch_path(spark, "run"), scratch_path(spark, "rows")
    try:
        checked, overlap = _check_scored(raw, schema, limits, settings, token_length, work)
        return _finish_scored(
            checked, overlap, main_train_rows, lambda df: out.store_by_split(df, rows), settings)
    finally:
        remove_scratch(spark, work)


def run_prep(
    spark: SparkSession,
    multilabel_path: str,
    scored_path: str | None,
    output: str,
    settings: cfg.PrepSettings = cfg.PrepSettings(),
    fmt: str = "csv",
    token_length: TokenLength | None = None,
) -> PrepResult:
    """Run everything and write tables and summaries below ``output``.

    All gates run before the first output is written. Each corpus is stored once, as the published
    tables that hold all its rows; all other outputs are read from these, and the records read are
    removed by then.
    """
    records = scratch_path(spark, "records")
    try:
        with unsorted_writes(spark):
            result, train_rows = _prepared(
                spark, multilabel_path, scored_path, output, settings, fmt, token_length, records)
    finally:
        remove_scratch(spark, records)
    with unsorted_writes(spark):
        publish(result, output, train_rows, settings)
    return result


def _prepared(
    spark: SparkSession,
    multilabel_path: str,
    scored_path: str | None,
    output: str,
    settings: cfg.PrepSettings,
    fmt: str,
    token_length: TokenLength | None,
    records: str,
) -> tuple[PrepResult, int]:
    """Both sources, their records stored in the folder ``records``, and the rows of train."""
    dropped: list[tuple[str, str, str]] = []
    how = {"fmt": fmt, "on_malformed": settings.on_malformed, "warnings": dropped}
    with scratch_in(records):
        raw = load_multilabel(spark, multilabel_path, name=settings.multilabel_source, **how)
        scored_raw, schema = (
            load_scored_optional(spark, scored_path, name=settings.scored_source, **how)
            if scored_path else (None, None)
        )
    main = _check_main(raw, settings, token_length, records)
    train_rows = main.index.filter(F.col("split") == "train").count()
    scored = None if scored_raw is None else _check_scored(
        scored_raw, schema, main.thresholds, settings, token_length, records)
    result = PrepResult(
        _finish_main(main, lambda df: out.store_by_split(df, f"{output}/main/splits.parquet"), settings),
        warnings=dropped + main.validation.warnings)
    if scored is None:
        result.warnings.insert(
            0, (settings.scored_source, "missing_source",
                "Scored source missing; its artefacts are skipped.")
        )
    else:
        result.scored = _finish_scored(
            *scored, train_rows, lambda df: out.store_scored(df, f"{output}/scored"), settings)
        result.warnings += result.scored.validation.warnings
    return result, train_rows


def publish(result: PrepResult, output: str, train_rows: int, settings: cfg.PrepSettings) -> None:
    """Write all that is read from the stored corpora; independent outputs share the cluster
    instead of queueing."""
    main, scored = result.main, result.scored
    spark = main.corpus.sparkSession
    warnings = spark.createDataFrame(result.warnings, "source string, code string, message string")
    jobs = [
        lambda: out.write_split_copy(spark, f"{output}/main"),
        lambda: out.write_slice_tables(main.corpus, f"{output}/main"),
        lambda: out.export_simple(main.corpus, f"{output}/main"),
        lambda: out.write_summaries({"warnings": warnings}, f"{output}/metadata"),
    ]
    for name, table in main.summaries.items():
        jobs.append(lambda n=name, t=table: out.write_summaries({n: t}, f"{output}/metadata/main"))
    if scored is not None:
        for name, table in out.scored_outputs(scored.corpus, train_rows, settings).items():
            # The disjoint tables are stored: of these only the copies are made.
            if name in out.DISJOINT:
                jobs.append(lambda n=name, t=table: out.write_csv(t, f"{output}/scored/{n}.csv"))
            else:
                jobs.append(lambda n=name, t=table: out.write_both(t, f"{output}/scored/{n}"))
        for name, table in scored.summaries.items():
            jobs.append(
                lambda n=name, t=table: out.write_summaries({n: t}, f"{output}/metadata/scored")
            )
    with ThreadPoolExecutor(max_workers=6) as pool:
        for done in [pool.submit(job) for job in jobs]:
            done.result()
