"""Source and sink queries: Spark writes files from the tables, the library reads or writes them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.catalog import inputs, sql
from parley.catalog.corpus import SQL as CORPUS_SQL
from parley.catalog.review import conversations_csv
from parley.operators import slices, splits, validation
from parley.plans import prep
from parley.session import scratch_path, scratch_scope, staged
from parley.sinks import tables as out
from parley.sources import corpus as src
from parley.sources import uploads

QUERIES, SQL = {}, {}


def query(name: str, statement: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if statement is not None:
            SQL[name] = statement
        return fn

    return add


def _csv(df, spark, name: str, **options: str) -> str:
    path = scratch_path(spark, name)
    df.write.options(header=True, quote='"', escape='"', **options).csv(path)
    return path


def _read_csv(spark, path):
    return spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)


# Tables that are read in more file splits than this are sorted as a whole.
_SPLITS = 10_000


def _ranges(rows: DataFrame, key: str) -> DataFrame | None:
    """The range of keys of each file split and its place in their order, if no two ranges overlap
    and no row changes its task before it is written; else None."""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    if re.search(r"(?<!Broadcast)Exchange", plan):
        return None
    found = (
        rows.groupBy(*inputs.SPLIT)
        .agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count_if(F.col(key).isNull()).alias("nulls"))
        .limit(_SPLITS + 1).collect()
    )
    if not 0 < len(found) <= _SPLITS or any(r.nulls for r in found):
        return None
    found.sort(key=lambda r: r.low)
    if any(a.high >= b.low for a, b in zip(found, found[1:])):
        return None
    names = ", ".join(f"{c} {t}" for c, t in zip(inputs.SPLIT, ("string", "long")))
    return rows.sparkSession.createDataFrame(
        [(r[0], r[1], r.low, r.high, f"{i:05d}") for i, r in enumerate(found)],
        f"{names}, low long, high long, place string")


def _ordered_csv(rows: DataFrame, spark, name: str, **options: str) -> str:
    """The rows as CSV files whose names follow the order of ``source_row_index``.

    Tables whose file splits already hold one range of keys each are sorted split by split, others
    as a whole, for which all texts are shuffled.
    """
    key = "source_row_index"
    ranges = _ranges(rows, key)
    if ranges is None:
        return _csv(rows.orderBy(key).drop(key, *inputs.SPLIT), spark, name, **options)
    moved = F.raise_error(F.lit("the tables were split anew while they were read")).cast("string")
    place = F.when(F.col(key).between(F.col("low"), F.col("high")), F.col("place")).otherwise(moved)
    placed = (
        rows.join(F.broadcast(ranges), list(inputs.SPLIT), "left").withColumn("place", place)
        .sortWithinPartitions("place", key).drop(key, "low", "high", *inputs.SPLIT)
    )
    path = scratch_path(spark, name)
    placed.write.partitionBy("place").options(header=True, quote='"', escape='"', **options).csv(path)
    return path


def _multilabel_csv(spark, sf_dir, **options: str) -> str:
    return _ordered_csv(inputs.labelled(spark, sf_dir, inputs.SPLIT), spark, "multilabel", **options)


def _scored_csv(spark, sf_dir, **options: str) -> str:
    return _ordered_csv(inputs.scored(spark, sf_dir, inputs.SPLIT), spark, "scored", **options)


@query(
    "load_multilabel",
    f"WITH {sql.LABELLED} SELECT row_number() OVER (ORDER BY source_row_index) - 1 AS source_row_index, source_row_index::VARCHAR AS id, "
    "comment_text, toxic::VARCHAR AS toxic, '0' AS severe_toxic, obscene::VARCHAR AS obscene, NULL::VARCHAR AS threat, '0' AS insult, '0' AS identity_hate FROM labelled",
)
def load_multilabel(spark, sf_dir):
    return src.load_multilabel(spark, _multilabel_csv(spark, sf_dir))


@query(
    "load_scored_optional",
    f"WITH {sql.SCORED} SELECT row_number() OVER (ORDER BY source_row_index) - 1 AS source_row_index, text, round(toxicity, 6) AS toxicity, "
    "round(female, 6) AS female, round(muslim, 6) AS muslim FROM scored_raw",
)
def load_scored_optional(spark, sf_dir):
    df, schema = src.load_scored_optional(spark, _scored_csv(spark, sf_dir))
    names = (schema.label_column, *schema.identity_columns)
    numbers = [F.round(F.col(c).cast("double"), 6).alias(c) for c in names]
    return df.select("source_row_index", schema.text_column, *numbers)


@query(
    "upload_csv_comments",
    "SELECT row_id, text FROM (SELECT row_number() OVER (ORDER BY conv_id, turn) AS row_id, "
    r"regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM conversations) WHERE text <> ''",
)
def upload_csv_comments(spark, sf_dir):
    return uploads.parse_upload(spark, conversations_csv(spark, sf_dir), "text")


@query(
    "upload_txt_comments",
    "WITH lines AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM conversations) "
    "SELECT row_id, text FROM (SELECT row_number() OVER (ORDER BY conv_id, turn, i) AS row_id, "
    r"regexp_replace(line, '^\s+|\s+$', '', 'g') AS text FROM lines) WHERE text <> ''",
)
def upload_txt_comments(spark, sf_dir):
    path = scratch_path(spark, "upload") + ".txt"
    rows = inputs.table(spark, sf_dir, "conversations").orderBy("conv_id", "turn")
    rows.select("text").write.text(path)
    return uploads.parse_upload(spark, path)


@query(
    "upload_inspect",
    "SELECT 'csv' AS file_type, 'conv_id,turn,role,text' AS columns, 'text' AS default_text_column, "
    r"count(*) FILTER (regexp_replace(text, '\s', '', 'g') <> '') AS valid_comment_count FROM conversations",
)
def upload_inspect(spark, sf_dir):
    return uploads.upload_inspect(spark, conversations_csv(spark, sf_dir))


_P = f"(((length({sql.clean('text')}) * 7919) % 10007)::DOUBLE / 10006.0::DOUBLE)"


@query(
    "batch_score_csv",
    f"SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, {sql.clean('text')} AS cleaned_text, {_P} AS toxic_probability, "
    f"({_P} >= 0.5)::INTEGER AS numeric_label FROM conversations",
)
def batch_score_csv(spark, sf_dir):
    scored = src.batch_score_csv(spark, conversations_csv(spark, sf_dir), inputs.length_scorer)
    return scored.select("conv_id", "turn", "cleaned_text", "toxic_probability", "numeric_label")


_COLUMNS = "sample_id, split, binary_label, raw_text, text_clean"
_CELLS = ("sample_id", "split", "binary_label", "raw_text", "text_clean")


def _tagged(rows: DataFrame, artefact: Column, form: Column) -> DataFrame:
    cells = [F.col(c).cast("int") if c == "binary_label" else F.col(c) for c in _CELLS]
    return rows.select(form.alias("format"), *cells, artefact.alias("artefact"))


def _stored(spark, path: str) -> dict[str, DataFrame]:
    """A table's Parquet files and their CSV copy."""
    copy = _read_csv(spark, f"{path}.csv")
    return {
        "parquet": spark.read.parquet(f"{path}.parquet"),
        **({"csv": copy} if copy.columns else {}),
    }


def _sums(rows: DataFrame) -> DataFrame:
    """Rows and two exact sums of digests of all cells, of each table in each format."""
    cells = [x for c in _CELLS for x in (F.col(c), F.col(c).isNull())]
    digests = [F.xxhash64(F.lit(seed), *cells).cast("decimal(20,0)") for seed in (1, 2)]
    return rows.groupBy("artefact", "format").agg(F.count(F.lit(1)), *map(F.sum, digests))


def _side_by_side(
    tables: dict[str, dict[str, DataFrame]], home: DataFrame, holds: dict[str, Column]
) -> DataFrame:
    """All rows of all formats of ``tables``, the copies of a row next to each other.

    ``home`` are stored rows, of which each table should hold those that meet its condition. All
    files are read and summed up first: a table with other rows, in either format, is returned as
    it is read. Copies that stand apart would take several times the space when they are written.
    """
    read = {n: [_tagged(rows, F.lit(n), F.lit(f)) for f, rows in forms.items()] for n, forms in tables.items()}
    name = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in holds.items()])))
    every = [*(rows for forms in read.values() for rows in forms), _tagged(home, name, F.lit("home"))]
    found = {(r[0], r[1]): r[2:] for r in _sums(reduce(DataFrame.unionByName, every)).collect()}
    equal = [n for n in tables
             if found.get((n, "parquet")) == found.get((n, "csv")) == found.get((n, "home"))]
    parts = [rows for n in tables if n not in equal for rows in read[n]]
    if equal:
        copies = F.array_compact(F.array(*[
            F.when(holds[n], F.struct(F.lit(f).alias("format"), F.lit(n).alias("artefact")))
            for n in equal for f in ("parquet", "csv")]))
        rows = home.withColumn("__copy", F.explode(copies))
        parts.append(_tagged(rows, F.col("__copy.artefact"), F.col("__copy.format")))
    return reduce(DataFrame.unionByName, parts)


def _one_table(spark, path: str) -> DataFrame:
    stored = spark.read.parquet(f"{path}.parquet")
    name = path.rsplit("/", 1)[1]
    return _side_by_side({name: _stored(spark, path)}, stored, {name: F.lit(True)})


@query(
    "write_split_tables",
    f"WITH {sql.MAIN} SELECT f AS format, sample_id, split, binary_label, raw_text, text_clean FROM main, (VALUES ('csv'), ('parquet')) t(f)",
)
def write_split_tables(spark, sf_dir):
    folder = scratch_path(spark, "tables")
    out.write_split_tables(inputs.split_corpus(spark, sf_dir), folder)
    return _one_table(spark, f"{folder}/splits").drop("artefact")


@query(
    "write_slice_tables",
    f"WITH {sql.MAIN}, t AS ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS artefact, {_COLUMNS} FROM main WHERE {f} = 1" for n, f in out.SLICE_FLAGS.items()
    )
    + ") SELECT f AS format, t.* FROM t, (VALUES ('csv'), ('parquet')) v(f)",
)
def write_slice_tables(spark, sf_dir):
    folder = scratch_path(spark, "tables")
    out.write_slice_tables(inputs.split_corpus(spark, sf_dir), folder)
    return reduce(DataFrame.unionByName, [_one_table(spark, f"{folder}/{n}") for n in out.SLICE_FLAGS])


@query(
    "export_simple",
    f"WITH {sql.MAIN} SELECT raw_text, {sql.export('text_clean')} AS clean_text, binary_label AS label, split FROM main",
)
def export_simple(spark, sf_dir):
    folder = scratch_path(spark, "tables")
    out.export_simple(inputs.split_corpus(spark, sf_dir), folder)
    return _read_csv(spark, f"{folder}/simple.csv").select(
        "raw_text", F.coalesce("clean_text", F.lit("")).alias("clean_text"),
        F.col("label").cast("int"), "split",
    )


_SCORED_TABLES = {
    "aug_pool_full": "split = 'aug_pool'",
    "external_test": "split = 'external_test'",
    "aug_pool_identity": "split = 'aug_pool' AND has_identity_term = 1",
    "obfuscation_slice": "has_obfuscation = 1",
    "implicit_proxy_slice": "implicit_proxy = 1",
}


_CAPPED = (
    "SELECT * FROM pool WHERE split = 'aug_pool' "
    "QUALIFY row_number() OVER (ORDER BY sha256('46|' || sample_id)) <= (SELECT count(*) FROM main WHERE split = 'train')"
)


@query(
    "write_scored_outputs",
    f"WITH {sql.MAIN}, {sql.POOL}, t AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS artefact, {_COLUMNS} FROM pool WHERE {c}" for n, c in _SCORED_TABLES.items())
    + f" UNION ALL SELECT 'aug_pool_capped', {_COLUMNS} FROM ({_CAPPED})) SELECT f AS format, t.* FROM t, (VALUES ('csv'), ('parquet')) v(f)",
)
def write_scored_outputs(spark, sf_dir):
    """Every row of every file is read back. The disjoint tables hold all rows between them."""
    folder = scratch_path(spark, "tables")
    index, corpus = inputs.split_scored_once(spark, sf_dir)
    holds = out.write_scored_outputs(
        corpus, folder, inputs.main_train_rows(spark, sf_dir), index=index
    )
    home = [spark.read.parquet(f"{folder}/{n}.parquet") for n in out.DISJOINT]
    tables = {n: _stored(spark, f"{folder}/{n}") for n in holds}
    return _side_by_side(tables, reduce(DataFrame.unionByName, home), holds)


@query(
    "scored_output_counts",
    f"WITH {sql.MAIN}, {sql.POOL} SELECT 'aug_pool_full' AS artefact, count(*) FILTER (split = 'aug_pool') AS rows FROM pool "
    "UNION ALL SELECT 'external_test', count(*) FILTER (split = 'external_test') FROM pool "
    "UNION ALL SELECT 'aug_pool_capped', least((SELECT count(*) FROM main WHERE split = 'train'), count(*) FILTER (split = 'aug_pool')) FROM pool "
    "UNION ALL SELECT 'aug_pool_identity', count(*) FILTER (split = 'aug_pool' AND has_identity_term = 1) FROM pool",
)
def scored_output_counts(spark, sf_dir):
    return out.scored_output_counts(
        inputs.split_scored(spark, sf_dir), inputs.main_train_rows(spark, sf_dir)
    )


# Each summary with its columns in the order in which a row of it is told.
_SUMMARIES = {
    "slice_summary": ("slice", "value", "row_count", "label_0", "label_1", "positive_ratio"),
    "split_summary": ("split", "rows", "target_ratio", "method", "stratify_column", "random_seeds"),
    "class_distribution_by_split": ("split", "row_count", "label_0", "label_1", "positive_ratio"),
    "label_drift": ("split", "positive_ratio", "overall_ratio", "drift", "exceeds_limit"),
    "counts": ("artefact", "rows"),
}
_DOUBLES = ("positive_ratio", "target_ratio", "overall_ratio", "drift")
_COUNTS = (
    f"WITH {sql.MAIN} SELECT split AS artefact, count(*) AS rows FROM main GROUP BY split "
    + "".join(f"UNION ALL SELECT '{n}', count(*) FILTER ({f} = 1) FROM main " for n, f in out.SLICE_FLAGS.items())
)


def _told(columns) -> str:
    cells = (f"printf('%.4f', {c})" if c in _DOUBLES else f"coalesce({c}::VARCHAR, '-')" for c in columns)
    return " || '|' || ".join(cells)


@query(
    "write_summaries",
    " UNION ALL ".join(
        f"SELECT '{n}' AS summary, {_told(c)} AS line FROM ({CORPUS_SQL.get(n, _COUNTS)})" for n, c in _SUMMARIES.items()),
)
def write_summaries(spark, sf_dir):
    """Five summaries written as JSON lines, read back line by line."""
    folder = scratch_path(spark, "metadata")
    corpus = staged(inputs.split_corpus(spark, sf_dir), "corpus")
    by_split = validation.class_distribution_by_split(corpus)
    out.write_summaries({
        "slice_summary": slices.slice_summary(corpus),
        "split_summary": splits.split_summary(
            corpus, "two-stage stratified hash split", (42, 43), {"train": 0.70, "val": 0.15, "test": 0.15}),
        "class_distribution_by_split": by_split,
        "label_drift": validation.label_drift(by_split),
        "counts": out.artefact_counts(corpus, prep.MAIN_SPLITS),
    }, folder)

    def told(name: str, columns) -> DataFrame:
        cells = F.from_json("value", "map<string,string>")
        lines = spark.read.text(f"{folder}/{name}.json").select(cells.alias("m"))
        parts = [F.format_string("%.4f", F.col("m")[c].cast("double")) if c in _DOUBLES
                 else F.coalesce(F.col("m")[c], F.lit("-")) for c in columns]
        return lines.select(F.lit(name).alias("summary"), F.concat_ws("|", *parts).alias("line"))

    return reduce(DataFrame.unionByName, [told(n, c) for n, c in _SUMMARIES.items()])


_TOTALS = ("count(*) AS rows, sum(binary_label)::BIGINT AS positives, sum(has_identity_term)::BIGINT AS identity, "
           "sum(has_obfuscation)::BIGINT AS obfuscated, sum(char_len)::BIGINT AS chars")


@query(
    "run_pipeline",
    f"WITH {sql.MAIN}, {sql.POOL}, t AS (SELECT split AS artefact, binary_label, has_identity_term, has_obfuscation, length(text_clean) AS char_len FROM main "
    + "".join(f"UNION ALL SELECT '{n}', binary_label, has_identity_term, has_obfuscation, length(text_clean) FROM pool WHERE {c} "
              for n, c in _SCORED_TABLES.items())
    + f"UNION ALL SELECT 'aug_pool_capped', binary_label, has_identity_term, has_obfuscation, length(text_clean) FROM ({_CAPPED})) "
    f"SELECT artefact, {_TOTALS} FROM t GROUP BY artefact",
)
def run_pipeline(spark, sf_dir):
    """Both sources from CSV through all gates to published tables, read back."""
    output = scratch_path(spark, "published")
    with scratch_scope(spark):
        sources = [make(spark, sf_dir, compression="gzip") for make in (_multilabel_csv, _scored_csv)]
        prep.run_prep(spark, *sources, output)
    columns = ("binary_label", "has_identity_term", "has_obfuscation", "char_len")
    parts = [spark.read.parquet(f"{output}/main/splits.parquet").select(F.col("split").alias("artefact"), *columns)]
    parts += [
        spark.read.parquet(f"{output}/scored/{n}.parquet").select(F.lit(n).alias("artefact"), *columns)
        for n in (*_SCORED_TABLES, "aug_pool_capped")
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("artefact").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("binary_label").alias("positives"),
        F.sum("has_identity_term").alias("identity"),
        F.sum("has_obfuscation").alias("obfuscated"),
        F.sum("char_len").alias("chars"),
    )
