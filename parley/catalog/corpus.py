"""Text, label, de-duplication, profile, slice, split and leakage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.catalog import inputs, sql
from parley.functions import detectors as dt
from parley.functions import labels as lb
from parley.functions import text as tx
from parley.functions.wordpiece import token_length_udf
from parley.operators import audit, dedup, leakage, slices, splits, standardize, validation
from parley.operators.rowindex import index_by_key
from parley.settings import CUE_TERMS, EXPLICIT_TERMS, IDENTITY_TERMS, MULTILABEL_LABELS
from parley.sinks import tables as out

QUERIES, SQL = {}, {}


def query(name: str, statement: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if statement is not None:
            SQL[name] = statement
        return fn

    return add


# --- text ---------------------------------------------------------------------------------

def _text_query(name: str, alias: str, add, expression: str):
    @query(name, f"WITH {sql.COMMENTS} SELECT src, id, {expression} AS {alias} FROM comments")
    def run(spark, sf_dir):
        return add(inputs.comments(spark, sf_dir), alias).select("src", "id", alias)


def _column(fn):
    return lambda df, out: df.withColumn(out, fn(F.col("text")))


def _clean(df, out):
    return tx.add_clean_text(df, "text", out)


_text_query("html_unescape_nfkc", "normalized", _column(tx.unescape_nfkc), sql.unescape("text"))
_text_query("text_clean", "text_clean", _clean, sql.clean("text"))
_text_query(
    "normalize_for_duplicate", "normalized",
    lambda df, out: tx.add_duplicate_text(df, "text", out), sql.key_text("text"),
)
_text_query(
    "text_tfidf", "text_tfidf", lambda df, out: tx.add_casefolded(_clean(df, "c"), "c", out),
    sql.fold(sql.clean("text")),
)
_text_query(
    "teammate_clean_text", "clean_text", lambda df, out: tx.add_export_text(_clean(df, "c"), "c", out),
    sql.export(sql.clean("text")),
)
_text_query(
    "char_len", "char_len", lambda df, out: _clean(df, "c").withColumn(out, F.length("c")),
    f"length({sql.clean('text')})::INTEGER",
)
_text_query("word_count", "word_count", _column(tx.word_count), sql.words("text"))
_text_query("sha256_text", "sha256", _column(tx.sha256_text), "sha256(text)")
_text_query("clean_for_scoring", "cleaned_text", _clean, sql.clean("text"))
_text_query(
    "strip_cell", "cell", _column(tx.strip_cell), r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
)


_text_query("text_hash_raw", "text_hash_raw", _column(tx.sha256_text), "sha256(text)")
_text_query(
    "text_hash_normalized", "text_hash_normalized",
    lambda df, out: tx.add_duplicate_text(df, "text", "key").withColumn(out, tx.sha256_text(F.col("key"))),
    f"sha256({sql.key_text('text')})",
)


# Word pieces of several letters in four languages, and the single characters below; digits
# are left out, so that words with digits are unknown.
_PIECES = (
    "the", "and", "ing", "tion", "ation", "th", "he", "er", "ou", "an", "in", "on", "re", "ed", "en", "sch", "ch", "che",
    "chen", "lich", "keit", "heit", "ung", "ver", "der", "die", "que", "qu", "ment", "mente", "eau", "aux", "cion", "ado",
    "os", "es", "la", "el", "ll", "st", "ti", "et", "le", "pa", "pe", "tr", "tre", "treon", "user", "mail", "br", "div", "href",
)
_LETTERS = tuple("abcdefghijklmnopqrstuvwxyzß") + tuple(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def _piece_pattern() -> str:
    """The pieces as alternatives, longest first: a pattern takes the first that fits."""
    longest = sorted(_PIECES, key=len, reverse=True)
    letters = "".join("\\" + c if not c.isalnum() else c for c in _LETTERS).replace("'", "''")
    return "|".join(longest) + f"|[{letters}]"


_MARKS = r"\p{P}$+<=>^`|~"
_HAN = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}"


@query(
    "bert_token_len",
    f"WITH {sql.COMMENTS}, pieces AS (SELECT src, id, regexp_extract_all(strip_accents(lower({sql.clean('text')})), "
    f"'[^\\s{_MARKS}{_HAN}]+|[{_MARKS}{_HAN}]') AS w FROM comments) "
    "SELECT src, id, (2 + coalesce(list_sum(list_transform(w, lambda x: CASE WHEN length(x) <= 100 "
    f"AND regexp_full_match(x, '({_piece_pattern()})+') THEN len(regexp_extract_all(x, '{_piece_pattern()}')) ELSE 1 END)), 0))::INTEGER "
    "AS bert_token_len FROM pieces",
)
def bert_token_len(spark, sf_dir):
    """Every text with a vocabulary of pieces of one to five letters."""
    vocabulary = _PIECES + _LETTERS
    lengths = token_length_udf(spark, vocabulary + tuple("##" + p for p in vocabulary))
    texts = tx.add_clean_text(inputs.comments(spark, sf_dir), "text", "clean")
    return texts.select("src", "id", lengths(F.col("clean")).alias("bert_token_len"))


# --- detectors ----------------------------------------------------------------------------

def _flag_query(name: str, column, condition: str):
    @query(name, f"WITH {sql.COMMENTS} SELECT src, id, ({condition})::INTEGER AS flag FROM comments")
    def run(spark, sf_dir):
        return inputs.comments(spark, sf_dir).select("src", "id", column(F.col("text")).cast("int").alias("flag"))


_flag_query("contains_url", dt.contains_url, sql.has_url("text"))
_flag_query("contains_email", dt.contains_email, sql.has_email("text"))
_flag_query("contains_digits", dt.contains_digits, r"regexp_matches(text, '\p{Nd}')")
_flag_query(
    "contains_repeated_punctuation", dt.contains_repeated_punctuation,
    sql.has_repeated_punctuation("text"),
)
_flag_query("contains_all_caps_token", dt.contains_all_caps_token, sql.has_caps("text"))
# The identity lexicon has no hit in the test texts, so the cue keywords are searched as well.
_IDENTITY = IDENTITY_TERMS + tuple(c.keyword for c in CUE_TERMS)
_flag_query(
    "has_identity_term", lambda c: dt.contains_any_term(c, _IDENTITY),
    sql.has_term("text", _IDENTITY),
)
_flag_query(
    "has_explicit_toxic_term",
    lambda c: dt.contains_any_term(c, EXPLICIT_TERMS),
    sql.has_term("text", EXPLICIT_TERMS),
)
_flag_query("has_obfuscation", dt.has_obfuscation, sql.has_obfuscation("text"))
_flag_query("missing_text", tx.is_blank, r"text IS NULL OR regexp_replace(text, '\s', '', 'g') = ''")


@query(
    "has_identity_scores",
    f"WITH {sql.SCORED} SELECT source_row_index, "
    "(coalesce(female, 0) >= 0.5 OR muslim >= 0.5)::INTEGER AS has_identity_term FROM scored_raw",
)
def has_identity_scores(spark, sf_dir):
    return inputs.scored(spark, sf_dir).select(
        "source_row_index",
        dt.any_score_at_least(inputs.IDENTITY, 0.5).cast("int").alias("has_identity_term"),
    )


@query(
    "implicit_proxy",
    f"WITH {sql.LABELLED} SELECT source_row_index, ((toxic > 0 OR obscene > 0) AND NOT "
    f"{sql.has_explicit(sql.clean('comment_text'))})::INTEGER AS implicit_proxy FROM labelled",
)
def implicit_proxy(spark, sf_dir):
    rows = tx.add_clean_text(inputs.labelled(spark, sf_dir), "comment_text").select(
        "source_row_index", inputs.main_label().alias("binary_label"), "text_clean"
    )
    return slices.add_flags(rows).select("source_row_index", "implicit_proxy")


@query(
    "missing_label",
    f"WITH {sql.PARTLY} SELECT doc_id, (toxic IS NULL)::INTEGER AS no_label, label AS binary_label FROM partly",
)
def missing_label(spark, sf_dir):
    """A missing label is reported, and harmonised to 0."""
    return inputs.partly_labelled(spark, sf_dir).select(
        "doc_id",
        lb.all_missing(["toxic"]).cast("int").alias("no_label"),
        lb.multilabel_to_binary(["toxic"]).alias("binary_label"),
    )


# --- labels -------------------------------------------------------------------------------

@query(
    "multilabel_to_binary",
    f"WITH {sql.LABELLED} SELECT source_row_index, (toxic > 0 OR obscene > 0)::INTEGER AS binary_label FROM labelled",
)
def multilabel_to_binary(spark, sf_dir):
    return inputs.labelled(spark, sf_dir).select(
        "source_row_index", inputs.main_label().alias("binary_label")
    )


@query(
    "score_to_binary",
    f"WITH {sql.SCORED} SELECT source_row_index, (toxicity >= 0.5)::INTEGER AS binary_label FROM scored_raw",
)
def score_to_binary(spark, sf_dir):
    return inputs.scored(spark, sf_dir).select(
        "source_row_index", lb.score_to_binary("toxicity", 0.5).alias("binary_label")
    )


@query(
    "orig_label_json_multi",
    f"WITH {sql.LABELLED} SELECT source_row_index, {sql.LABEL_JSON} AS orig_label_info FROM labelled",
)
def multilabel_json(spark, sf_dir):
    return inputs.labelled(spark, sf_dir).select(
        "source_row_index", lb.multilabel_json(MULTILABEL_LABELS).alias("orig_label_info")
    )


@query(
    "orig_label_json_score",
    f"WITH {sql.SCORED} SELECT source_row_index, '{{\"toxicity\":' || toxicity::VARCHAR || '}}' AS orig_label_info FROM scored_raw",
)
def score_json(spark, sf_dir):
    return inputs.scored(spark, sf_dir).select(
        "source_row_index", lb.score_json("toxicity").alias("orig_label_info")
    )


@query(
    "identity_scores_passthrough",
    f"WITH {sql.SCORED_CORPUS} SELECT sample_id, female, muslim FROM scored",
)
def identity_scores_passthrough(spark, sf_dir):
    return inputs.scored_corpus(spark, sf_dir).select("sample_id", *inputs.IDENTITY)


# --- standardise and de-duplicate ---------------------------------------------------------

@query("standardize", f"WITH {sql.CORPUS} SELECT * FROM corpus")
def standardize_main(spark, sf_dir):
    return inputs.main_corpus(spark, sf_dir)


@query("standardize_scored", f"WITH {sql.SCORED_CORPUS} SELECT * FROM scored")
def standardize_scored(spark, sf_dir):
    return inputs.scored_corpus(spark, sf_dir)


def _keyed(spark, sf_dir):
    keyed = tx.add_duplicate_text(inputs.documents(spark, sf_dir), "text", "key")
    return keyed.select("doc_id", "text", tx.sha256_text(F.col("key")).alias("h"))


_KEYED = f"keyed AS (SELECT doc_id, text, sha256({sql.key_text('text')}) AS h FROM documents)"


@query("dedup_normalized", f"WITH {_KEYED} SELECT doc_id, text, h FROM keyed QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1")
def dedup_normalized(spark, sf_dir):
    return dedup.keep_first(_keyed(spark, sf_dir), "h", "doc_id").select("doc_id", "text", "h")


@query(
    "first_per_key",
    "SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY lang, source",
)
def first_per_key(spark, sf_dir):
    """Few popular keys: the first document of each language and source."""
    docs = inputs.table(spark, sf_dir, "documents")
    return dedup.keep_first(
        docs.withColumn("k", F.struct("lang", "source")), "k", "doc_id"
    ).select("lang", "source", "doc_id")


@query("sample_id", f"WITH {sql.CORPUS} SELECT sample_id, text_hash_raw FROM corpus")
def sample_id(spark, sf_dir):
    return inputs.main_corpus(spark, sf_dir).select("sample_id", "text_hash_raw")


@query("row_index", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM labels")
def row_index(spark, sf_dir):
    return index_by_key(
        inputs.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "row_index"
    )


@query(
    "removal_summary",
    f"WITH {sql.PARTLY}, keyed AS (SELECT sha256({sql.key_text('text')}) AS h, {sql.collapse('text')} = '' AS blank FROM partly) "
    "SELECT count(*) AS input_rows, count(*) FILTER (blank) AS removed_missing_text, 0::BIGINT AS removed_missing_labels, "
    "count(*) FILTER (NOT blank) - count(DISTINCT h) FILTER (NOT blank) AS removed_normalized_duplicates, "
    "count(DISTINCT h) FILTER (NOT blank) AS output_rows FROM keyed",
)
def removal_summary(spark, sf_dir):
    return standardize.removal_summary(
        inputs.partly_labelled(spark, sf_dir).withColumnRenamed("doc_id", "source_row_index"),
        "text", lb.multilabel_to_binary(["toxic"]),
    )


@query(
    "exact_duplicate_count",
    f"WITH {sql.COMMENTS} SELECT count(*) - count(DISTINCT text) AS exact_duplicate_count FROM comments",
)
def exact_duplicate_count(spark, sf_dir):
    rows = inputs.comments(spark, sf_dir).select(F.sha2("text", 256).alias("h"))
    return rows.agg(dedup.surplus_rows(F.col("h"))[0].alias("exact_duplicate_count"))


@query(
    "normalized_duplicate_count",
    f"WITH {sql.COMMENTS} SELECT count(*) - count(DISTINCT {sql.key_text('text')}) AS normalized_duplicate_count FROM comments",
)
def normalized_duplicate_count(spark, sf_dir):
    return audit.duplicate_counts(inputs.comments(spark, sf_dir), "text").select(
        "normalized_duplicate_count"
    )


@query(
    "hash_duplicates_after_removal",
    f"WITH {sql.CORPUS} SELECT count(*) - count(DISTINCT text_hash_raw) AS raw_hash_duplicates, "
    "count(*) - count(DISTINCT text_hash_normalized) AS normalized_hash_duplicates FROM corpus",
)
def hash_duplicates_after_removal(spark, sf_dir):
    return validation.hash_duplicates(inputs.main_corpus(spark, sf_dir))


# --- profiles -----------------------------------------------------------------------------

def _stats_sql(measure: str, value: str) -> str:
    points = ", ".join(
        f"round(quantile_cont({value}, {q}), 6) AS {n}" for n, q in audit.PERCENTILES.items()
    )
    return (
        f"SELECT '{measure}' AS measure, count(*) AS count, round(avg({value}), 6) AS mean, "
        f"round(stddev_samp({value}), 6) AS std, min({value})::DOUBLE AS min, {points}, "
        f"max({value})::DOUBLE AS max FROM texts"
    )


_TEXTS = f"{sql.COMMENTS}, texts AS (SELECT length(text) AS c, {sql.words('text')} AS w FROM comments)"


def rounded(df, digits: int = 6):
    return df.select(
        *[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes]
    )


@query(
    "length_stats",
    f"WITH {_TEXTS} {_stats_sql('char_length', 'c')} UNION ALL {_stats_sql('word_length', 'w')}",
)
def length_stats(spark, sf_dir):
    return rounded(audit.length_stats(inputs.comments(spark, sf_dir), "text"))


_SHARES = {
    "urls": sql.has_url("text"),
    "emails": sql.has_email("text"),
    "digits": r"regexp_matches(text, '\p{Nd}')",
    "repeated_punctuation": sql.has_repeated_punctuation("text"),
    "all_caps_tokens": sql.has_caps("text"),
}


@query(
    "feature_fractions",
    f"WITH {sql.COMMENTS} SELECT "
    + ", ".join(f"round(avg(({c})::INTEGER), 6) AS {n}" for n, c in _SHARES.items())
    + " FROM comments",
)
def feature_fractions(spark, sf_dir):
    return rounded(audit.feature_fractions(inputs.comments(spark, sf_dir), "text"))


@query(
    "class_distribution",
    f"WITH {sql.LABELLED}, l AS (SELECT (toxic > 0 OR obscene > 0)::INTEGER AS binary_label FROM labelled) "
    "SELECT binary_label, count(*) AS rows, round((SELECT avg(binary_label) FROM l), 6) AS positive_ratio FROM l GROUP BY 1",
)
def class_distribution(spark, sf_dir):
    labels = inputs.labelled(spark, sf_dir).select(inputs.main_label().alias("binary_label"))
    return rounded(audit.class_distribution(labels))


def _audit_sql() -> str:
    shares = "".join(
        f" UNION ALL SELECT 'feature.{n}', avg(({c})::INTEGER)::DOUBLE FROM partly"
        for n, c in _SHARES.items()
    )
    stats = {
        "count": "count({v})", "mean": "avg({v})", "std": "stddev_samp({v})", "min": "min({v})",
        **{n: "quantile_cont({v}, %s)" % q for n, q in audit.PERCENTILES.items()},
        "max": "max({v})",
    }
    lengths = "".join(
        f" UNION ALL SELECT '{m}.{n}', ({e.format(v=v)})::DOUBLE FROM texts"
        for m, v in (("char_length", "c"), ("word_length", "w"))
        for n, e in stats.items()
    )
    return (
        f"WITH {sql.PARTLY}, texts AS (SELECT length(text) AS c, {sql.words('text')} AS w FROM partly), "
        "t(metric, value) AS (SELECT 'total_row_count', count(*)::DOUBLE FROM partly "
        "UNION ALL SELECT 'missing_null_text_count', count(*) FILTER (text IS NULL) FROM partly "
        "UNION ALL SELECT 'missing_label_count', count(*) FILTER (toxic IS NULL OR quality IS NULL) FROM partly "
        f"UNION ALL SELECT 'empty_string_text_count', count(*) FILTER ({sql.collapse('text')} = '') FROM partly"
        f"{shares} UNION ALL SELECT 'class.0', count(*) FILTER (label = 0) FROM partly "
        "UNION ALL SELECT 'class.1', count(*) FILTER (label = 1) FROM partly "
        "UNION ALL SELECT 'class.positive_ratio', avg(label) FROM partly "
        "UNION ALL SELECT 'exact_duplicate_count', count(*) - count(DISTINCT text) FROM partly "
        f"UNION ALL SELECT 'normalized_duplicate_count', count(*) - count(DISTINCT {sql.key_text('text')}) FROM partly"
        f"{lengths}) SELECT metric, round(value, 6) AS value FROM t"
    )


@query("audit_dataset", _audit_sql())
def audit_dataset(spark, sf_dir):
    return rounded(
        audit.audit_dataset(
            inputs.partly_labelled(spark, sf_dir), "text", ("toxic", "quality"),
            lb.multilabel_to_binary(["toxic"]),
        )
    )


# --- slices -------------------------------------------------------------------------------

@query("length_thresholds", f"WITH {sql.CORPUS}, {sql.THRESHOLDS} SELECT * FROM limits")
def length_thresholds(spark, sf_dir):
    return slices.length_thresholds_table(inputs.main_corpus(spark, sf_dir).select("word_len"))


@query(
    "length_bucket",
    f"WITH {sql.CORPUS}, {sql.FLAGGED} SELECT sample_id, word_len, length_bucket FROM flagged",
)
def length_bucket(spark, sf_dir):
    return inputs.sliced_corpus(spark, sf_dir).select("sample_id", "word_len", "length_bucket")


@query(
    "slice_summary",
    f"WITH {sql.CORPUS}, {sql.FLAGGED}, tall AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS slice, {c}::VARCHAR AS value, binary_label FROM flagged"
        for c in slices.SLICE_COLUMNS
    )
    + ") SELECT slice, value, count(*) AS row_count, count(*) FILTER (binary_label = 0) AS label_0, "
    "count(*) FILTER (binary_label = 1) AS label_1, round(avg(binary_label), 6) AS positive_ratio FROM tall GROUP BY 1, 2",
)
def slice_summary(spark, sf_dir):
    return rounded(slices.slice_summary(inputs.sliced_corpus(spark, sf_dir)))


@query(
    "token_length_diagnostics",
    f"WITH {sql.CORPUS} SELECT true AS available, round(avg(word_len), 6) AS mean, "
    "round(quantile_cont(word_len, 0.5), 6) AS median, round(quantile_cont(word_len, 0.9), 6) AS p90, "
    "round(quantile_cont(word_len, 0.95), 6) AS p95, round(avg((word_len > 128)::INTEGER), 6) AS fraction_gt_128, "
    "round(avg((word_len > 256)::INTEGER), 6) AS fraction_gt_256 FROM corpus",
)
def token_length_diagnostics(spark, sf_dir):
    """The word length stands in for the token length."""
    return rounded(
        validation.token_length_diagnostics(inputs.main_corpus(spark, sf_dir), "word_len")
    )


# --- splits -------------------------------------------------------------------------------

@query("stratified_split3", f"WITH {sql.MAIN} SELECT sample_id, binary_label, split FROM main")
def stratified_split3(spark, sf_dir):
    return inputs.split_corpus(spark, sf_dir).select("sample_id", "binary_label", "split")


@query("stratified_split2", f"WITH {sql.POOL} SELECT sample_id, binary_label, split FROM pool")
def stratified_split2(spark, sf_dir):
    return inputs.split_scored(spark, sf_dir).select("sample_id", "binary_label", "split")


@query(
    "split_summary",
    f"WITH {sql.MAIN} SELECT split, count(*) AS rows, "
    "(CASE split WHEN 'train' THEN 0.70 ELSE 0.15 END)::DOUBLE AS target_ratio, "
    "'two-stage stratified hash split' AS method, 'binary_label' AS stratify_column, '42,43' AS random_seeds "
    "FROM main GROUP BY split",
)
def split_summary(spark, sf_dir):
    return splits.split_summary(
        inputs.split_corpus(spark, sf_dir), "two-stage stratified hash split", (42, 43),
        {"train": 0.70, "val": 0.15, "test": 0.15},
    )


@query(
    "capped_sample",
    f"WITH {sql.MAIN}, {sql.POOL} SELECT sample_id, text_hash_raw FROM pool WHERE split = 'aug_pool' "
    "QUALIFY row_number() OVER (ORDER BY sha256('46|' || sample_id)) <= (SELECT count(*) FROM main WHERE split = 'train')",
)
def capped_sample(spark, sf_dir):
    pool = inputs.split_scored(spark, sf_dir).filter(F.col("split") == "aug_pool")
    rows = inputs.main_train_rows(spark, sf_dir)
    return splits.capped_sample(pool, rows).select("sample_id", "text_hash_raw")


@query(
    "head_subset",
    f"WITH {sql.MAIN} SELECT split, sample_id FROM main QUALIFY row_number() OVER (PARTITION BY split ORDER BY sample_id) "
    "<= CASE split WHEN 'train' THEN 20000 ELSE 3000 END",
)
def head_subset(spark, sf_dir):
    corpus = inputs.split_corpus(spark, sf_dir).select("split", "sample_id")
    return splits.head_subset(corpus)


# --- validation ---------------------------------------------------------------------------

@query(
    "class_distribution_by_split",
    f"WITH {sql.MAIN} SELECT split, count(*) AS row_count, count(*) FILTER (binary_label = 0) AS label_0, "
    "count(*) FILTER (binary_label = 1) AS label_1, round(avg(binary_label), 6) AS positive_ratio FROM main GROUP BY split",
)
def class_distribution_by_split(spark, sf_dir):
    return rounded(validation.class_distribution_by_split(inputs.split_corpus(spark, sf_dir)))


@query(
    "label_drift",
    f"WITH {sql.MAIN}, o AS (SELECT avg(binary_label) AS r FROM main) SELECT split, round(avg(binary_label), 6) AS positive_ratio, "
    "round(any_value(r), 6) AS overall_ratio, round(abs(avg(binary_label) - any_value(r)), 6) AS drift, "
    "abs(avg(binary_label) - any_value(r)) > 0.03 AS exceeds_limit FROM main, o GROUP BY split",
)
def label_drift(spark, sf_dir):
    by_split = validation.class_distribution_by_split(inputs.split_corpus(spark, sf_dir))
    return rounded(validation.label_drift(by_split))


@query(
    "small_split_warning",
    f"WITH {sql.MAIN} SELECT split, count(*) AS row_count FROM main GROUP BY split HAVING count(*) < 100",
)
def small_split_warning(spark, sf_dir):
    return validation.small_splits(
        validation.class_distribution_by_split(inputs.split_corpus(spark, sf_dir))
    )


@query(
    "missing_after_prep",
    f"WITH {sql.CORPUS} SELECT count(*) FILTER (text_clean = '') AS missing_text_after_cleaning, "
    "count(*) FILTER (binary_label IS NULL) AS missing_labels_after_harmonization FROM corpus",
)
def missing_after_prep(spark, sf_dir):
    return validation.missing_after_prep(inputs.main_corpus(spark, sf_dir))


@query(
    "export_row_counts",
    f"WITH {sql.MAIN} SELECT split AS artefact, count(*) AS rows FROM main GROUP BY split "
    + "".join(
        f"UNION ALL SELECT '{n}', count(*) FILTER ({f} = 1) FROM main " for n, f in out.SLICE_FLAGS.items()
    ),
)
def export_row_counts(spark, sf_dir):
    return out.artefact_counts(inputs.split_corpus(spark, sf_dir), ("train", "val", "test"))


def _assigned(spark, sf_dir):
    """All documents, duplicates included, in three groups, so that groups share texts."""
    keyed = tx.add_duplicate_text(inputs.documents(spark, sf_dir), "text", "key")
    return keyed.select(
        F.element_at(F.array(F.lit("test"), F.lit("train"), F.lit("val")), (F.col("doc_id") % 3 + 1).cast("int")).alias("split"),
        tx.sha256_text(F.col("text")).alias("text_hash_raw"),
        tx.sha256_text(F.col("key")).alias("text_hash_normalized"),
    )


_ASSIGNED = (
    "assigned AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'train' ELSE 'val' END AS split, "
    f"sha256(text) AS text_hash_raw, sha256({sql.key_text('text')}) AS text_hash_normalized FROM documents)"
)


@query(
    "split_hash_overlap",
    f"WITH {_ASSIGNED}, tall AS (SELECT DISTINCT 'text_hash_raw' AS kind, split, text_hash_raw AS h FROM assigned "
    "UNION ALL SELECT DISTINCT 'text_hash_normalized', split, text_hash_normalized FROM assigned), "
    "pairs(l, r) AS (VALUES ('test', 'train'), ('test', 'val'), ('train', 'val')), "
    "kinds(kind) AS (VALUES ('text_hash_raw'), ('text_hash_normalized')), "
    "hits AS (SELECT a.kind, a.split AS l, b.split AS r, a.h, row_number() OVER (PARTITION BY a.kind, a.split, b.split ORDER BY a.h) AS n "
    "FROM tall a JOIN tall b ON a.kind = b.kind AND a.h = b.h AND a.split < b.split) "
    "SELECT kind, l || '__' || r AS pair, count(h) AS overlap_count, "
    "coalesce(string_agg(h, ',' ORDER BY h) FILTER (n <= 10), '') AS example_hashes "
    "FROM kinds CROSS JOIN pairs LEFT JOIN hits USING (kind, l, r) GROUP BY kind, l, r",
)
def split_hash_overlap(spark, sf_dir):
    overlaps = leakage.split_hash_overlap(_assigned(spark, sf_dir), ("train", "val", "test"))
    return overlaps.withColumn("example_hashes", F.array_join("example_hashes", ","))


@query(
    "leakage_gate",
    f"WITH {_ASSIGNED}, tall AS (SELECT DISTINCT 'text_hash_raw' AS kind, split, text_hash_raw AS h FROM assigned "
    "UNION ALL SELECT DISTINCT 'text_hash_normalized', split, text_hash_normalized FROM assigned), "
    "hits AS (SELECT a.kind, a.split || '__' || b.split AS pair, count(*) AS n FROM tall a JOIN tall b "
    "ON a.kind = b.kind AND a.h = b.h AND a.split < b.split GROUP BY ALL) "
    "SELECT 'documents leakage detected by hash overlap: ' || string_agg(kind || ' ' || pair || ': ' || n, ', ' ORDER BY kind, pair) || '.' AS message FROM hits",
)
def leakage_gate(spark, sf_dir):
    """The warning of the lenient gate over overlapping groups."""
    overlaps = leakage.split_hash_overlap(_assigned(spark, sf_dir), ("train", "val", "test"))
    messages = leakage.leakage_gate(overlaps, "documents", strict=False)
    return spark.createDataFrame([(m,) for m in messages], "message string")


@query(
    "pool_external_overlap",
    f"WITH {_ASSIGNED}, o AS (SELECT text_hash_normalized AS h FROM assigned WHERE split = 'train' "
    "INTERSECT SELECT text_hash_normalized FROM assigned WHERE split = 'test') "
    "SELECT count(*) AS overlap_count, coalesce((SELECT string_agg(h, ',' ORDER BY h) FROM (SELECT h FROM o ORDER BY h LIMIT 10)), '') AS example_hashes FROM o",
)
def pool_external_overlap(spark, sf_dir):
    groups = _assigned(spark, sf_dir)
    shared = leakage.pool_external_overlap(
        groups.filter(F.col("split") == "train"), groups.filter(F.col("split") == "test")
    )
    return leakage.overlap_report(shared).withColumn(
        "example_hashes", F.array_join("example_hashes", ",")
    )


@query(
    "labels_to_text",
    "SELECT d.doc_id, d.text, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)",
)
def labels_to_text(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select("doc_id", "text").join(
        inputs.table(spark, sf_dir, "labels"), "doc_id"
    )


@query(
    "validate_dataset",
    f"WITH {sql.MAIN}, s AS (SELECT split, count(*) AS n, avg(binary_label) AS r FROM main GROUP BY split), "
    "o AS (SELECT avg(binary_label) AS r FROM main) "
    "SELECT 'multilabel' AS source, 'small_split' AS code, 'multilabel:' || split || ' is suspiciously small with ' || n || ' rows.' AS message FROM s WHERE n < 100 "
    "UNION ALL SELECT 'multilabel', 'label_drift', 'multilabel label-ratio drift across splits exceeds 0.03: ' || "
    "string_agg(split || ' ' || printf('%.6f', abs(s.r - o.r)), ', ' ORDER BY split) || '.' FROM s, o WHERE abs(s.r - o.r) > 0.03 HAVING count(*) > 0",
)
def validate_dataset(spark, sf_dir):
    """All warnings of the bundled checks."""
    checks = validation.validate_dataset(
        inputs.split_corpus(spark, sf_dir), "multilabel", ("train", "val", "test")
    )
    return spark.createDataFrame(
        checks.warnings,
        "source string, code string, message string",
    )
