"""TF-IDF, training, metric and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.catalog import inputs, sql
from parley.catalog.corpus import rounded
from parley.functions import text as tx
from parley.operators import metrics, modeling, tfidf
from parley.plans.training import train_and_evaluate
from parley.session import staged

QUERIES, SQL = {}, {}


def query(name: str, statement: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if statement is not None:
            SQL[name] = statement
        return fn

    return add


_WORDS = (
    f"words AS (SELECT doc_id, {sql.term_list('text')} AS w FROM documents), "
    "terms AS (SELECT doc_id, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS t FROM words)"
)
_TERMS = _WORDS + ", long AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(t) AS term FROM terms) GROUP BY ALL)"


def _vocabulary(limit: int) -> str:
    return (
        _TERMS + ", vocabulary AS (SELECT term, sum(n)::BIGINT AS tf, count(*) AS df FROM long GROUP BY term "
        f"HAVING count(*) >= 2 ORDER BY tf DESC, term LIMIT {limit})"
    )


@query(
    "tfidf_tokens",
    f"WITH {_WORDS} SELECT doc_id, len(t)::INTEGER AS n_terms, sha256(array_to_string(t, '|')) AS terms FROM terms",
)
def tfidf_tokens(spark, sf_dir):
    rows = tfidf.with_terms(inputs.documents(spark, sf_dir), "text")
    return rows.select(
        "doc_id", F.size("terms").alias("n_terms"), F.sha2(F.array_join("terms", "|"), 256).alias("terms")
    )


@query("tfidf_vocab", f"WITH {_vocabulary(50000)} SELECT term, tf, df FROM vocabulary")
def tfidf_vocab(spark, sf_dir):
    return tfidf.vocabulary(inputs.documents(spark, sf_dir), "text")


@query(
    "tfidf_weights",
    f"WITH {_vocabulary(50000)}, idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)::DOUBLE) + 1 AS idf FROM vocabulary), "
    "raw AS (SELECT doc_id, term, (1 + ln(n::DOUBLE)) * idf AS w FROM long JOIN idf USING (term)), "
    "norm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY doc_id) "
    "SELECT doc_id, term, round(w / norm, 6) AS weight FROM raw JOIN norm USING (doc_id)",
)
def tfidf_weights(spark, sf_dir):
    docs = inputs.documents(spark, sf_dir)
    model = tfidf.fit_tfidf(docs, "text")
    return rounded(tfidf.tfidf_long(docs, "doc_id", "text", model))


@query(
    "balanced_class_weights",
    f"WITH {sql.LABELLED}, c AS (SELECT (toxic > 0 OR obscene > 0)::INTEGER AS binary_label, count(*) AS rows FROM labelled GROUP BY 1) "
    "SELECT binary_label, rows, round((SELECT sum(rows) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * rows), 6) AS weight FROM c",
)
def balanced_class_weights(spark, sf_dir):
    labels = inputs.labelled(spark, sf_dir).select(inputs.main_label().alias("binary_label"))
    return rounded(modeling.balanced_class_weights(labels))


def _train(spark, sf_dir):
    clean = tx.add_clean_text(inputs.labelled(spark, sf_dir), "comment_text")
    return staged(tx.add_casefolded(clean, "text_clean", "text_tfidf").select(
        inputs.main_label().alias("binary_label"), "text_tfidf"), "train")


def _model_sql(train: str) -> str:
    """CTEs from ``train`` (key, y, text_tfidf): ``vocabulary``, ``idf`` and ``odds``."""
    return (
        f"train AS MATERIALIZED ({train}), "
        f"w AS (SELECT key, y, {sql.term_list('text_tfidf')} AS w FROM train), "
        "t AS (SELECT key, y, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS t FROM w), "
        "tl AS MATERIALIZED (SELECT key, y, term, count(*) AS n FROM (SELECT key, y, unnest(t) AS term FROM t) GROUP BY ALL), "
        "vocabulary AS MATERIALIZED (SELECT term, sum(n)::BIGINT AS tf, count(*) AS df, count(*) FILTER (y = 1) AS pos FROM tl GROUP BY term "
        "HAVING count(*) >= 2 ORDER BY tf DESC, term LIMIT 50000), "
        "n AS (SELECT count(*) AS n, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM train), "
        "odds AS MATERIALIZED (SELECT term, ln((1 + n)::DOUBLE / (1 + df)::DOUBLE) + 1 AS idf, "
        "ln((pos + 1)::DOUBLE / (p + 2)::DOUBLE) - ln((df - pos + 1)::DOUBLE / (q + 2)::DOUBLE) AS coefficient FROM vocabulary, n), "
        "intercept AS (SELECT ln((p + 1)::DOUBLE / (q + 1)::DOUBLE) AS b FROM n)"
    )


def _scores_sql(source: str, text: str) -> str:
    """CTE ``scores`` (key, probability) of the folded texts of a table with a key."""
    return (
        f"sw AS (SELECT key, {sql.term_list(text)} AS w FROM {source}), "
        "st AS (SELECT key, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS t FROM sw), "
        "sl AS (SELECT key, term, count(*) AS n FROM (SELECT key, unnest(t) AS term FROM st) GROUP BY ALL), "
        "sx AS (SELECT key, (1 + ln(n::DOUBLE)) * idf AS x, coefficient FROM sl JOIN odds USING (term)), "
        "sm AS (SELECT key, sum(x * coefficient) / sqrt(sum(x * x)) AS margin FROM sx GROUP BY key), "
        f"scores AS (SELECT s.key, 1 / (1 + exp(-(b + coalesce(margin, 0)))) AS probability FROM {source} s LEFT JOIN sm USING (key), intercept)"
    )


_LABELLED_TRAIN = (
    f"SELECT source_row_index AS key, (toxic > 0 OR obscene > 0)::INTEGER AS y, {sql.fold(sql.clean('comment_text'))} AS text_tfidf FROM labelled"
)


@query(
    "fit_logistic",
    f"WITH {sql.LABELLED}, {_model_sql(_LABELLED_TRAIN)} SELECT term, 0.0::DOUBLE AS residual FROM vocabulary UNION ALL SELECT NULL, 0.0",
)
def fit_logistic(spark, sf_dir):
    """A model fitted on all labelled documents: every coefficient solves the optimum's equation.

    No coefficient is further from the optimum than the residuals together; they are given to
    two decimals, coefficients being of the order of 0.1 to 5.
    """
    train = _train(spark, sf_dir)
    residuals = modeling.fit_residuals(modeling.fit_logistic(train), train)
    return residuals.select("term", F.round(F.abs("residual"), 2).alias("residual"))


_SCORED = (
    f"WITH {sql.LABELLED}, {_model_sql(_LABELLED_TRAIN)}, d AS (SELECT doc_id AS key, cleaned_text, {sql.fold('cleaned_text')} AS folded FROM "
    f"(SELECT doc_id, {sql.clean('text')} AS cleaned_text FROM documents)), {_scores_sql('d', 'folded')} "
    "SELECT d.key AS doc_id, cleaned_text, CASE WHEN probability >= 0.5 THEN 'toxic' ELSE 'non-toxic' END AS predicted_label, "
    "(probability >= 0.5)::INTEGER AS numeric_label, round(greatest(probability, 1 - probability), 6) AS confidence, "
    "round(probability, 6) AS toxic_probability, round(1 - probability, 6) AS non_toxic_probability, 0.5::DOUBLE AS threshold "
    "FROM d JOIN scores USING (key)"
)


@query("score_comments", _SCORED)
def score_comments(spark, sf_dir):
    """The counted model of the labelled documents applied to every document."""
    scorer = modeling.fit_log_odds(_train(spark, sf_dir))
    return rounded(modeling.score_comments(inputs.documents(spark, sf_dir), "text", scorer).drop("text", "original_text"))


@query("score_comments_logistic")
def score_comments_logistic(spark, sf_dir):
    """The fitted logistic regression applied to every document."""
    return modeling.score_comments(
        inputs.documents(spark, sf_dir), "text", modeling.fit_logistic(_train(spark, sf_dir))
    ).drop("text", "original_text")


def _split_texts(spark, sf_dir):
    return staged(
        inputs.split_corpus(spark, sf_dir).select("split", "binary_label", "text_tfidf"), "model")


@query("train_and_evaluate")
def train_evaluate(spark, sf_dir):
    return train_and_evaluate(_split_texts(spark, sf_dir)).metrics


def _evaluated_sql() -> str:
    held = "held AS (SELECT sample_id AS key, split, binary_label AS y, text_tfidf FROM main WHERE split <> 'train')"
    train = "SELECT sample_id AS key, binary_label AS y, text_tfidf FROM main WHERE split = 'train'"
    return (
        f"WITH {sql.MAIN}, {_model_sql(train)}, {held}, {_scores_sql('held', 'text_tfidf')}, "
        "p AS (SELECT split, y, (probability >= 0.5)::INTEGER AS a FROM held JOIN scores USING (key)) "
        + _metrics_sql("a", "p", "split"))


_PREDICTED = (
    f"predicted AS (SELECT doc_id, (toxic > 0 OR quality = 0)::INTEGER AS y, ({sql.ratio(7919)} >= 0.5)::INTEGER AS a, "
    f"({sql.ratio(31)} >= 0.3)::INTEGER AS b, lang, (n_chars > 1000)::INTEGER AS is_long FROM documents JOIN labels USING (doc_id))"
)


def _predicted(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "documents").drop("text").join(
        inputs.table(spark, sf_dir, "labels"), "doc_id"
    )
    return rows.select(
        ((F.col("toxic") > 0) | (F.col("quality") == 0)).cast("int").alias("y"),
        (inputs.ratio(7919) >= 0.5).cast("int").alias("a"),
        (inputs.ratio(31) >= 0.3).cast("int").alias("b"),
        "lang",
        (F.col("n_chars") > 1000).cast("int").alias("is_long"),
    )


def _metrics_sql(p: str, rows: str = "predicted", group: str = "") -> str:
    keys = f"{group}, " if group else ""
    tail = f" GROUP BY {group}" if group else ""
    return (
        f"SELECT {keys}count(*) AS rows, round(avg((y = {p})::INTEGER), 6) AS accuracy, "
        f"round(coalesce(count(*) FILTER (y = 1 AND {p} = 1)::DOUBLE / nullif(count(*) FILTER ({p} = 1), 0), 0), 6) AS precision, "
        f"round(coalesce(count(*) FILTER (y = 1 AND {p} = 1)::DOUBLE / nullif(count(*) FILTER (y = 1), 0), 0), 6) AS recall, "
        f"round(coalesce(2.0::DOUBLE * count(*) FILTER (y = 1 AND {p} = 1) / nullif(count(*) FILTER (y = 1) + count(*) FILTER ({p} = 1), 0), 0), 6) AS f1 "
        f"FROM {rows}{tail}"
    )


@query("train_and_evaluate_log_odds", _evaluated_sql())
def train_evaluate_log_odds(spark, sf_dir):
    corpus = _split_texts(spark, sf_dir)
    return rounded(train_and_evaluate(corpus, fit=modeling.fit_log_odds).metrics)


@query("binary_metrics", f"WITH {_PREDICTED} {_metrics_sql('a')}")
def binary_metrics(spark, sf_dir):
    return rounded(metrics.binary_metrics(_predicted(spark, sf_dir), "y", "a"))


@query(
    "confusion_matrix",
    f"WITH {_PREDICTED} SELECT actual, predicted, count(doc_id) AS rows FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(actual, predicted) "
    "LEFT JOIN predicted ON y = actual AND a = predicted GROUP BY ALL",
)
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_predicted(spark, sf_dir), "y", "a")


def _report_sql() -> str:
    return (
        f"WITH {_PREDICTED}, n AS (SELECT count(*) FILTER (y = 1 AND a = 1)::DOUBLE AS tp, count(*) FILTER (y = 0 AND a = 1) AS fp, "
        "count(*) FILTER (y = 1 AND a = 0) AS fn, count(*) FILTER (y = 0 AND a = 0)::DOUBLE AS tn FROM predicted), "
        "c AS (SELECT 'Non-Toxic' AS class, tn / (tn + fn) AS p, tn / (tn + fp) AS r, 2 * tn / (2 * tn + fn + fp) AS f, (tn + fp)::BIGINT AS s FROM n "
        "UNION ALL SELECT 'Toxic', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), (tp + fn)::BIGINT FROM n), "
        "r AS (SELECT * FROM c UNION ALL SELECT 'accuracy', NULL, NULL, (tp + tn) / (tp + fp + fn + tn), (tp + fp + fn + tn)::BIGINT FROM n "
        "UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(s)::BIGINT FROM c "
        "UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s)::BIGINT FROM c) "
        "SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, s AS support FROM r"
    )


@query("classification_report", _report_sql())
def classification_report(spark, sf_dir):
    return rounded(metrics.classification_report(_predicted(spark, sf_dir), "y", "a"))


@query(
    "evaluate_slices",
    f"WITH {_PREDICTED}, tall AS (SELECT 'lang' AS slice, lang AS value, y, a FROM predicted "
    "UNION ALL SELECT 'is_long', is_long::VARCHAR, y, a FROM predicted) " + _metrics_sql("a", "tall", "slice, value"),
)
def evaluate_slices(spark, sf_dir):
    return rounded(metrics.evaluate_slices(_predicted(spark, sf_dir), "y", "a", ("lang", "is_long")))


@query(
    "model_comparison",
    f"WITH {_PREDICTED}, a AS ({_metrics_sql('a')}), b AS ({_metrics_sql('b')}), "
    "ta AS (UNPIVOT (SELECT accuracy, precision, recall, f1 FROM a) ON COLUMNS(*) INTO NAME metric VALUE v), "
    "tb AS (UNPIVOT (SELECT accuracy, precision, recall, f1 FROM b) ON COLUMNS(*) INTO NAME metric VALUE v) "
    "SELECT metric, ta.v AS baseline, tb.v AS advanced, round(tb.v - ta.v, 5) AS delta FROM ta JOIN tb USING (metric)",
)
def model_comparison(spark, sf_dir):
    rows = _predicted(spark, sf_dir)
    tables = [
        metrics.metric_table(rounded(metrics.binary_metrics(rows, "y", p))) for p in ("a", "b")
    ]
    return metrics.model_comparison(*tables).withColumn("delta", F.round("delta", 5))


@query(
    "class_share_percent",
    f"WITH {sql.LABELLED}, c AS (SELECT (toxic > 0 OR obscene > 0)::INTEGER AS binary_label, count(*) AS rows FROM labelled GROUP BY 1) "
    "SELECT binary_label, rows, printf('%.1f%%', rows::DOUBLE / (SELECT sum(rows) FROM c) * 100) AS share FROM c",
)
def class_share_percent(spark, sf_dir):
    labels = inputs.labelled(spark, sf_dir).select(inputs.main_label().alias("binary_label"))
    return metrics.class_share_percent(labels)
