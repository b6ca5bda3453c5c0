"""Scoring, triage, cue, queue and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.catalog import inputs, sql
from parley.functions import cues as cu
from parley.operators import lexicon, modeling, triage
from parley.plans import review
from parley.session import scratch_path
from parley.sinks.queue import write_review_queue
from parley.streaming import triage as streaming

QUERIES, SQL = {}, {}
_P = sql.ratio(7919)


def query(name: str, statement: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if statement is not None:
            SQL[name] = statement
        return fn

    return add


def _items(spark, sf_dir):
    return triage.build_review_items(inputs.predictions(spark, sf_dir))


def _scores(spark, sf_dir):
    """Items without their cue column's cost: unused columns are pruned."""
    return _items(spark, sf_dir)


@query(
    "apply_threshold",
    f"SELECT doc_id AS row_id, p AS toxic_probability, (p >= 0.4)::INTEGER AS numeric_label, "
    "CASE WHEN p >= 0.4 THEN 'toxic' ELSE 'non-toxic' END AS predicted_label, 1.0::DOUBLE - p AS non_toxic_probability, "
    f"greatest(p, 1.0::DOUBLE - p) AS confidence, 0.4::DOUBLE AS threshold FROM (SELECT doc_id, {_P} AS p FROM documents)",
)
def apply_threshold(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), inputs.ratio(7919).alias("toxic_probability")
    )
    return triage.apply_threshold(rows, 0.4)


@query(
    "classify_risk",
    f"SELECT doc_id, p, {sql.band('p', sql.LEVEL)} AS risk_level, {sql.band('p', sql.ADVICE)} AS review_recommendation, "
    f"{sql.band('p', ('1', '2', '3', '4'))}::INTEGER AS review_priority FROM (SELECT doc_id, {_P} AS p FROM documents)",
)
def classify_risk(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "documents").select("doc_id", inputs.ratio(7919).alias("p"))
    return triage.classify_risk(rows, "p")


@query(
    "format_percent",
    f"SELECT doc_id, printf('%.1f%%', {_P} * 100) AS percent FROM documents",
)
def format_percent(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    return docs.select("doc_id", triage.format_percent(inputs.ratio(7919)).alias("percent"))


_ITEM_COLUMNS = (
    "row_id", "original_text", "prediction", "risk_level", "risk_score", "risk_score_percent",
    "review_recommendation", "review_priority",
)


@query(
    "build_review_item",
    f"WITH {sql.ITEMS} SELECT {', '.join(_ITEM_COLUMNS)}, greatest(0::DOUBLE, 1.0::DOUBLE - p) AS non_toxic_probability, "
    "greatest(p, greatest(0::DOUBLE, 1.0::DOUBLE - p)) AS confidence, 0.5::DOUBLE AS threshold FROM items",
)
def build_review_item(spark, sf_dir):
    return _items(spark, sf_dir).select(
        *_ITEM_COLUMNS, "advanced.non_toxic_probability", "advanced.confidence", "advanced.threshold"
    )


_CUES = sql.cue_rows("documents", "doc_id", "text")


@query(
    "detect_cues",
    f"WITH {_CUES} SELECT key AS row_id, keyword, category, severity, first_start, first_end, hits, positions FROM cues",
)
def detect_cues(spark, sf_dir):
    docs = cu.add_cues(inputs.documents(spark, sf_dir), "text", "cues")
    rows = cu.explode_once(docs.select(F.col("doc_id").alias("row_id"), "cues"), "cues", "c")
    spans = F.transform(
        "c.positions", lambda p: F.concat(p["start"].cast("string"), F.lit("-"), p["end"].cast("string"))
    )
    return rows.select(
        "row_id", "c.keyword", "c.category", "c.severity",
        F.col("c.start").alias("first_start"), F.col("c.end").alias("first_end"),
        F.col("c.count").alias("hits"), F.array_join(spans, ",").alias("positions"),
    )


_BENCHMARK_TERMS = (
    "lexicon AS (SELECT DISTINCT unnest(t) AS term FROM (SELECT list_concat(w, list_transform(range(1, len(w)), "
    "lambda i: w[i] || ' ' || w[i + 1])) AS t FROM (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark)))"
)


def _benchmark_terms(spark, sf_dir):
    """All words and word pairs of the benchmark texts as a lexicon of thousands of terms."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    pairs = F.zip_with(
        F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b))
    items = inputs.table(spark, sf_dir, "benchmark").select(words.alias("w"))
    return items.select(F.explode(F.concat("w", pairs)).alias("term")).distinct()


@query(
    "lexicon_matches",
    rf"WITH {_BENCHMARK_TERMS}, pieces AS (SELECT row_id, regexp_extract_all(lower(text), '[{sql.W}]+|\s+|[^{sql.W}\s]') AS p FROM "
    "(SELECT conv_id * 100 + turn AS row_id, text FROM conversations)), "
    "runs AS (SELECT DISTINCT row_id, CASE WHEN n = 1 THEN p[i] ELSE p[i] || ' ' || p[i + 2] END AS term FROM "
    "(SELECT row_id, p, unnest(range(1, len(p) + 1)) AS i FROM pieces), (VALUES (1), (2)) t(n) "
    r"WHERE n = 1 OR (i + 2 <= len(p) AND regexp_matches(p[i + 1], '^\s+$'))) "
    "SELECT row_id, term FROM runs JOIN lexicon USING (term)",
)
def lexicon_matches(spark, sf_dir):
    """Which of the benchmark's words and word pairs occur in which turns."""
    turns = inputs.table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("row_id"), "text")
    return lexicon.matching_terms(turns, "row_id", "text", _benchmark_terms(spark, sf_dir))


_SUMMARY = (
    "coalesce(string_agg(keyword || ' (' || category || ', ' || severity || ')' || CASE WHEN hits > 1 THEN ' x' || hits ELSE '' END, "
    "'; ' ORDER BY first_start, first_end), '')"
)


@query(
    "cue_summary_text",
    f"WITH {_CUES} SELECT doc_id AS row_id, {_SUMMARY} AS keyword_cues FROM documents LEFT JOIN cues ON doc_id = key GROUP BY doc_id",
)
def cue_summary_text(spark, sf_dir):
    return inputs.documents(spark, sf_dir).select(
        F.col("doc_id").alias("row_id"),
        cu.cue_summary(cu.detect_cues("text")).alias("keyword_cues"),
    )


@query(
    "cue_statistics",
    f"WITH {_CUES} SELECT keyword, category, severity, count(*) AS comments, sum(hits)::BIGINT AS hits FROM cues GROUP BY ALL",
)
def cue_statistics(spark, sf_dir):
    return triage.cue_statistics(_items(spark, sf_dir))


def _highlighted(spark, sf_dir):
    return inputs.comments(spark, sf_dir).withColumn(
        "cues", cu.detect_cues("text")
    ).withColumn("spans", cu.highlight_spans(F.col("text"), F.col("cues")))


_COMMENT_CUES = sql.cue_rows("comments", "src || id", "text")


@query(
    "resolve_highlight_spans",
    f"WITH {sql.COMMENTS}, {_COMMENT_CUES} SELECT key[1:1] AS src, key[2:]::BIGINT AS id, span_start, span_end, keyword FROM spans",
)
def resolve_highlight_spans(spark, sf_dir):
    """The default terms never overlap, so every span survives."""
    marked = _highlighted(spark, sf_dir).select("src", "id", "spans")
    return cu.explode_once(marked, "spans", "s").select(
        "src", "id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), "s.keyword"
    )


@query(
    "highlight_segments",
    f"WITH {sql.COMMENTS}, {_COMMENT_CUES}, n AS (SELECT key, count(*) AS n FROM spans GROUP BY key) "
    "SELECT src, id, text AS joined, coalesce(n, 0)::BIGINT AS marked FROM comments LEFT JOIN n ON key = src || id",
)
def highlight_segments(spark, sf_dir):
    """The segments joined again, and how many are marked."""
    pieces = _highlighted(spark, sf_dir).withColumn(
        "segments", cu.highlight_segments(F.col("text"), F.col("spans"))
    )
    return pieces.select(
        "src", "id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("joined"),
        F.size(F.filter("segments", lambda s: s["marked"])).cast("long").alias("marked"),
    )


@query("review_queue", f"WITH {sql.ITEMS} SELECT row_id, risk_score, risk_level FROM items ORDER BY risk_score DESC, row_id")
def review_queue(spark, sf_dir):
    return triage.review_queue(_scores(spark, sf_dir)).select("row_id", "risk_score", "risk_level")


@query("queue_filter", f"WITH {sql.ITEMS} SELECT row_id, risk_score FROM items WHERE risk_level = 'Borderline'")
def queue_filter(spark, sf_dir):
    return triage.queue_filter(_scores(spark, sf_dir), "Borderline").select("row_id", "risk_score")


@query(
    "queue_topk",
    f"WITH {sql.ITEMS} SELECT row_id, risk_score, original_text FROM items WHERE risk_level = 'Medium' ORDER BY risk_score DESC, row_id LIMIT 25",
)
def queue_topk(spark, sf_dir):
    top = triage.queue_topk(_scores(spark, sf_dir), "Medium", 25)
    return top.select("row_id", "risk_score", "original_text")


@query(
    "queue_rank",
    f"WITH {sql.ITEMS} SELECT row_id, risk_score, row_number() OVER (ORDER BY risk_score DESC, row_id) AS rank FROM items",
)
def queue_rank(spark, sf_dir):
    return triage.queue_rank(_scores(spark, sf_dir).select("row_id", "risk_score", "risk_level")).select(
        "row_id", "risk_score", "rank"
    )


@query(
    "queue_rank_top",
    f"WITH {sql.ITEMS} SELECT row_id, rank FROM (SELECT row_id, row_number() OVER (ORDER BY risk_score DESC, row_id) AS rank "
    "FROM items WHERE risk_level = 'High') WHERE rank <= 10",
)
def queue_rank_top(spark, sf_dir):
    return triage.queue_rank(_scores(spark, sf_dir), "High", 10).select("row_id", "rank")


def _summary_sql(items: str) -> str:
    level = "count(*) FILTER (risk_level = '{}')"
    return (
        "SELECT count(*) AS total_comments, count(*) FILTER (risk_level <> 'Low') AS needs_review, "
        f"{level.format('High')} AS high_risk, {level.format('Medium')} AS medium_risk, "
        f"{level.format('Borderline')} AS borderline, {level.format('Low')} AS low_risk, "
        "count(*) FILTER (prediction = 'toxic') AS predicted_toxic, count(*) FILTER (prediction <> 'toxic') AS predicted_non_toxic, "
        "round(sum(round(risk_score * 10000)::BIGINT) / count(*) / 10000.0::DOUBLE, 4) AS average_risk_score, "
        "printf('%.1f%%', sum(round(risk_score * 10000)::BIGINT) / count(*) / 10000.0::DOUBLE * 100) AS average_risk_score_percent "
        f"FROM {items}"
    )


@query("queue_summary", f"WITH {sql.ITEMS} {_summary_sql('items')}")
def queue_summary(spark, sf_dir):
    return triage.queue_summary(_scores(spark, sf_dir))


@query(
    "risk_distribution",
    f"WITH {sql.ITEMS} SELECT risk_level, count(row_id) AS rows, round(count(row_id) / (SELECT count(*) FROM items)::DOUBLE, 6) AS share "
    "FROM (VALUES ('High'), ('Medium'), ('Borderline'), ('Low')) b(risk_level) LEFT JOIN items USING (risk_level) GROUP BY risk_level",
)
def risk_distribution(spark, sf_dir):
    return triage.risk_distribution(_scores(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query(
    "risk_explanation",
    f"SELECT doc_id, " + sql.band(_P, tuple("'" + b[4] + "'" for b in triage.BANDS)) + " AS explanation FROM documents",
)
def risk_explanation(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    level = triage.risk_level(inputs.ratio(7919))
    return docs.select("doc_id", triage.risk_explanation(level).alias("explanation"))


@query(
    "review_queue_csv",
    f"WITH {sql.ITEMS}, {_CUES}, s AS (SELECT key, {_SUMMARY} AS keyword_cues FROM cues GROUP BY key) "
    "SELECT row_id::VARCHAR AS row_id, original_text, prediction, risk_level, regexp_replace(risk_score::VARCHAR, '\\.0$', '') AS risk_score, "
    "risk_score_percent, review_recommendation, review_priority::VARCHAR AS review_priority, coalesce(keyword_cues, '') AS keyword_cues, "
    "round(p, 6) AS toxic_probability, round(1 - p, 6) AS non_toxic_probability, round(greatest(p, 1 - p), 6) AS confidence, "
    "0.5::DOUBLE AS threshold, '' AS cleaned_text FROM items LEFT JOIN s ON row_id = key",
)
def review_queue_csv(spark, sf_dir):
    path = scratch_path(spark, "queue")
    write_review_queue(_items(spark, sf_dir), path)
    lines = spark.read.options(
        header=False, multiLine=True, quote='"', escape='"', nullValue="\x00"
    ).csv(path, schema=", ".join(f"{c} string" for c in triage.EXPORT_COLUMNS))
    return lines.filter(F.col("row_id") != "row_id").select(
        "row_id", "original_text", "prediction", "risk_level", "risk_score", "risk_score_percent",
        "review_recommendation", "review_priority",
        F.coalesce("keyword_cues", F.lit("")).alias("keyword_cues"),
        *[F.round(F.col(c).cast("double"), 6).alias(c)
          for c in ("toxic_probability", "non_toxic_probability", "confidence", "threshold")],
        F.coalesce("cleaned_text", F.lit("")).alias("cleaned_text"),
    )


# --- end to end ---------------------------------------------------------------------------

_LENGTH_P = f"(((length({sql.clean('text')}) * 7919) % 10007)::DOUBLE / 10006.0::DOUBLE)"


def _review_sql(rows: str) -> str:
    return (
        f"scored AS (SELECT row_id, text AS original_text, {sql.clean('text')} AS cleaned_text, {_LENGTH_P} AS p FROM ({rows})), "
        f"done AS (SELECT *, CASE WHEN p >= 0.5 THEN 'toxic' ELSE 'non-toxic' END AS prediction, {sql.band('p', sql.LEVEL)} AS risk_level, "
        "round(p, 4) AS risk_score FROM scored)"
    )


_TURNS = "SELECT conv_id * 100 + turn AS row_id, text FROM conversations"


@query(
    "append_predictions",
    f"WITH {_review_sql(_TURNS)} SELECT row_id, original_text AS text, original_text, cleaned_text, prediction AS predicted_label, "
    "(p >= 0.5)::INTEGER AS numeric_label, greatest(p, 1.0::DOUBLE - p) AS confidence, p AS toxic_probability, "
    "1.0::DOUBLE - p AS non_toxic_probability, 0.5::DOUBLE AS threshold FROM done",
)
def append_predictions(spark, sf_dir):
    turns = inputs.table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("row_id"), "text"
    )
    return modeling.score_comments(turns, "text", inputs.length_scorer)


_LINES = (
    "SELECT row_number() OVER (ORDER BY conv_id, turn) AS row_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations"
)


@query(
    "analyze_file",
    f"WITH {_review_sql(_LINES)} SELECT row_id, original_text, prediction, risk_level, risk_score FROM done",
)
def analyze_file(spark, sf_dir):
    """Conversations as an uploaded CSV, through to the queue."""
    path = conversations_csv(spark, sf_dir)
    result = review.analyze_file(spark, path, inputs.length_scorer, "text")
    return result.queue.select("row_id", "original_text", "prediction", "risk_level", "risk_score")


@query("analyze_file_summary", f"WITH {_review_sql(_LINES)} {_summary_sql('done')}")
def analyze_file_summary(spark, sf_dir):
    path = conversations_csv(spark, sf_dir)
    return review.analyze_file(spark, path, inputs.length_scorer, "text").summary


def conversations_csv(spark, sf_dir) -> str:
    path = scratch_path(spark, "upload") + ".csv"
    inputs.table(spark, sf_dir, "conversations").orderBy("conv_id", "turn").write.options(
        header=True, quote='"', escape='"'
    ).csv(path)
    return path


@query(
    "analyze_stream",
    f"WITH {_review_sql(_TURNS)} SELECT row_id, original_text, prediction, risk_level, risk_score, cleaned_text FROM done",
)
def analyze_stream(spark, sf_dir):
    """Conversations dropped as files into a folder, triaged as a stream."""
    folder, output, marks = (scratch_path(spark, n) for n in ("arriving", "triaged", "progress"))
    inputs.table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("row_id"), "text"
    ).write.parquet(folder)
    stream = streaming.comment_stream(spark, folder, "row_id long, text string")
    items = streaming.analyze_stream(stream, inputs.length_scorer)
    streaming.start(items, output, marks).awaitTermination()
    return spark.read.schema(items.schema).parquet(output).select(
        "row_id", "original_text", "prediction", "risk_level", "risk_score", "advanced.cleaned_text"
    )
