"""Rule-based and likelihood-ratio quality decisions, in Spark expressions only.

Words and word pairs are hashed into a fixed number of buckets. Two multinomials over the
buckets are counted, one of trusted documents and one of the whole corpus. A document's score
is the mean log-likelihood ratio of its n-grams; every document is kept or dropped by a fixed
threshold on it, after the rules on length and repetition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import BLANKS, any_names, table

BUCKETS = 8192
# Added to each bucket's count.
SMOOTHING = 1.0
# Mean log-likelihood ratio per n-gram below which a document goes.
THRESHOLD = -0.065
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
# Fixed by the rules: characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"


def word_array(text: Column) -> Column:
    """Blank-separated words; none for a null text."""
    parts = F.split(F.coalesce(text, F.lit("")), BLANKS)
    return F.filter(parts, lambda w: w != "")


def _get(items: str, index: Column) -> Column:
    return F.get(F.col(items), index)


def with_base(df: DataFrame, text: str) -> DataFrame:
    """Add ``__words`` and the rule columns.

    Repeated windows are found by sorting ``(hash, start)`` pairs of the document's 8-word
    windows; a document without an equal pair skips the sort.
    """
    k = REPEAT_WINDOW
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"),
                     lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = df.withColumn("__words", word_array(F.col(text))).withColumn("__lines", lines)
    out = out.withColumn("n_words", F.size("__words").cast("long"))
    starts = F.when(F.col("n_words") >= k, F.sequence(F.lit(1), F.size("__words") - (k - 1)))
    out = out.withColumn(
        "__windows",
        F.transform(starts, lambda i: F.xxhash64(F.slice("__words", i, k))),
    )
    pairs = F.when(
        F.size(F.array_distinct("__windows")) < F.size("__windows"),
        F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    out = out.withColumn("__pairs", pairs)
    twice = F.filter(
        "__pairs",
        lambda p, i: (F.coalesce(_get("__pairs", i - 1)["h"] == p["h"], F.lit(False)))
        | (F.coalesce(_get("__pairs", i + 1)["h"] == p["h"], F.lit(False))),
    )
    out = out.withColumn("__twice", F.sort_array(F.transform(twice, lambda p: p["i"])))
    gains = F.transform(
        "__twice",
        lambda s, i: F.when(i == 0, k).otherwise(F.least(F.lit(k), s - _get("__twice", i - 1))),
    )
    repeated = F.coalesce(F.aggregate(gains, F.lit(0), lambda a, x: a + x), F.lit(0))
    out = out.withColumns(
        {
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": repeated.cast("long"),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("__lines", "__windows", "__pairs", "__twice")


def ngram_buckets(words: str, buckets: int = BUCKETS) -> Column:
    """Bucket numbers of all words and all pairs of neighbouring words."""
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    # get() beyond the last word is null: its "pair" is dropped.
    pair = F.transform(
        F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))),
        lambda w, i: F.pmod(F.xxhash64(_get(words, i), w), F.lit(buckets)).cast("int"),
    )
    return F.concat(single, pair)


def bucket_counts(df: DataFrame, text: str, trusted: str, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n_raw, n_target)`` over all documents: at most ``buckets`` rows."""
    grams = df.select(
        F.coalesce(F.col(trusted), F.lit(False)).alias("__t"),
        word_array(F.col(text)).alias("__words"),
    ).select("__t", F.explode(ngram_buckets("__words", buckets)).alias("bucket"))
    return grams.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.count(F.when(F.col("__t"), 1)).alias("n_target"),
    )


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with the array of ``log p_target - log p_raw`` by bucket."""
    full = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    rows = full.join(counts, "bucket", "left").fillna(0, ["n_raw", "n_target"])
    packed = rows.agg(
        F.sum("n_raw").alias("raw"), F.sum("n_target").alias("target"),
        F.array_sort(F.collect_list(F.struct("bucket", "n_raw", "n_target"))).alias("rows"),
    )
    smooth = F.lit(SMOOTHING)
    size = F.lit(SMOOTHING * buckets)
    return packed.select(
        F.transform(
            "rows",
            lambda r: F.log((r["n_target"] + smooth) / (F.col("target") + size))
            - F.log((r["n_raw"] + smooth) / (F.col("raw") + size)),
        ).alias("ratios")
    )


def _settled(column: Column) -> Column:
    """The column, which the optimiser may not put into a filter or join above: it would state
    (and run) the whole array work once more for every mention. No partition's number is negative,
    but it counts as nondeterministic."""
    return F.when(F.spark_partition_id() >= 0, column)


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
           "llr", "kept")


@any_names("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept", columns=("text", "trusted"))
def quality_rules(
    df: DataFrame, text: str, trusted: str, buckets: int = BUCKETS, threshold: float = THRESHOLD
) -> DataFrame:
    """Add the rule columns, ``llr`` (double) and ``kept`` (boolean) to every row.

    ``trusted`` marks target documents (null: not one). A null or empty text has no words: it
    fails the length rule and has ratio 0. With no trusted document all ratios come from the
    smoothing alone. Very long texts are read whole, in one row, in time that grows with their
    length, filtered by the results or not. Other columns and repeated rows stay; columns named
    as the added ones are replaced. An empty table stays empty.
    """
    # ``buckets`` numbers, folded into one constant of the plan: a subquery cannot stand within
    # a higher-order function.
    ratios = log_ratios(bucket_counts(df, text, trusted, buckets), buckets).first()["ratios"]
    table_ = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    scored = with_base(df, text).withColumn("__grams", ngram_buckets("__words", buckets))
    total = F.aggregate(
        "__grams", F.lit(0.0), lambda a, g: a + F.get(table_, g)
    )
    scored = scored.withColumn(
        "llr", F.when(F.size("__grams") == 0, F.lit(0.0)).otherwise(total / F.size("__grams")))
    kept = ~F.col("base_failed") & (F.col("llr") >= threshold)
    scored = scored.withColumn("kept", kept)
    return scored.select(*df.columns, *(_settled(F.col(c)).alias(c) for c in RESULTS))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; documents labelled with quality 1 are the trusted target."""
    good = (
        table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct()
        .withColumn("good", F.lit(True)).hint("merge")
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(good, "doc_id", "left")
    return quality_rules(docs, "text", "good").drop("text", "good")


QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLE: dict[str, str] = {}
