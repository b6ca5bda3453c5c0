"""TF-IDF over word unigrams and bigrams.

Texts stay whole rows: the JVM finds their words, and Arrow kernels pair, count and weigh them
where they are, some STEP_WORDS words at a time, so weighting a table needs no shuffle. Only
fitting does one, on terms, with partial sums.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import patterns as rx
from parley.operators.selection import most_frequent
from parley.session import staged

# Words whose terms a task holds at once (some 30 MB); a longer text is taken whole.
STEP_WORDS = 1 << 19


def tokens(text: Column) -> Column:
    """Lower-case words of at least two characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rx.WORD_TOKEN), F.lit(0))


def with_terms(df: DataFrame, text_column: str, out: str = "terms") -> DataFrame:
    """Add the unigrams followed by the bigrams of each text."""
    words = F.col("__words")
    bigrams = F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return (
        df.withColumn("__words", tokens(F.col(text_column)))
        .withColumn(out, F.when(F.size(words) > 1, F.concat(words, bigrams)).otherwise(words))
        .drop("__words")
    )


def _steps(words: pa.ListArray) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """``(texts, terms, text of each term)`` for runs of texts, given by their words."""
    sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        limit = ends[first] - sizes[first] + STEP_WORDS
        stop = max(first + 1, int(np.searchsorted(ends, limit, "right")))
        flat = words.slice(first, stop - first).flatten().cast(pa.large_string())
        text = np.repeat(np.arange(stop - first), sizes[first:stop])
        paired = text[1:] == text[:-1]
        mask = pa.array(paired)
        left, right = flat.slice(0, len(mask)).filter(mask), flat.slice(len(flat) - len(mask)).filter(mask)
        pairs = pc.binary_join_element_wise(left, right, pa.scalar(" ", pa.large_string()))
        yield stop - first, pa.concat_arrays([flat, pairs]), np.concatenate([text, text[1:][paired]])
        first = stop


def _term_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and texts of the terms of each step."""
    for batch in batches:
        for _, terms, text in _steps(batch.column(0)):
            coded = terms.dictionary_encode()
            codes, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
            if n:
                yield pa.RecordBatch.from_arrays([
                    coded.dictionary.cast(pa.string()),
                    pa.array(np.bincount(codes, minlength=n)),
                    pa.array(np.bincount(np.unique(text * n + codes) % n, minlength=n)),
                ], ["term", "tf", "df"])


def vocabulary(
    df: DataFrame, text_column: str, max_features: int = 50_000, min_df: int = 2
) -> DataFrame:
    """``(term, tf, df)`` of the most frequent terms; equal counts go by term.

    A frequent term is one partial row per task before the shuffle. All terms' counts are
    stored, and the cut among them is found from a histogram.
    """
    words = df.select(tokens(F.col(text_column)).alias("words"))
    counted = words.mapInArrow(_term_counts, "term string, tf long, df long")
    counts = (
        counted.groupBy("term")
        .agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
        .filter(F.col("df") >= min_df)
    )
    return most_frequent(staged(counts, "terms"), max_features, "tf", "term")


@dataclass(frozen=True)
class TfidfModel:
    """A fitted vocabulary: at most ``max_features`` terms with their idf, in term order."""

    terms: tuple[str, ...]
    idf: tuple[float, ...]

    def weights(self, df: DataFrame, text_column: str) -> DataFrame:
        """Add ``tfidf``: aligned arrays of term indices and L2-normalised weights."""
        if not self.terms:
            empty = F.struct(
                F.array().cast("array<int>").alias("indices"),
                F.array().cast("array<double>").alias("weights"),
            )
            return df.withColumn("tfidf", empty)
        # Nondeterministic: filters on the weights do not repeat the work.
        weigh = F.arrow_udf(
            _weigher(self.terms, self.idf), "struct<indices: array<int>, weights: array<double>>"
        ).asNondeterministic()
        return (
            df.withColumn("__words", tokens(F.col(text_column)))
            .withColumn("tfidf", weigh("__words"))
            .drop("__words")
        )


def _weigher(terms: Sequence[str], idf: Sequence[float]):
    """From words to the indices of known terms, in order, and their L2-normalised weights."""
    known, factors = pa.array(terms, pa.large_string()), np.array(idf, np.float64)

    def weigh(words: pa.Array) -> pa.Array:
        empty = pa.ListArray.from_arrays([0], pa.array([], pa.int32()))
        done = [pa.StructArray.from_arrays([empty, empty.cast(pa.list_(pa.float64()))], ["indices", "weights"])]
        for n, found, text in _steps(words):
            codes = pc.index_in(found, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            own = codes >= 0
            keys, counts = np.unique(text[own] * len(factors) + codes[own], return_counts=True)
            of, index = keys // len(factors), keys % len(factors)
            raw = (np.log(counts.astype(np.float64)) + 1.0) * factors[index]
            norms = np.sqrt(np.bincount(of, raw * raw, n))
            offsets = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
            done.append(pa.StructArray.from_arrays([
                pa.ListArray.from_arrays(offsets, pa.array(index.astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(raw / norms[of])),
            ], ["indices", "weights"]))
        return pa.concat_arrays(done)

    return weigh


def array_literal(values: Sequence[float]) -> Column:
    """One array constant; the optimiser folds the parse away."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<double>")


def fit_tfidf(
    df: DataFrame, text_column: str, max_features: int = 50_000, min_df: int = 2
) -> TfidfModel:
    """Learn the vocabulary and smooth idf. ``max_features`` bounds what the driver receives."""
    # Both queries read one stored text column.
    n = df.count()
    rows = (
        vocabulary(df, text_column, max_features, min_df)
        .select("term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
        .collect()
    )
    rows = sorted((r["term"], r["idf"]) for r in rows)
    return TfidfModel(tuple(t for t, _ in rows), tuple(w for _, w in rows))


def term_table(spark: SparkSession, model: TfidfModel) -> DataFrame:
    """``(index, term, idf)``, at most ``max_features`` rows."""
    rows = pa.table({
        "index": pa.array(range(len(model.terms)), pa.int32()),
        "term": pa.array(model.terms, pa.string()), "idf": pa.array(model.idf, pa.float64())})
    return spark.createDataFrame(rows)


def tfidf_long(df: DataFrame, id_column: str, text_column: str, model: TfidfModel) -> DataFrame:
    """The weights as ``(id, term, weight)`` rows."""
    pairs = F.arrays_zip(
        F.col("tfidf.indices").alias("i"), F.col("tfidf.weights").alias("w")
    )
    # As many rows as the vocabulary's bound.
    terms = F.broadcast(term_table(df.sparkSession, model).select("index", "term"))
    return (
        model.weights(df.select(id_column, text_column), text_column)
        .select(id_column, F.explode(pairs).alias("p"))
        .select(id_column, F.col("p.i").alias("index"), F.col("p.w").alias("weight"))
        .join(terms, "index").select(id_column, "term", "weight")
    )
