"""Removal of lines that are boilerplate on their site.

Per host, the pages that contain a line are divided by all pages of the host. A line whose
share exceeds the boilerplate ratio is dropped from every page of that host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import any_names, row_key, stored, table

# A line is boilerplate if more than this share of its host's pages contain it ...
RATIO = 0.05
# ... and at least so many pages do: a line of one page is not repeated at all.
MIN_PAGES = 2


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def boilerplate_lines(
    df: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES,
    copies: bool = True,
) -> DataFrame:
    """``(host, line)`` hashes whose page share in the host exceeds the ratio.

    A page counts once per line. Both counts are added up within tasks before they are
    shuffled, so a hot host or line costs one row per task. Without ``copies`` all pages of one
    host and text count as one page, in the lines' counts and in the host's.
    """
    pages = df.select(
        *row_key(host, text),
        F.xxhash64(host).alias("__host"),
        F.array_distinct(
            F.transform(F.filter(_lines(F.col(text)), _has_word), lambda x: F.xxhash64(x))
        ).alias("__lines"),
    )
    if not copies:
        pages = pages.groupBy("__k1", "__k2").agg(
            F.first("__host").alias("__host"), F.first("__lines").alias("__lines"))
    totals = pages.groupBy("__host").agg(F.count(F.lit(1)).alias("__total"))
    counts = (
        pages.select("__host", F.explode("__lines").alias("__line"))
        .groupBy("__host", "__line").agg(F.count(F.lit(1)).alias("__pages"))
        .filter(F.col("__pages") >= min_pages)
    )
    share = F.col("__pages").cast("double") / F.col("__total")
    return counts.join(totals, "__host").filter(share > ratio).select("__host", "__line")


@any_names("n_lines", "n_dropped", columns=("host", "text"))
def drop_boilerplate(
    df: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES,
    copies: bool = True,
) -> DataFrame:
    """Replace ``text`` by its kept lines and add ``n_lines`` and ``n_dropped`` (long).

    Lines are separated by LF. Lines without a word are never boilerplate and stay, as do the
    separators between kept lines. A null text stays null with no lines; an empty text has one
    (empty) line. Null hosts form a host of their own. All other columns, and repeated rows,
    are kept as they are; columns named as the added ones are replaced. A share equal to the ratio is not boilerplate. Very long texts are
    cut into lines whole, in one row.
    """
    pairs = stored(boilerplate_lines(df, host, text, ratio, min_pages, copies), "boilerplate")
    k1, k2 = row_key(host, text)
    keyed = df.withColumns({"__k1": k1, "__k2": k2})
    lines = keyed.select(
        "__k1", "__k2", F.xxhash64(host).alias("__host"),
        F.explode(
            F.array_distinct(
                F.transform(F.filter(_lines(F.col(text)), _has_word), lambda x: F.xxhash64(x))
            )
        ).alias("__line"),
    )
    # Only pages with boilerplate lines are left here, each with its few line hashes.
    bad = (
        lines.join(pairs, ["__host", "__line"])
        .groupBy("__k1", "__k2").agg(F.collect_set("__line").alias("__bad"))
    )
    # Stored: a join of two plain exchanges lets Spark split the partition of a hot page. The
    # pages with such lines grow with the input: they are joined the same way at every size.
    bad = stored(bad, "boilerplate-pages")
    joined = keyed.join(bad.hint("merge"), ["__k1", "__k2"], "left")
    kept = F.when(F.col("__bad").isNull(), _lines(F.col(text))).otherwise(
        F.filter(_lines(F.col(text)), lambda x: ~F.array_contains("__bad", F.xxhash64(x)))
    )
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(_lines(F.col(text))))
    return (
        joined.withColumn("__kept", kept)
        .withColumn("n_lines", n_lines.cast("long"))
        .withColumn(
            "n_dropped",
            F.when(F.col(text).isNull(), F.lit(0)).otherwise(
                F.col("n_lines") - F.size("__kept")).cast("long"),
        )
        .withColumn(text, F.when(F.col("__bad").isNull(), F.col(text)).otherwise(
            F.array_join("__kept", "\n")))
        .drop("__k1", "__k2", "__bad", "__kept")
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the boilerplate lines of their source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs, "source", "text").select(
        "doc_id", "n_lines", "n_dropped",
        F.length("text").cast("long").alias("kept_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


def sql(documents: str = "documents", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """Documents with kept lines, in DuckDB: all columns plus n_lines and n_dropped."""
    return f"""
    SELECT d.doc_id, d.lang, d.source, d.n_lines, d.n_lines - len(d.kept) AS n_dropped,
        CASE WHEN d.text IS NULL THEN NULL ELSE array_to_string(d.kept, chr(10)) END AS text
    FROM (
        SELECT p.*, list_filter(lines, lambda x: NOT list_contains(coalesce(b.bad, []), x)) AS kept
        FROM (
            SELECT *, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END
                AS lines, len(lines)::BIGINT AS n_lines
            FROM {documents}
        ) p LEFT JOIN (
            SELECT source, list(line) AS bad FROM (
                SELECT source, line, count(*) AS pages FROM (
                    SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line
                    FROM {documents}
                ) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
                GROUP BY source, line HAVING count(*) >= {min_pages}
            ) JOIN (SELECT source AS s, count(*) AS total FROM {documents} GROUP BY source)
                ON source IS NOT DISTINCT FROM s
            WHERE pages::DOUBLE / total > {ratio} GROUP BY source
        ) b ON p.source IS NOT DISTINCT FROM b.source
    ) d"""


QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLE = {
    "op4_line_dedup": f"""
    SELECT doc_id, n_lines, n_dropped, length(text)::BIGINT AS kept_chars,
        sha256(text) AS kept_sha256 FROM ({sql()})"""
}
