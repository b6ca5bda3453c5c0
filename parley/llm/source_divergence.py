"""How far the sources of a language differ in their use of common terms, in exact arithmetic.

Each language keeps the terms of at least ``min_docs`` of its documents. A group (a language's
source, or the language itself) gives a kept term the share
``p = 1 + floor(10**9 * (count + 5) / (N + 5 * V))``. Sources are compared with each other by
the sum of absolute differences, and with their language by the terms that they overuse.

A sum over all V terms for each pair of sources would visit V cells for each pair, most of them
zero counts. With ``z`` for the share of a zero count, each term's difference is split as::

    |p - q| = |z - y| + (|p - y| - |z - y|) + (|z - q| - |z - y|) + both(p, q)

The first three parts follow from the sources' zero shares and one histogram of shares per
source. ``both`` is left for terms that occur in both sources. It comes from a frequent-pattern
tree: a term is a path of its nonzero ``(source, count)`` cells in source order, equal paths
carry a multiplicity, and every node adds its correction against each ancestor once, times the
multiplicity of all terms below it. Paths arrive sorted, so a task holds one path at a time: a
node is complete, and leaves the tree, when the next path turns off above it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.common import stored, table

MIN_DOCS = 30
TOP_TERMS = 50
# Distinct (lang, source, term) counts that a task holds before it passes them on.
HELD_COUNTS = 400_000
# Bytes of a long text that are split into terms at a time.
PART_BYTES = 1 << 20
# Sums of source pairs that a task holds before it passes them on.
HELD_PAIRS = 2_000_000
# Leading path cells by which paths are dealt to tasks; the rest is dealt by hash.
DEALT_CELLS = 4

# Fixed by the definition of a term: letters A-Z and a-z, and all that is not ASCII.
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^A-Za-z\x80-\xff]")


def _parts(text: bytes) -> Iterator[bytes]:
    """The text in pieces that end between terms."""
    begin = 0
    while begin < len(text):
        end = begin + PART_BYTES
        if end < len(text):
            gap = _GAP.search(text, end)
            end = gap.start() if gap else len(text)
        yield text[begin:end]
        begin = end


def _count_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    occurrences: dict[tuple[bytes, bytes], Counter] = {}
    documents: dict[tuple[bytes, bytes], Counter] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in occurrences.items():
            in_docs = documents[lang, source]
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(counts), pa.binary()),
                "source": pa.array([source] * len(counts), pa.binary()),
                "term": pa.array(list(counts), pa.binary()),
                "n": pa.array(list(counts.values()), pa.int64()),
                "docs": pa.array([in_docs[t] for t in counts], pa.int64()),
            })
        occurrences.clear()
        documents.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
            counts = occurrences.setdefault((lang, source), Counter())
            held -= len(counts)
            if len(text) <= PART_BYTES:
                terms = _TERM.findall(text.lower())  # of bytes: A-Z only
                counts.update(terms)
                seen = set(terms)
            else:
                seen = set()
                for part in _parts(text):
                    terms = _TERM.findall(part.lower())
                    counts.update(terms)
                    seen.update(terms)
            documents.setdefault((lang, source), Counter()).update(seen)
            held += len(counts)
            if held >= HELD_COUNTS:
                yield from flush()
                held = 0
    yield from flush()


def kept_terms(df: DataFrame, text: str, lang: str, source: str,
               min_docs: int = MIN_DOCS) -> DataFrame:
    """``(lang, term, n, cells)``: kept terms with their counts, in all and by source."""
    texts = df.select(*(
        F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(name)
        for name, c in (("lang", lang), ("source", source), ("text", text))
    ))
    counts = (
        texts.mapInArrow(_count_terms, "lang binary, source binary, term binary, n long, docs long")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    # One cell for each source of a term.
    return (
        counts.groupBy("lang", "term")
        .agg(
            F.sum("n").alias("n"), F.sum("docs").alias("docs"),
            F.collect_list(F.struct(F.col("source").cast("string").alias("source"), "n"))
            .alias("cells"),
        )
        .filter(F.col("docs") >= min_docs)
        .select(F.col("lang").cast("string").alias("lang"),
                F.col("term").cast("string").alias("term"), "n", "cells")
    )


def _share(n: str, total: str, terms: str) -> Column:
    """A share in billionths plus 1, by decimal division; null without kept terms."""
    return F.expr(
        f"1L + ((1000000000BD * (cast({n} as decimal(20,0)) + 5))"
        f" div nullif(cast({total} as decimal(20,0)) + 5 * cast({terms} as decimal(20,0)), 0BD))")


def group_totals(df: DataFrame, lang: str, source: str, rows: DataFrame) -> DataFrame:
    """``(lang, source, total, terms, lang_total, z)`` of every group that occurs."""
    groups = df.select(*(
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
        for name, c in (("lang", lang), ("source", source))
    )).distinct()
    own = (
        rows.select("lang", F.explode("cells").alias("c"))
        .groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("total"))
    )
    whole = rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    return (
        groups.join(own, ["lang", "source"], "left").join(whole, "lang", "left")
        .fillna(0, ["total", "terms", "lang_total"])
        .withColumn("z", _share("0", "total", "terms"))
    )


class PathTree:
    """The open path of a frequent-pattern tree whose paths arrive in sorted order."""

    def __init__(self) -> None:
        self.lang: str | None = None
        self.depth = 0
        self._restart()
        size = 16
        self.code, self.n, self.p, self.z, self.times = (np.zeros(size, np.int64) for _ in range(5))

    def _restart(self) -> None:
        self.codes: dict[str, int] = {}
        self.sums: dict[int, np.ndarray] = {}
        self.held = 0

    def insert(self, lang: str, names: list[str], n: np.ndarray, p: np.ndarray, z: np.ndarray,
               times: int) -> Iterator[pa.RecordBatch]:
        if lang != self.lang or self.held > HELD_PAIRS:
            yield from self.close()
            self.lang = lang
        code = np.array([self.codes.setdefault(x, len(self.codes)) for x in names], np.int64)
        m = min(self.depth, len(code))
        differ = (self.code[:m] != code[:m]) | (self.n[:m] != n[:m])
        keep = int(np.argmax(differ)) if differ.any() else m
        self._leave(keep)
        if len(code) > len(self.code):
            size = 2 * len(code)
            for part in ("code", "n", "p", "z", "times"):
                setattr(self, part, np.resize(getattr(self, part), size))
        span = slice(keep, len(code))
        self.code[span], self.n[span], self.p[span], self.z[span] = (
            code[keep:], n[keep:], p[keep:], z[keep:])
        self.times[span] = 0
        self.depth = len(code)
        self.times[self.depth - 1] += times

    def _leave(self, depth: int) -> None:
        """Complete the nodes below ``depth``."""
        for d in range(self.depth - 1, depth - 1, -1):
            if d:
                self._add(d)
                self.times[d - 1] += self.times[d]
        self.depth = min(self.depth, depth)

    def _add(self, d: int) -> None:
        """Corrections of a complete node against all its ancestors."""
        p, z, q, y = self.p[d], self.z[d], self.p[:d], self.z[:d]
        both = np.abs(p - q) - np.abs(z - q) - np.abs(p - y) + np.abs(z - y)
        row = self.sums.get(code := int(self.code[d]))
        if row is None or len(row) < len(self.codes):
            new = np.zeros(2 * len(self.codes), np.int64)
            if row is not None:
                new[: len(row)] = row
            self.held += len(new) - (0 if row is None else len(row))
            row = self.sums[code] = new
        row[self.code[:d]] += both * self.times[d]

    def close(self) -> Iterator[pa.RecordBatch]:
        """Complete the open path; the sums so far, both ways round."""
        self._leave(0)
        names = list(self.codes)
        for code, row in self.sums.items():
            others = np.flatnonzero(row).tolist()
            mine, theirs = [names[code]] * len(others), [names[o] for o in others]
            values = row[others].tolist()
            yield _pairs([self.lang] * 2 * len(others), mine + theirs, theirs + mine, values * 2)
        self._restart()


def _pairs(lang: list, source: list, item: list, value: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "lang": pa.array(lang, pa.string()), "source": pa.array(source, pa.string()),
        "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64()),
    })


_PAIR_ROW = "lang string, source string, item string, value long"


def _tree_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree = PathTree()
    for batch in batches:
        paths = batch.column("path")
        ends = np.cumsum(pc.list_value_length(paths).to_numpy(zero_copy_only=False)).tolist()
        cells = dict(zip((f.name for f in paths.type.value_type), paths.flatten().flatten()))
        names = cells["source"].to_pylist()
        n, p, z = (cells[c].to_numpy(zero_copy_only=False) for c in ("n", "p", "z"))
        begin = 0
        for lang, times, end in zip(
                batch.column("lang").to_pylist(), batch.column("times").to_pylist(), ends):
            yield from tree.insert(
                lang, names[begin:end], n[begin:end], p[begin:end], z[begin:end], times)
            begin = end
    yield from tree.close()


def _single_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each source, the parts that need its own counts only, against all other sources."""
    for batch in batches:
        for row in batch.to_pylist():
            others = [(x["source"], x["z"] or 0) for x in row["others"]
                      if x["source"] != row["source"]]
            names = [name for name, _ in others]
            y = np.array([v for _, v in others], np.int64)
            cells = sorted((x["p"], x["times"]) for x in row["shares"] or ())
            p, times = (np.array(v, np.int64) for v in zip(*cells)) if cells else (
                np.zeros(0, np.int64), np.zeros(0, np.int64))
            z, terms = row["z"] or 0, row["terms"]
            below = np.concatenate([[0], np.cumsum(times * p)])
            count = np.concatenate([[0], np.cumsum(times)])
            at = np.searchsorted(p, y, side="right")
            apart = (below[-1] - below[at]) - (count[-1] - count[at]) * y + count[at] * y - below[at]
            single = apart - count[-1] * np.abs(z - y)
            whole = single + terms * np.abs(z - y)
            mine, lang = [row["source"]] * len(names), [row["lang"]] * 2 * len(names)
            yield _pairs(lang, mine + names, names + mine, whole.tolist() + single.tolist())


def source_pairs(cells: DataFrame, totals: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for all ordered pairs of a language's sources.

    ``cells`` has ``(lang, term, total, source, n, p, z)`` rows of nonzero counts and should be a
    stored table, as ``totals`` should.
    """
    # Small sources first: their small counts make the longest shared paths.
    paths = stored(
        cells.groupBy("lang", "term")
        .agg(F.sort_array(F.collect_list(F.struct("total", "source", "n", "p", "z"))).alias("path"))
        .groupBy("lang", "path").agg(F.count(F.lit(1)).alias("times")), "term-paths")
    both = (
        paths.repartitionByRange(
            "lang", F.slice("path", 1, DEALT_CELLS), F.xxhash64("path"))
        .sortWithinPartitions("lang", "path").mapInArrow(_tree_sums, _PAIR_ROW)
    )
    shares = (
        cells.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times"))
        .groupBy("lang", "source").agg(F.collect_list(F.struct("p", "times")).alias("shares"))
    )
    others = totals.groupBy("lang").agg(F.collect_list(F.struct("source", "z")).alias("others"))
    single = (
        totals.select("lang", "source", "terms", "z")
        .join(shares, ["lang", "source"], "left").join(others, "lang")
        .mapInArrow(_single_sums, _PAIR_ROW)
    )
    return single.union(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit_sources(df: DataFrame, text: str, lang: str, source: str, min_docs: int = MIN_DOCS,
                  top: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every group that occurs.

    Part ``pair`` has a row for each other source of the language, part ``term`` the ``top``
    terms whose share exceeds the language's, by value descending, then item in UTF-8 order.
    A null in any of the three columns counts as the empty string, so nulls and empty strings
    are one group. Empty texts and groups without kept terms have pair rows only, with value 0
    where their language keeps no term. Repeated rows are documents of their own. Very long
    texts are split in parts, between terms. An empty table gives no rows. Only the three named
    columns are read: others may have any names.
    """
    rows = stored(kept_terms(df, text, lang, source, min_docs), "kept-terms")
    totals = stored(group_totals(df, lang, source, rows), "group-totals")
    cells = stored(
        rows.select("lang", "term", F.col("n").alias("lang_n"), F.explode("cells").alias("c"))
        .select("lang", "term", "lang_n", F.col("c.source").alias("source"), F.col("c.n").alias("n"))
        .join(totals, ["lang", "source"])
        .withColumn("p", _share("n", "total", "terms"))
        .withColumn("q", _share("lang_n", "lang_total", "terms")), "term-cells")
    pairs = source_pairs(cells, totals).withColumn("part", F.lit("pair"))
    terms = cells.filter("p > q").select(
        "lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"),
        F.lit("term").alias("part"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    # Spark keeps the first rows of each group within tasks before it shuffles.
    terms = terms.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)
    return (
        pairs.withColumn("rank", F.row_number().over(by_value)).unionByName(terms)
        .select("lang", "source", "part", "item", "value", "rank")
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, audited by language and source."""
    return audit_sources(table(spark, sf_dir, "documents"), "text", "lang", "source")


_SHARE = "1 + (1000000000::HUGEINT * ({n} + 5)) // ({total} + 5 * v)"
SQL = f"""
WITH docs AS MATERIALIZED (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
    FROM documents
), kept AS MATERIALIZED (
    SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM docs)
    GROUP BY ALL HAVING count(*) >= {MIN_DOCS}
), counts AS MATERIALIZED (
    SELECT lang, source, term, count(*) AS n
    FROM (SELECT lang, source, unnest(terms) AS term FROM docs) SEMI JOIN kept USING (lang, term)
    GROUP BY ALL
), groups AS MATERIALIZED (
    SELECT DISTINCT lang, source FROM docs
), cells AS MATERIALIZED (
    SELECT lang, source, term, coalesce(n, 0) AS n, count(*) OVER (PARTITION BY lang, source) AS v,
        sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) AS total,
        sum(coalesce(n, 0)) OVER (PARTITION BY lang, term) AS lang_n,
        sum(coalesce(n, 0)) OVER (PARTITION BY lang) AS lang_total
    FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
), shares AS MATERIALIZED (
    SELECT lang, source, term, n, {_SHARE.format(n="n", total="total")} AS p,
        {_SHARE.format(n="lang_n", total="lang_total")} AS q
    FROM cells
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY ALL
), parts AS (
    SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
        LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, row_number() OVER (
    PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM parts QUALIFY part = 'pair' OR rank <= {TOP_TERMS}"""

QUERIES = {"op11_source_divergence": op11_source_divergence}
ORACLE = {"op11_source_divergence": SQL}
