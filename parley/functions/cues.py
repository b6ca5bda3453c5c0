"""Reviewer cue spans, computed with built-in expressions.

Offsets are code points of the original text.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import patterns as rx
from parley.functions.lexicon import TermTrie, check_size, normalized
from parley.settings import CUE_TERMS, CueTerm

# Beyond so many terms one expression per term makes the plan too large.
EXPRESSION_TERMS = 64

POSITIONS_TYPE = "array<struct<start:int,end:int>>"
CUES_TYPE = (
    "array<struct<keyword:string,category:string,severity:string,"
    f"start:int,end:int,count:int,positions:{POSITIONS_TYPE}>>"
)
SPANS_TYPE = "array<struct<start:int,end:int,keyword:string,category:string,severity:string>>"


def _pattern_literal(pattern: str) -> str:
    return 'r"' + pattern.replace('"', r"\x22") + '"'


def detect_cues(text: str, terms: Iterable[CueTerm] = CUE_TERMS) -> Column:
    """The cue records of the column ``text``."""
    return F.expr(cues_sql(text, terms))


def cues_sql(text: str, terms: Iterable[CueTerm] = CUE_TERMS) -> str:
    """One record per term that occurs in the column ``text``, ordered by its first span.

    One combined pattern decides whether a text has any cue at all, so the per-term work is
    spent on the few texts that do. A term's offsets are the running length over the pieces
    between its hits. Written as SQL, since a term is five calls and one parse serves them all.
    """
    terms = tuple(terms)
    records = []
    for cue in terms:
        pattern = _pattern_literal(rx.any_term((cue.keyword,)))
        keyword, category, severity = (
            json.dumps(v, ensure_ascii=False) for v in (cue.keyword, cue.category, cue.severity)
        )
        records.append(
            f"named_struct('keyword', {keyword}, 'category', {category}, 'severity', {severity}, "
            f"'gaps', CASE WHEN `{text}` RLIKE {pattern} THEN split(`{text}`, {pattern}, -1) END, "
            f"'hits', CASE WHEN `{text}` RLIKE {pattern} THEN regexp_extract_all(`{text}`, {pattern}, 0) END)"
        )
    # The last gap has no hit behind it.
    positions = f"""
        aggregate(
            arrays_zip(transform(r.gaps, g -> length(g)), transform(r.hits, h -> length(h))),
            named_struct('at', 0, 'found', CAST(array() AS {POSITIONS_TYPE})),
            (acc, p) -> named_struct(
                'at', acc.at + p.`0` + coalesce(p.`1`, 0),
                'found', CASE WHEN p.`1` IS NULL THEN acc.found ELSE concat(acc.found, array(
                    named_struct('start', acc.at + p.`0`, 'end', acc.at + p.`0` + p.`1`))) END),
            acc -> acc.found)"""
    found = f"""
        transform(
            filter(array({", ".join(records)}), r -> r.gaps IS NOT NULL),
            r -> named_struct('keyword', r.keyword, 'category', r.category,
                              'severity', r.severity, 'positions', {positions}))"""
    whole = f"""
        transform({found}, r -> named_struct(
            'keyword', r.keyword, 'category', r.category, 'severity', r.severity,
            'start', r.positions[0].start, 'end', r.positions[0].end,
            'count', size(r.positions), 'positions', r.positions))"""
    ordered = f"""
        array_sort({whole}, (a, b) -> CASE
            WHEN a.start <> b.start THEN CAST(sign(a.start - b.start) AS INT)
            ELSE CAST(sign(a.end - b.end) AS INT) END)"""
    has_any = _pattern_literal(rx.any_term(cue.keyword for cue in terms))
    return (
        f"CASE WHEN `{text}` RLIKE {has_any} THEN {ordered} ELSE CAST(array() AS {CUES_TYPE}) END"
    )


def add_cues(df: DataFrame, text: str, out: str, terms: Iterable[CueTerm] = CUE_TERMS) -> DataFrame:
    """Add the cue records of ``text``, with a lexicon of any size up to ``MOST_TERMS``.

    Few terms are built-in expressions; many go through one trie per worker, which only texts
    with some hit are sent to. Both give the same records.
    """
    terms = tuple(terms)
    if len(terms) <= EXPRESSION_TERMS:
        return df.withColumn(out, detect_cues(text, terms))
    check_size(terms)
    shared = df.sparkSession.sparkContext.broadcast([(t.keyword, t.category, t.severity) for t in terms])

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        trie = TermTrie(t[0] for t in known)

        def records(text: str) -> list[dict]:
            spans: dict[int, list[dict]] = {}
            for term, start, end in trie.hits(text):
                spans.setdefault(term, []).append({"start": start, "end": end})
            return [
                {"keyword": known[t][0], "category": known[t][1], "severity": known[t][2],
                 "start": own[0]["start"], "end": own[0]["end"], "count": len(own), "positions": own}
                for t, own in sorted(spans.items(), key=lambda s: (s[1][0]["start"], s[1][0]["end"]))
            ]

        for texts in batches:
            yield texts.map(records, na_action="ignore")

    # "Nondeterministic" keeps the optimiser from evaluating it again in pushed-down filters.
    udf = F.pandas_udf(find, CUES_TYPE).asNondeterministic()
    column, pattern = F.col(text), rx.any_term(normalized(t.keyword) for t in terms)
    return df.withColumn(
        out, F.coalesce(udf(F.when(column.rlike(pattern), column)), F.array().cast(CUES_TYPE)))


def explode_once(df: DataFrame, array: str, out: str) -> DataFrame:
    """One row per element of an array column, which is computed once.

    A plain explode makes the optimiser add a filter on the array's size below it, with the
    array's whole expression in it.
    """
    return df.withColumn(out, F.explode_outer(array)).filter(F.col(out).isNotNull())


def cue_summary(cues: Column) -> Column:
    """``keyword (category, severity) xN`` joined by ``"; "``."""
    parts = F.transform(
        cues,
        lambda c: F.concat(
            c["keyword"],
            F.lit(" ("),
            c["category"],
            F.lit(", "),
            c["severity"],
            F.lit(")"),
            F.when(c["count"] > 1, F.concat(F.lit(" x"), c["count"].cast("string"))).otherwise(""),
        ),
    )
    return F.coalesce(F.array_join(parts, "; "), F.lit(""))


def highlight_spans(text: Column, cues: Column) -> Column:
    """Non-overlapping spans: earliest start first, longest first among equal starts."""
    length = F.length(text)

    def clamp(offset):
        return F.least(F.greatest(offset, F.lit(0)), length)

    spans = F.flatten(
        F.transform(
            cues,
            lambda c: F.transform(
                c["positions"],
                lambda p: F.struct(
                    clamp(p["start"]).alias("start"),
                    clamp(p["end"]).alias("end"),
                    c["keyword"].alias("keyword"),
                    c["category"].alias("category"),
                    c["severity"].alias("severity"),
                ),
            ),
        )
    )
    spans = F.filter(spans, lambda s: s["end"] > s["start"])

    def order(a, b):
        return F.coalesce(
            F.nullif(F.signum(a["start"] - b["start"]), F.lit(0.0)),
            F.signum(b["end"] - a["end"]),
        ).cast("int")

    start = F.struct(F.lit(0).alias("cursor"), F.array().cast(SPANS_TYPE).alias("kept"))

    def step(acc, span):
        fits = span["start"] >= acc["cursor"]
        return F.struct(
            F.when(fits, span["end"]).otherwise(acc["cursor"]).alias("cursor"),
            F.when(fits, F.concat(acc["kept"], F.array(span))).otherwise(acc["kept"]).alias("kept"),
        )

    return F.aggregate(F.array_sort(spans, order), start, step, lambda acc: acc["kept"])


def highlight_segments(text: Column, spans: Column) -> Column:
    """The whole text cut into plain and marked pieces, in order."""

    def piece(begin, end, marked, span=None):
        def field(name):
            value = span[name] if span is not None else F.lit(None)
            return value.cast("string").alias(name)

        return F.struct(
            F.substring(text, begin + 1, end - begin).alias("text"),
            F.lit(marked).alias("marked"),
            field("keyword"),
            field("category"),
            field("severity"),
        )

    def before_and_at(span, i):
        previous = F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(F.lit(0))
        return F.array(
            piece(previous, span["start"], False),
            piece(span["start"], span["end"], True, span),
        )

    tail_start = F.coalesce(F.get(spans, F.size(spans) - 1)["end"], F.lit(0))
    pieces = F.concat(
        F.flatten(F.transform(spans, before_and_at)),
        F.array(piece(tail_start, F.length(text), False)),
    )
    return F.filter(pieces, lambda p: p["text"] != "")
