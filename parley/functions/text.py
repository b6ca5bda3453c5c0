"""Text normalisation and hashing.

HTML unescaping, NFKC and full case folding have no Spark built-in. They run in two small
Arrow UDFs that receive only the texts they can change; every other text arrives there as
null and keeps its JVM value. Of a batch, AT_ONCE texts at a time become Python objects.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import patterns as rx


AT_ONCE = 128


def _text_udf(change: Callable[[str], str]):
    """An Arrow UDF that changes texts one by one; null stays null."""
    size = AT_ONCE

    # The function is nested so that it travels to the workers by value.
    def changed(texts: pa.Array) -> pa.Array:
        import pyarrow as pa

        if texts.null_count == len(texts):
            return texts
        parts = []
        for i in range(0, len(texts), size):
            few = texts.slice(i, size)
            if few.null_count < len(few):
                few = pa.array([None if t is None else change(t) for t in few.to_pylist()], texts.type)
            parts.append(few)
        return pa.concat_arrays(parts)

    # "Nondeterministic" keeps the optimiser from evaluating it again in pushed-down filters.
    return F.arrow_udf(changed, "string").asNondeterministic()


def unescape_nfkc_udf():
    def unescape_nfkc(text: str) -> str:
        import html
        import unicodedata

        return unicodedata.normalize("NFKC", html.unescape(text))

    return _text_udf(unescape_nfkc)


def casefold_udf():
    return _text_udf(str.casefold)


def _unstable(text: Column) -> Column:
    """True if a character may change under NFKC or fold to more than its lower case."""
    return (F.octet_length(text) != F.length(text)) & ~text.rlike(rx.STABLE_TEXT)


def unescape_nfkc(text: Column) -> Column:
    """HTML entities resolved, then Unicode NFKC; null stays null. Pass a plain column."""
    has_entity = text.contains("&") & text.rlike(rx.ENTITY_START)
    return F.coalesce(unescape_nfkc_udf()(F.when(has_entity | _unstable(text), text)), text)


def casefold(text: Column) -> Column:
    """Full Unicode case folding. Pass a plain column."""
    simple = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.coalesce(casefold_udf()(F.when(_unstable(text), text)), simple)


def strip(text: Column) -> Column:
    """Unicode whitespace removed at both ends."""
    return F.regexp_replace(text, rx.EDGE_WS, "")


def strip_cell(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit(""))


def collapse(text: Column) -> Column:
    """Whitespace runs to one space, ends stripped."""
    return F.trim(F.regexp_replace(text, rx.WS_RUN, " "))


def is_blank(text: Column) -> Column:
    """Null, empty or whitespace only."""
    return F.coalesce(~text.rlike(rx.NON_BLANK), F.lit(True))


def _quoted(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def may_have_url(text: Column) -> Column:
    return text.contains("://") | F.lower(text).contains("www.")


def mask_urls(text: Column, token: str) -> Column:
    masked = F.regexp_replace(text, rx.URL, _quoted(token))
    return F.when(may_have_url(text), masked).otherwise(text)


def mask_emails(text: Column, token: str) -> Column:
    masked = F.regexp_replace(text, rx.EMAIL, "$1" + _quoted(token))
    return F.when(text.contains("@"), masked).otherwise(text)


def add_flat_text(df: DataFrame, raw: str, out: str) -> DataFrame:
    """Add the unescaped, normalised text with collapsed whitespace; null becomes empty.

    The functions from here on add columns instead of returning expressions: each step uses its
    input several times, and a named column is computed once where a nested expression would be
    repeated.
    """
    return (
        df.withColumn("__norm", unescape_nfkc(F.col(raw)))
        .withColumn(out, F.coalesce(collapse(F.col("__norm")), F.lit("")))
        .drop("__norm")
    )


def add_masked_text(
    df: DataFrame,
    flat: str,
    out: str,
    replace_urls: bool = True,
    replace_emails: bool = True,
    url_token: str = "<URL>",
    email_token: str = "<EMAIL>",
) -> DataFrame:
    """Add the flat text with e-mails, then URLs, replaced.

    No address contains whitespace, so collapsing before masking gives the same text, and the
    flat form can be shared with the duplicate key.
    """
    df = df.withColumn(
        "__mailed", mask_emails(F.col(flat), email_token) if replace_emails else F.col(flat)
    )
    df = df.withColumn(
        out, mask_urls(F.col("__mailed"), url_token) if replace_urls else F.col("__mailed")
    ).drop("__mailed")
    used = [t for t, on in ((email_token, replace_emails), (url_token, replace_urls)) if on]
    plain = all(t and t == " ".join(t.split()) for t in used)
    return df if plain else df.withColumn(out, collapse(F.col(out)))


def add_clean_text(df: DataFrame, raw: str, out: str = "text_clean", **options) -> DataFrame:
    """Add the lightly cleaned text; null becomes the empty string."""
    flat = add_flat_text(df, raw, "__flat")
    return add_masked_text(flat, "__flat", out, **options).drop("__flat")


def add_casefolded(df: DataFrame, source: str, out: str) -> DataFrame:
    return df.withColumn(out, casefold(F.col(source)))


def add_duplicate_text(df: DataFrame, raw: str, out: str, fold: bool = True) -> DataFrame:
    """Add the text two comments must share to be duplicates; nothing is masked."""
    if not fold:
        return add_flat_text(df, raw, out)
    return add_casefolded(add_flat_text(df, raw, "__flat"), "__flat", out).drop("__flat")


def add_export_text(df: DataFrame, clean: str, out: str = "clean_text") -> DataFrame:
    """Add lower-case letters and digits only, masks and addresses dropped.

    The input is already clean; it is unescaped a second time on purpose.
    """
    bare = F.col("__bare")
    for token in ("<url>", "<email>"):
        bare = F.replace(bare, F.lit(token), F.lit(" "))
    return (
        df.withColumn("__norm", unescape_nfkc(F.col(clean)))
        .withColumn("__low", F.lower("__norm"))
        .withColumn("__unlinked", mask_urls(F.col("__low"), " "))
        .withColumn("__bare", mask_emails(F.col("__unlinked"), " "))
        .withColumn(
            out, F.coalesce(F.trim(F.regexp_replace(bare, "[^a-z0-9]++", " ")), F.lit(""))
        )
        .drop("__norm", "__low", "__unlinked", "__bare")
    )


def word_count_collapsed(collapsed: Column) -> Column:
    """Words of a text whose whitespace is already collapsed."""
    spaces = F.length(collapsed) - F.length(F.replace(collapsed, F.lit(" "), F.lit("")))
    return (spaces + (collapsed != "").cast("int")).cast("int")


def word_count(text: Column) -> Column:
    """Whitespace-separated words; null has none."""
    return word_count_collapsed(F.coalesce(collapse(text), F.lit("")))


def sha256_text(text: Column) -> Column:
    """Hex SHA-256 of the UTF-8 text; null hashes like the empty string."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)
