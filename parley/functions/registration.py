"""The text functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from parley.functions import patterns as rx
from parley.functions.cues import CUES_TYPE, cues_sql
from parley.functions.text import casefold_udf, unescape_nfkc_udf


def _raw(pattern: str) -> str:
    return 'r"' + pattern.replace('"', r"\x22") + '"'


def register_functions(spark: SparkSession) -> None:
    """Make ``parley_*`` available to ``spark.sql`` in this session."""
    spark.udf.register("parley_unescape_nfkc", unescape_nfkc_udf())
    spark.udf.register("parley_casefold", casefold_udf())
    flat = f'coalesce(trim(regexp_replace(parley_unescape_nfkc(t), {_raw(rx.WS_RUN)}, " ")), "")'
    mails = f'regexp_replace({flat}, {_raw(rx.EMAIL)}, "$1<EMAIL>")'
    bodies = {
        "parley_text_clean": ("STRING", f'regexp_replace({mails}, {_raw(rx.URL)}, "<URL>")'),
        "parley_duplicate_key": ("STRING", f"sha2(parley_casefold({flat}), 256)"),
        "parley_detect_cues": (CUES_TYPE.upper(), cues_sql("t")),
    }
    for name, (kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
