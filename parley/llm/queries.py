"""All registered queries of the training-data operators, with the SQL where there is one."""

import corpus_pipeline
from parley.llm import (
    classifier, decontamination, jaccard_join, line_dedup, lm_scoring, packing, quality_rules,
    sharding, source_divergence, spelling_variants, substring_dedup, toxicity, warc,
)

_PARTS = (
    sharding, quality_rules, warc, line_dedup, packing, lm_scoring, decontamination, classifier,
    substring_dedup, jaccard_join, source_divergence, spelling_variants, toxicity,
)
QUERIES = {name: fn for part in _PARTS for name, fn in part.QUERIES.items()}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLE = {name: text for part in _PARTS for name, text in part.ORACLE.items()}
