"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores, BENCH_QUERIES an
optional comma-separated selection.
"""

from __future__ import annotations

import json
import os
import sys
import time

from parley import catalog
from parley.session import local_session

HEADLINE = (
    "text_clean", "normalize_for_duplicate", "teammate_clean_text", "text_hash_normalized", "bert_token_len",
    "has_obfuscation", "has_identity_term", "contains_email", "standardize", "standardize_scored",
    "dedup_normalized", "removal_summary", "normalized_duplicate_count", "audit_dataset", "length_stats",
    "slice_summary", "stratified_split3", "stratified_split2", "capped_sample",
    "split_hash_overlap", "pool_external_overlap", "detect_cues", "cue_statistics",
    "highlight_segments", "build_review_item", "review_queue", "queue_topk", "queue_rank",
    "queue_summary", "review_queue_csv", "load_multilabel", "upload_csv_comments",
    "upload_txt_comments", "analyze_file", "analyze_stream", "tfidf_vocab", "tfidf_weights",
    "fit_logistic", "score_comments", "classification_report", "write_split_tables",
    "run_pipeline",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cores, partitions=8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    # One small query starts the JVM's and Python's workers.
    catalog.QUERIES["dedup_normalized"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
