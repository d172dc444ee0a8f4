"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is executed in full into Spark's no-op sink (nothing is collected
to the driver).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "label_corpus", "clean_funnel", "split_profile", "contain_pairs", "match_mentions",
    "balance_classes", "validation_split", "assign_row_id", "build_vocab", "encode_tokens",
    "pad_to_length", "text_features", "span_corpus", "pr_curve", "classification_report",
    "format_report", "checkpoint_decisions", "focal_loss", "train_focal", "train_weighted", "run_experiment",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from textlab.registry import QUERIES, load_catalog
    from textlab.session import build_session
    from textlab.sources.readers import INPUT_PARTITIONS

    load_catalog()
    # the tables are files of one row group each: dealt out, or one core would do all the work on a text
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app="textlab-bench",
                          extra={INPUT_PARTITIONS: str(cpus)})
    # steady state: run every headline query once on the smallest data set so
    # class loading and code generation are not billed to the first query
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in HEADLINE:
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
