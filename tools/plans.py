"""Write PLANS.md: the physical plan shape of every headline query (sf0.01)."""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from bench import HEADLINE  # noqa: E402
from textlab.registry import QUERIES, load_catalog  # noqa: E402
from textlab.session import build_session  # noqa: E402

KEEP = re.compile(r"(Exchange \w+|BroadcastExchange|\w*Join\w*|\w*Aggregate|Window|Sort |Generate|"
                  r"FileScan \w+|Scan ExistingRDD|InMemoryTableScan|Union|TakeOrderedAndProject)")

NOTES = {
    "label_corpus": "publication side measured and broadcast; sections never shuffled; one shuffle for the dedup",
    "clean_funnel": "one Expand + shuffle of digests for the three distinct counts; final count on one row",
    "split_profile": "labelled corpus read from its checkpoint; one (split, name) aggregate feeds all measures",
    "contain_pairs": "equi-joins on the rarest word of each passage; candidate keys meet the texts once; no nested loop",
    "encode_tokens": "looked up inside each row in Arrow batches; the vocabulary is a broadcast variable",
    "text_features": "hashes sorted and counted inside the row, a batch at a time; no exchange",
    "validation_split": "the cut is found while the query is built; rows are compared with a constant",
    "train_focal": "the epochs run while the query is built, each one pass over the vectors and one sum by feature; what is left is the log",
}


def main() -> None:
    load_catalog()
    spark = build_session("local[8]")
    sf = "/root/testdata/sf0.01"
    out = ["# PLANS", "", "Physical plans of the bench's headline queries (sf0.01, textlab session settings,",
           "AQE initial plan). Generated by `tools/plans.py`. Exchanges, joins and windows are counted;",
           "`SinglePartition` exchanges only ever feed bounded tables (histograms, partition counts, ",
           "single-row aggregates).", ""]
    for k in HEADLINE:
        df = QUERIES[k](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines = [ln for ln in plan.splitlines() if KEEP.search(ln)]
        ex = re.findall(r"Exchange (\w+)", plan)
        out += [f"## {k}", "",
                f"exchanges: {', '.join(ex) or 'none'}; broadcast: {plan.count('BroadcastExchange')}; "
                f"sort-merge joins: {plan.count('SortMergeJoin')}; nested-loop joins: "
                f"{plan.count('NestedLoopJoin')}; cartesian: {plan.count('CartesianProduct')}; "
                f"windows: {plan.count('Window [')}", ""]
        if k in NOTES:
            out += [NOTES[k], ""]
        out += ["```"] + [re.sub(r"#\d+L?", "", ln)[:150] for ln in lines[:40]] + ["```", ""]
    open(os.path.join(ROOT, "PLANS.md"), "w", encoding="utf-8").write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
