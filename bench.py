"""Benchmark of the headline chains; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is fully computed into Spark's ``noop`` sink (no rows reach the
driver).  One small warm-up run at sf0.001 precedes the timed runs, so JIT
start-up is not charged to the first query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "m6_matched_sentences",            # matching chain, equal words (conversations)
    "m6_matched_lexicon",              # matching chain with word vectors and the exact similarity join
    "m6_revision_matched",             # matching chain on the planted revision history
    "a17_doc_level_stats_refactors",   # moved-sentence chain: matching -> crossings -> refactor edges -> stats
    "s6_export_pairs_json",            # pair-record export: nodes + arcs per version pair as JSON
    "d2_sentence_diff_set",            # sentence diff of consecutive versions
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from revisionlens.plans import registry as R
    from revisionlens.session import get_spark

    spark = get_spark(cpus)
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        R.QUERIES["m6_matched_sentences"](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for key in HEADLINE:
        t0 = time.time()
        R.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_chains_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
