"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from flightwords.plans import QUERIES
from flightwords.session import local_session

HEADLINE = (
    "decode_samples", "decode_status_counts", "series_stats_30s", "ring_last_n", "latest_value", "carry_forward", "word_rate",
    "assembler_stats", "wrong_rate", "bit_overlap", "encode_patterns", "live_equals_batch",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "flightwords-bench", "16g")
    QUERIES["decode_status_counts"](spark, sf_dir).limit(1).collect()  # start the session and prepare the mapping
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
