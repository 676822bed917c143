"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tokenloom.plans import catalog  # noqa: E402
from tokenloom.session import build_session  # noqa: E402

HEADLINE = ("top_identifiers value_frequencies file_token_stats corpus_token_stats corpus_lines line_counts clean_files "
            "garbage_filter encode_files decode_characters shard_assignment training_files pair_counts train_merges "
            "corpus_token_count training_examples vocabulary_sweep").split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                          spark__driver__memory="12g", spark__checkpoint__dir=tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    queries["top_identifiers"](spark, folder).limit(1).collect()      # start-up and file listing stay out of the times
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
