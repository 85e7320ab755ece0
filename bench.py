"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pagetide.plans.queries import QUERIES  # noqa: E402
from pagetide.session import local_session  # noqa: E402

HEADLINE = (
    "refresh_records", "refresh_records_markdown", "registry_upsert", "registry_fold", "registry_history",
    "markdown_corpus", "main_content", "page_links", "next_urls", "reachable", "duplicate_members", "byte_chunks",
    "shard_pack", "entries_combined", "jsonl_scan", "markdown_post",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(
        cores,
        "bench",
        **{
            "spark.sql.shuffle.partitions": cores,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds = {}
    for name in names:
        once(name)  # warm-up
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(f"{name:28s} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, median of %d runs" % runs,
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
