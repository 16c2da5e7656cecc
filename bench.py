"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR  folder of the parquet tables   (default /root/testdata/sf0.1)
BENCH_CPUS    cores of the local master      (default 8)
BENCH_RUNS    timed runs per query after one warm-up; the median counts (default 3)
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rowflow.queries import QUERIES  # noqa: E402
from rowflow.session import build_session  # noqa: E402

HEADLINE = [
    "join_multiway",
    "join_self_theta",
    "join_semi",
    "join_pair",
    "agg_having",
    "agg_tagged_metrics",
    "agg_list_struct",
    "win_count_over",
    "set_except_all",
    "top_n",
    "rs_process",
    "rs_reduce",
    "rs_reduce_topn",
    "rs_reduce_rank",
    "rs_combine",
    "rs_combine_tfidf",
    "rs_partition_lookup",
    "src_streamset_date",
    "snk_clustered",
    "prm_string_format",
    "prm_external",
    "prm_ref_chain",
    "cor_references",
    "lin_version_edges",
    "lin_read_edges",
    "wf_ingest_xml",
    "wf_dep_edges",
    "wf_closest_match",
    "gr_trace_down",
    "gr_contract",
    "cat_page_links",
    "cat_size_cache",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "rowflow-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    times = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        run(spark, name, folder)
        times[name] = round(statistics.median(run(spark, name, folder) for _ in range(runs)), 3)
        if only:
            print(name, times[name], file=sys.stderr)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries (median of warm runs)",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
