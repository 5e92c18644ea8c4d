"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query writes all its rows to the no-op sink, so nothing is pruned away and nothing is
collected. A first query on the same tables warms the session up and is not timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from planledger import catalog
from planledger.session import local_session

HEADLINE = (
    "h1_plan_nodes",
    "h2_flatten_plan",
    "h3_costliest_node",
    "h4_slowest_node",
    "h4_document_picks",
    "h7_seq_scans",
    "i2_score_stats",
    "i3_top_offenders",
    "i4_query_scores",
    "i7_recommend",
    "i7_recommend_from_documents",
    "i8_affected_locations",
    "f5_multi_hop",
    "f6_shared_prefix",
    "f7_implied_joins",
    "c4_dedupe_statements",
    "d3_extract_predicates",
    "d4_column_hits",
    "b1_service_calls",
    "b5_assemble_appends",
    "e5_associations",
    "e6_inherit_columns",
    "g4_bind_parameters",
    "g5_find_sentinels",
    "a4_incremental_scan",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("planledger-bench", cores=os.environ.get("BENCH_CPUS", "8"))
    queries = catalog.queries()
    names = sys.argv[1:] or HEADLINE
    queries["h6_root_metrics"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}
        )
    )


if __name__ == "__main__":
    main()
