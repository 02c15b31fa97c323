"""Wall seconds of the headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Each query is
run once to warm up and timed on its second run, result written to a sink that drops it. Options: query names.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "capture_summary", "capture_summary_ext", "burst_factor", "burst_intensity", "rtt_pairs", "iat", "session_activity",
    "describe_numeric", "stats_advanced", "data_profile", "corr_matrix", "distinct_profile", "duplicate_rows", "iqr_filter",
    "label_encode", "zscore", "robust_scale", "join_flow_packet", "join_interval", "cidr_rules", "graph_components",
    "degree_histogram", "peak_activity", "split_stratified", "mutual_information", "anova_f", "roc_auc", "threshold_search",
    "dp_laplace", "drift_psi", "composite_score", "iforest", "dt_predict", "rf_predict", "knn_exact", "dbscan", "pcap_packets",
    "frame_decode", "stream_counts", "auto_block",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from gridlens.plans import QUERIES
    from gridlens.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus))
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
