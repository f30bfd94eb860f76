"""Wall seconds of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from flowhelm.session import local_session  # noqa: E402

HEADLINE = [
    "source_activity", "time_delta_features", "packet_features", "temporal_edges", "node_lifecycle", "edges_statistics",
    "impute_median", "standard_scale", "ip_features", "anova_f", "mutual_info", "sample_stratified", "split_train_test", "kfold_time",
    "proximity_edges", "knn_graph", "degrees", "gap_statistics", "dbscan_1d", "autocorrelation", "events_in_windows", "session_bursts",
    "random_walks", "frontier", "enc_fourier", "edge_softmax", "attention_aggregate", "nids_report_binary", "fpr_at_tpr_multiclass",
    "stream_tumbling",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_SHUFFLE", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    from flowhelm import catalog  # noqa: F401
    from flowhelm.catalog.registry import QUERIES

    names = sys.argv[1:] or HEADLINE
    QUERIES["node_lifecycle"](spark, sf).write.format("noop").mode("overwrite").save()  # start the JVM
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf)}))


if __name__ == "__main__":
    main()
