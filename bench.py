"""Wall time of the headline queries. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logsieve.plans.experiment import click_experiment  # noqa: E402
from logsieve.plans.queries import QUERIES  # noqa: E402
from logsieve.session import local_session  # noqa: E402

HEADLINE = ["profile_all_levels", "split_by_rows", "inject_time", "feat_trace_pos", "feat_workload_ties",
            "ctx_all_features", "minmax_scale", "dbscan_noise", "lof_scores", "iforest_scores", "gmm_thresholds",
            "confusion_matrix", "knn_distance_line", "iqr_threshold_sweep", "metrics_over_runs"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench", **{"spark__ui__showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    jobs = dict(QUERIES, experiment_iforest=lambda s, d: click_experiment(s, d, runs=(1,)))
    times = {}
    for name in wanted:
        start = time.time()
        jobs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "wall seconds of the headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                      "cpus": int(cores)}))


if __name__ == "__main__":
    main()
