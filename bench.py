"""Times the headline queries; prints one JSON line."""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
HEADLINE = ("pci_segment_state", "pci_frame_score", "fld_filter", "jn_iou_greedy", "vis_frame", "vis_thresholds", "win_time_median", "win_cut_dense", "jn_interp", "geo_proximity", "ev_regression", "ev_presence", "ev_psi")


def main() -> None:
    from pavescope.plans.queries import QUERIES
    from pavescope.session import session

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.checkpoint.dir": f"file://{tempfile.mkdtemp()}"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        took = []
        for _ in range(3):
            began = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        times[name] = round(sorted(took)[1], 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_median_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
