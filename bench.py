"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

HEADLINE = ("ebr_pin_depth", "ebr_pin_intervals", "ebr_flushes", "ebr_epoch_timeline", "ebr_retired_stamped", "ebr_reclaimed", "ebr_attempts", "ebr_shutdown", "ebr_backlog")


def main() -> None:
    from stillwater.plans.queries import QUERIES
    from stillwater.session import local_session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=8)
    QUERIES["ebr_flushes"](spark, sf_dir).limit(1).collect()  # compiled code and Python workers
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "replay queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
