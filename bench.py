"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tripweave import queries as bound  # noqa: E402
from tripweave.session import get_session  # noqa: E402

HEADLINE = [
    "destination_flow_totals", "choice_probabilities", "calibration_table", "proportional_allocation", "group_medians",
    "distribution_by_group", "column_profiles", "weighted_user_moments", "quota_selection", "shrunken_scores", "fused_features",
    "choice_table", "choice_model", "count_model", "transit_skims", "point_in_zone", "zones_within_distance", "spatial_clusters",
    "spread_scores", "correlation_pairs", "multiple_regression", "tied_ranks", "running_ids", "clean_names",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="bench-")
    atexit.register(shutil.rmtree, scratch, ignore_errors=True)
    spark = get_session("bench", f"local[{cpus}]", **{"spark.checkpoint.dir": scratch, "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    bound.load_all()
    spark.read.parquet(f"{folder}/lineitem.parquet").count()  # start the executor threads
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        bound.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
