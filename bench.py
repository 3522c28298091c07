"""Times the headline queries: one warm-up and the median of three runs each, as one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "flagship", "stream_where", "where_correlated_asof", "merge_streams", "running_sum", "global_running_sum", "window_sum_1h", "window_expirations",
    "value_window_max", "dict_where_changelog", "entity_belongs_to", "entity_has_many", "listener_counter", "how_long", "segment_volumes", "ticks_resample",
]


def main() -> None:
    from steploom.plans.catalogue import QUERIES

    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for i in range(4):
            began = time.perf_counter()
            QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs), 3)
        print(name, took[name], file=sys.stderr)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/"))}))


if __name__ == "__main__":
    main()
