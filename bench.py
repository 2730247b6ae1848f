"""Time the registered queries: one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES`` (comma-separated) a selection.
Every result is computed in full and thrown away by the no-op sink.
"""

from __future__ import annotations

import json
import os
import re
import time

from lumbre.plans.registry import all_queries
from lumbre.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = local_session(CPUS, app="lumbre-bench", **{"spark.driver.memory": "16g"})
    queries = all_queries()
    chosen = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name] or list(queries)
    spark.read.parquet(f"{SF_DIR}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start-up is not timed
    seconds = {}
    for name in chosen:
        begin = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    scale = re.search(r"sf([0-9.]+)", SF_DIR)
    print(
        json.dumps(
            {
                "metric": "total time of all queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
