"""Times every series query once and prints one JSON line; BENCH_ONLY takes some of them, separated by commas."""

import json
import os
import time

from oriel.plans import queries as series
from oriel.session import build_session


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    series.QUERIES["slots_regular"](spark, sf_dir).count()
    took = {}
    for name, run in series.QUERIES.items():
        if only and name not in only:
            continue
        began = time.time()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "series_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
