"""Benchmark the headline queries.

Runs every query registered with ``bench=True`` at ``$BENCH_SF_DIR``
(default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints one JSON
line.  Each query is executed in full through the ``noop`` sink (all rows
computed, nothing collected to the driver).  An untimed warm-up pass runs
every query once (JVM start-up, JIT and codegen of each plan shape); the
timed pass follows.  Query construction (including any checkpoint jobs an
operator runs to cut lineage) is inside the timed region.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gatewise.plans.catalog import REGISTRY, queries  # noqa: E402
from gatewise.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:]]
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), app="gatewise-bench")
    qs = queries()
    names = [n for n, e in REGISTRY.items() if e.bench and (not only or any(o in n for o in only))]
    for n in names:
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for n in names:
        t0 = time.perf_counter()
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
