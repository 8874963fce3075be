"""Write PLANS.md: physical-plan shape of every registered query.

For each query: parquet scans, shuffle exchanges, broadcast exchanges,
window operators, sorts and Python (pandas/Arrow) operators of the executed
plan, plus the read schema of each scan.  Used to spot re-reads, extra
shuffles and unpruned columns.

usage: python tools/plan_report.py [SF_DIR]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gatewise.plans.catalog import REGISTRY, queries  # noqa: E402
from gatewise.session import local_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    rows = []
    for name, fn in queries().items():
        df = fn(spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        py = len(re.findall(r"(FlatMapGroupsInPandas|MapInPandas|ArrowEvalPython|FlatMapGroupsInPandasWithState)", plan))
        rows.append(
            (
                name,
                len(re.findall(r"Scan parquet", plan)),
                len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin|Exchange SinglePartition", plan)),
                plan.count("BroadcastExchange"),
                len(re.findall(r"\bWindow \[", plan)),
                py,
                "oracle" if REGISTRY[name].sql else "rows-only",
            )
        )
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("# Physical plan shape per registered query\n\n")
        f.write(f"Generated by `tools/plan_report.py` at `{sf}` (local[8], AQE on; counts from the final adaptive plan).\n")
        f.write("Scans = parquet reads (stage outputs written by `materialize` count as reads), shuffles = hash/range/round-robin/single exchanges.\n\n")
        f.write("| query | scans | shuffles | broadcasts | windows | python ops | check |\n| --- | --- | --- | --- | --- | --- | --- |\n")
        for r in rows:
            f.write("| " + " | ".join(str(x) for x in r) + " |\n")
    print(f"wrote {len(rows)} rows")


if __name__ == "__main__":
    main()
