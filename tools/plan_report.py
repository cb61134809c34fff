"""Write PLANS.md: physical-plan shape of every registered query (final AQE plan).

usage: python tools/plan_report.py [sf_dir]
"""
from __future__ import annotations

import re
import sys

sys.path.insert(0, "/root/repo")
from pricelab.plans.registry import REGISTRY  # noqa: E402
from pricelab.session import local_session  # noqa: E402

SKIP_EXEC = {"model_roundtrip", "stream_pricing_kpis", "catalog_scan", "report_sink"}


def shape(plan: str) -> dict:
    final = plan.split("== Initial Plan ==")[0]
    lines = final.splitlines()
    aggs = [l for l in lines if re.search(r"(Hash|ObjectHash|Sort)Aggregate\(", l)]
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobin)", final)),
        "single": final.count("Exchange SinglePartition"),
        "bhj": final.count("BroadcastHashJoin"),
        "smj": final.count("SortMergeJoin"),
        "nlj/cartesian": final.count("BroadcastNestedLoopJoin") + final.count("CartesianProduct"),
        "window": len(re.findall(r"\bWindow \[", final)),
        "generate": final.count("Generate "),
        "aggs": f"{sum('HashAggregate(' in l and 'Object' not in l for l in aggs)}h/"
                f"{sum('SortAggregate(' in l for l in aggs)}s/{sum('ObjectHashAggregate(' in l for l in aggs)}o",
        "agg outside codegen": sum(not re.search(r"\*\(\d+\)", l) for l in aggs),
        "topk": final.count("TakeOrderedAndProject"),
        "subq": len(set(re.findall(r"Subquery subquery#(\d+)", final))),
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    rows = []
    for k, fn in REGISTRY.items():
        df = fn(spark, sf)
        if k not in SKIP_EXEC:
            df.collect()  # execute this DataFrame's own plan so AQE finalizes it
        rows.append((k, shape(df._jdf.queryExecution().executedPlan().toString())))
    cols = list(rows[0][1])
    out = ["# Physical plan shapes", "",
           f"Final (AQE) physical plans of every registered query at `{sf}` on local[8],",
           "generated by `tools/plan_report.py`.  Counts are operators in the final plan",
           "(scalar subqueries included).  `aggs` = hash/sort/object aggregates;",
           "`agg outside codegen` counts aggregates without a whole-stage-codegen marker",
           "(the sort-based `min(struct)` partial aggregates and the forest's object",
           "aggregates run interpreted by design).  Keys that read a written table",
           "(stream sink, report sink, CSV round trip, model round trip) show the read plan.",
           "", "| key | " + " | ".join(cols) + " |", "|---" * (len(cols) + 1) + "|"]
    for k, s in rows:
        out.append(f"| `{k}` | " + " | ".join(str(s[c]) for c in cols) + " |")
    open("/root/repo/PLANS.md", "w").write("\n".join(out) + "\n")
    print("\n".join(out))


if __name__ == "__main__":
    main()
