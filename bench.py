"""Benchmark the headline queries.

Runs a fixed set of registered queries at $BENCH_SF_DIR (default sf0.1) on
local[$BENCH_CPUS] and prints ONE JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
``catalog_build`` derives the catalog from the tables and writes the raw
and both cleaned editions once (as a user would before running reports);
each report then runs on that table and is fully executed (``noop`` write,
no collection of large results).  ``train_model`` fits the 50-tree forest and
``score_catalog`` batch-scores every product with it; the two what-if flows
run every product through it.  Per-key values are medians of $BENCH_RUNS runs
after one warm-up; ``value`` is their sum.  ``plans`` gives each key's scans and
exchanges.
"""
from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pricelab.plans.catalog import clear_cache, cleaned_catalog  # noqa: E402
from pricelab.operators.model import score_catalog, train_price_model  # noqa: E402
from pricelab.plans.registry import REGISTRY  # noqa: E402
from pricelab.plans.whatif import forest_optimizer_pricing, forest_playground_pricing  # noqa: E402
from pricelab.session import local_session  # noqa: E402

HEADLINE = [
    "catalog_scan",
    "dataset_overview",
    "numeric_summary",
    "categorical_summary",
    "correlation_matrix",
    "price_by_category_top10",
    "price_histogram",
    "first_row_per_name",
    "popular_products",
    "weighted_features_calibrated",
    "scenario_grid",
    "sensitivity_sweep",
    "feature_impact",
    "recommendation",
    "regression_metrics",
    "residuals",
    "impact_report",
    "stream_pricing_kpis",
]


def build_catalog(spark, sf_dir: str) -> float:
    """Derive the raw catalog from the tables and both cleaned editions, written once."""
    clear_cache()
    t0 = time.perf_counter()
    cleaned_catalog(spark, sf_dir, "strict")
    cleaned_catalog(spark, sf_dir, "lenient")
    return time.perf_counter() - t0


def train_once(spark, sf_dir: str):
    """M1: fit the 50-tree forest on the cleaned catalog; returns (seconds, model)."""
    clean = cleaned_catalog(spark, sf_dir)
    t0 = time.perf_counter()
    model = train_price_model(clean)
    return time.perf_counter() - t0, model


def score_once(spark, sf_dir: str, model) -> float:
    """M2: batch-score every product with the trained forest."""
    t0 = time.perf_counter()
    score_catalog(model, cleaned_catalog(spark, sf_dir)).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def run_once(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    df = REGISTRY[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def flow_once(spark, flow, flags: str, sf_dir: str, model) -> float:
    """A what-if flow (F3 / F4, forest, KPIs) for every product."""
    t0 = time.perf_counter()
    flow(model, cleaned_catalog(spark, sf_dir, flags)).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def final_lines(plan: str) -> list[str]:
    """Lines of the plan as executed: without the initial plans that adaptive plans also print."""
    out, skip = [], None
    for line in plan.splitlines():
        indent = len(line) - len(line.lstrip(" :+-"))
        if skip is not None and indent > skip:
            continue
        skip = indent - 1 if "== Initial Plan ==" in line else None
        if skip is None:
            out.append(line)
    return out


def plan_counts(spark, name: str, sf_dir: str) -> dict:
    """Scans and exchanges of the executed plan; what is reused counts once."""
    df = REGISTRY[name](spark, sf_dir)
    df.collect()
    lines = [x for x in final_lines(df._jdf.queryExecution().executedPlan().toString()) if "Reused" not in x]
    return {"scans": sum("FileScan" in x or " Scan " in x for x in lines),
            "exchanges": sum(bool(re.search(r"\b(Broadcast)?Exchange\b", x)) for x in lines)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus=cpus, shuffle_partitions=int(os.environ.get(
        "BENCH_SHUFFLE_PARTITIONS", str(max(8, int(cpus) if cpus.isdigit() else 8)))))
    build_catalog(spark, sf_dir)
    for name in HEADLINE:  # warm-up: JIT, file listing, class loading
        run_once(spark, name, sf_dir)
    per = {"catalog_build": round(statistics.median(
        build_catalog(spark, sf_dir) for _ in range(runs)), 3)}
    for name in HEADLINE:
        per[name] = round(statistics.median(run_once(spark, name, sf_dir) for _ in range(runs)), 3)
    fits = [train_once(spark, sf_dir) for _ in range(runs)]
    per["train_model"] = round(statistics.median(t for t, _ in fits), 3)
    model = fits[-1][1]
    score_once(spark, sf_dir, model)  # warm-up
    per["score_catalog"] = round(statistics.median(score_once(spark, sf_dir, model)
                                                   for _ in range(runs)), 3)
    flows = {"forest_optimizer_flow": (forest_optimizer_pricing, "strict"),
             "forest_playground_flow": (forest_playground_pricing, "lenient")}
    for name, (flow, flags) in flows.items():
        flow_once(spark, flow, flags, sf_dir, model)  # warm-up
        per[name] = round(statistics.median(flow_once(spark, flow, flags, sf_dir, model) for _ in range(runs)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_sec", "value": round(sum(per.values()), 3), "unit": "sec",
                      "queries": per, "plans": {k: plan_counts(spark, k, sf_dir) for k in HEADLINE}, "sf": sf, "cpus": cpus, "runs": runs,
                      "spark": spark.version}))


if __name__ == "__main__":
    main()
