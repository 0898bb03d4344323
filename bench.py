"""Times the headline queries over whole tables and prints one JSON line.

Stage tables (book, labelled, scored) are timed where they are built, as queries of their own; everything after reads them.
``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the cores; ``BENCH_ONLY`` limits the run to some names.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "s4_snapshot_scan", "c4_daily_audit", "p3_depth", "f1_order_flow", "f5_autocorrelation", "f7_rolling_z", "f9_level_windows",
    "f12_run_lengths", "l1_labels", "r2_thresholds", "r9_quantile_sensitivity", "k2_classification_metrics", "k3_calibration",
    "k4_distribution_stats", "e5_gate_ablations", "b1_depth_sweep", "b3_cooldown", "b5_trade_summary", "t3_policy_tuning",
    "g1_stress_grid", "h3_policy_intervals",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from lobwright.plans import catalog, chain
    from lobwright.sources.book import read_events

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    rows = read_events(spark, sf).count()
    steps = {f"stage_{n}": (lambda f=f: f(spark, sf)) for n, f in
             (("book", chain.indexed_book), ("labelled", chain.labelled), ("regimed", chain.regimed), ("scored", chain.scored))}
    for name in HEADLINE:
        steps[name] = lambda name=name: catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    only = os.environ.get("BENCH_ONLY")
    times: dict[str, float] = {}
    for name, step in steps.items():
        if only and not name.startswith("stage_") and name not in only.split(","):
            continue
        t = time.perf_counter()
        step()
        times[name] = round(time.perf_counter() - t, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "order_book_headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": sf.rstrip("/").rsplit("sf", 1)[-1], "rows": rows, "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
