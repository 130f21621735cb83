"""Times the headline queries and prints one JSON line.

Every query is run twice in a warm session and written to the `noop` sink, so the whole result is
computed and nothing is collected. `queries` holds the second run, `first_run` the first. The feeds and the
published table that queries read are written before, timed on their own under `fixtures`. `more` holds one run of
queries that aren't part of the total, model fits and streams among them.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from tagsmith.workload import roles  # noqa: E402
from tagsmith.workload.queries import registered  # noqa: E402

HEADLINE = [
    "sku_sales", "ga4_signal_counts", "inventory_totals", "demand_score",
    "lowest_competitor", "competitor_map", "competitor_position", "master_dataset",
    "master_dataset_batch", "sku_dedup", "null_report", "golden_clean", "price_rules_batch",
    "price_rules_service", "elasticity_fit", "elasticity_price", "price_sweep_linear",
    "ai_output", "hybrid_price", "request_pricing", "missing_requests", "request_summary",
    "revenue_current_vs_new", "revenue_ai_vs_rule", "champion_vs_challenger",
    "strategy_dashboard", "hash_split", "time_split", "regression_metrics",
    "classification_metrics", "registry_resolve", "registry_champion", "registry_promote",
    "query_text_clean", "gap_counts", "stream_ga4_counts", "rule_outcomes",
]
MORE = ["sweep_mllib", "registered_champions", "train_leafwise", "intent_classifier", "gap_chain",
        "stream_ga4_windows", "feeds_to_master", "priced_table"]


def seconds(run) -> float:
    started = time.perf_counter()
    run()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tagsmith-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:] or HEADLINE
    first: dict[str, float] = {}
    second: dict[str, float] = {}
    fixtures = {name: seconds(lambda role=getattr(roles, name): role(spark, sf_dir))
                for name in ("competitor_feed", "competitor_feed_by_name", "published")}

    def whole(name: str) -> float:
        return seconds(lambda: registered()[name](spark, sf_dir).write.format("noop").mode("overwrite").save())

    for name in only:
        first[name] = whole(name)
        second[name] = whole(name)
    more = {name: whole(name) for name in MORE} if only is HEADLINE else {}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(second.values()), 3),
        "unit": "sec", "queries": second, "first_run": first, "fixtures": fixtures, "more": more,
        "sf": os.path.basename(sf_dir).removeprefix("sf"), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
