"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the directory of parquet tables and ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from workload import QUERIES  # noqa: E402

HEADLINE = (
    "check_not_null", "check_unique", "check_unique_composite", "check_unique_text", "check_accepted_values", "check_range",
    "check_regex", "check_freshness", "check_row_count", "check_referential", "check_custom_sql", "run_all_rules",
    "run_error_isolation", "thirty_rules_run", "sample_predicate", "sample_unique", "sample_referential",
    "latest_results", "daily_table_score", "table_health", "overview_kpis", "open_issues", "run_history_kpis",
    "rule_listing", "schema_overview", "profile_orders", "profile_events", "profile_documents", "suggest_rules",
    "alert_messages", "alert_retention", "metric_latest", "metric_kpis", "executions_per_day",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("plumbline-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").count().collect()  # start the JVM's engines

    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
