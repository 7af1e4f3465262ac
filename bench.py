"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from leadloom.plans import queries

HEADLINE = [
    "company_queue", "pre_score", "rejection_funnel", "parent_company", "director_graph",
    "norm_name", "html_to_text", "trigram_similarity", "dup_exact_name", "dup_name_postcode",
    "dup_fuzzy", "dedup_check", "dedup_resolve", "contact_merge", "daily_digest", "emails",
    "socials", "json_ld", "people", "subpages", "site_merge", "page_assembly", "accounts_parse",
    "accounts_latest", "places_flatten", "reply_flow", "sent_reconcile", "lead_state",
    "kill_switch", "failure_breaker", "sweep_replay", "send_log_parse", "bounce_rate_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("leadloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.leadloom.input.splits", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    known = queries()
    seconds = {}
    for name in HEADLINE:
        if name not in known:
            continue
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, wall time", "value": round(sum(seconds.values()), 3),
                "unit": "sec", "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
