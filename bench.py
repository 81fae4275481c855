"""Run the headline queries and print one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import time

from haggle.plans import QUERIES
from haggle.plans.cleaning import staged_threads
from haggle.plans.learning import cases_of
from haggle.session import get_session

HEADLINE = [
    "normalize_turns", "linked_listings", "thread_flags", "waterfall", "moments", "denominator_audit", "build_cases", "split_manifests",
    "offer_histogram", "classification_metrics", "calibration_report", "global_rank", "replay_lifecycle", "financial_components",
    "comparables_as_of", "policy_audit", "pilot_audit", "money_summary", "global_drawdown", "ope", "compare_arms", "assign", "consent_as_of",
    "pii_findings", "dialogue_acts_documents",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    # the first job pays for starting the engine
    QUERIES["price_histogram"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    # inputs that the queries read and a user would have: the text source and the case table
    staging = {}
    for name, stage in (("threads_csv", staged_threads), ("cases", cases_of)):
        start = time.perf_counter()
        stage(spark, sf_dir)
        staging[name] = round(time.perf_counter() - start, 3)
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    turns = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    io = took["normalize_turns"] + took["linked_listings"]
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()) + sum(staging.values()), 3), "unit": "sec", "queries": took, "staging": staging,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "normalise_and_membership_turns_per_sec": round(turns / io)}))
    spark.stop()


if __name__ == "__main__":
    main()
