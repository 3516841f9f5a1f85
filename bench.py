"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Landing the event table is timed once as ``land_events``; detectors then read it as they would after ingest. Nothing
else prepared by an earlier query is reused.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from skyledger.plans import registry, workspace  # noqa: E402
from skyledger.session import build_session  # noqa: E402

HEADLINE = [
    "N1_normalise_audit_records", "N12_dedup", "E1_geo_lookup", "E2_longest_prefix_sensitivity", "F8_rule_matches", "B1_profile_members",
    "B4_new_geo", "B6_impossible_travel", "B7_enumeration_bursts", "B10_s3_exfiltration", "B11_sensitive_public_access", "C8_cases", "G5_applicable_statements",
    "G9_decisions", "P7_escalation_edges", "X7_ranked_cases", "T1_sanitised_documents", "M6_ranking_agreement",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "20g"),
        "spark.checkpoint.dir": f"file://{tempfile.mkdtemp(prefix='bench-')}"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder.rstrip('/')}/events.parquet").groupBy("user_id").count().write.format("noop").mode("overwrite").save()  # warm the JVM
    took: dict[str, float] = {}
    start = time.perf_counter()
    workspace.workspace(spark, folder).events
    took["land_events"] = round(time.perf_counter() - start, 3)
    for name in chosen:
        workspace.forget(keep=("events",))
        start = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    events = spark.read.parquet(f"{folder.rstrip('/')}/events.parquet").count()
    rates = {n: round(events / took[n]) for n in chosen if n[0] in "NEFBCHX" and took[n] > 0}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")),
                      "cpus": int(cpus), "events": events, "events_per_second": rates}))


if __name__ == "__main__":
    main()
