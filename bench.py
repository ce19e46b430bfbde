"""Benchmark: the whole problem-list pipeline on one test folder.

Runs every job over the bridge inputs of ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]``.  The published tables are
built by :meth:`ProblemListMetrics.run` (independent branches as concurrent
Spark jobs, ``$BENCH_PARALLEL`` at a time, tables materialised once); the
report-only jobs then run (also concurrently), each forced with a ``noop`` write.
Prints one JSON line: total wall time and per-job seconds.
"""

from __future__ import annotations

import json
import os
import sys
import threading
import time
from concurrent.futures import ThreadPoolExecutor

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dxlens import get_session  # noqa: E402
from dxlens.plans import billing, snapshot, stays  # noqa: E402
from dxlens.plans.pipeline import Inputs, ProblemListMetrics  # noqa: E402
from dxlens.sources.bridge import STUDY_END, load_bridge  # noqa: E402

JOB_IDS = {
    "names": "D1_current_names", "log": "D2_backfill_noted", "terms": "D1_names_in_use",
    "hot_patients": "D5_D13_D14_hot_patients", "snapshot_pairs": "D5_snapshot",
    "latest": "D6_latest_update", "candidate_closure": "D7_closure_candidates", "closure": "D7_closure", "subsumption": "D8_subsumption",
    "problems": "D6a_D8_D9_D10_flags", "summary": "D11_summary", "disch2": "D12_enrichment",
    "updated_during": "D13_updated_during", "present_during": "D14_present_during",
    "pr_present": "D15_active_counts", "pr_updated": "D16_update_activity", "pusumm": "D17_ratios",
    "disch3": "D18_merge", "match_concept": "D21_match_concept", "match_dx": "D20_match_dx",
    "stats_dx": "D22_match_stats_dx", "stats_concept": "D22_match_stats_concept",
    "disch4": "D23_final_discharge", "outside": "D25_edits_outside",
}

# Report jobs read the built tables.
REPORTS = [
    ("D5_snapshot_names", lambda m: m.snapshot),
    ("D6a_duplicate_groups", lambda m: snapshot.duplicate_groups(m.latest)),
    ("D8a_review_top", lambda m: snapshot.review_top(m.problems, m.terms)),
    ("D11a_overall", lambda m: snapshot.overall_summary(m.problems)),
    ("D11b_no_priority", lambda m: snapshot.no_priority_count(m.disch2)),
    ("D15_active_totals", lambda m: stays.active_totals(m.present_during)),
    ("D16_update_totals", lambda m: stays.update_totals(m.updated_during)),
    ("D19_billing_load", lambda m: m.billdata),
    ("D20a_coverage_dx", lambda m: billing.coverage_dx(m.match_dx)),
    ("D21_coverage_concept", lambda m: billing.coverage_concept(m.match_concept)),
    ("D24_reconciliation", lambda m: m.reconciliation()),
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    parallel = int(os.environ.get("BENCH_PARALLEL", "3"))
    partitions = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus))
    spark = get_session(f"local[{cpus}]", app_name="dxlens-bench", shuffle_partitions=partitions,
                        extra={"spark.scheduler.mode": "FAIR"})
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    start = time.time()
    m = ProblemListMetrics(Inputs.from_mapping(load_bridge(spark, sf_dir)), study_end=STUDY_END,
                           materialise=os.environ.get("BENCH_MATERIALISE", "table"))
    times: dict[str, float] = {}
    lock = threading.Lock()

    def record(name: str, seconds: float) -> None:
        with lock:
            times[JOB_IDS.get(name, name)] = round(seconds, 3)

    m.run(parallel=parallel, on_step=record)

    def report(item):
        name, job = item
        t0 = time.time()
        job(m).write.format("noop").mode("overwrite").save()
        record(name, time.time() - t0)

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        list(pool.map(report, REPORTS))
    total = round(time.time() - start, 3)
    print(json.dumps({"metric": "pipeline_total", "value": total, "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    m.release()
    spark.stop()


if __name__ == "__main__":
    main()
