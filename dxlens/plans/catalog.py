"""Registered queries: one per job, each reading the bridge inputs of a test folder.

Every query builds its own pipeline over the whole test tables (no subsets):
``QUERIES[name](spark, sf_dir)`` returns the job's DataFrame.  Double columns
are rounded to 6 decimals for comparison with the SQL oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dxlens.plans import billing, snapshot, stays
from dxlens.plans.pipeline import Inputs, ProblemListMetrics, needed_tables
from dxlens.sources.bridge import STUDY_END, load_bridge

# depth limit of the original closure statement; the library itself has none
REFERENCE_DEPTH = 15

FLAG_KEYS = ["dischid", "conceptid", "probid", "pdxid"]


def metrics(spark: SparkSession, sf_dir: str, integer_ratio: bool = False,
            materialise: str = "table", outputs: list[str] | None = None, chains: bool = False) -> ProblemListMetrics:
    """The pipeline over the bridge inputs of ``sf_dir``.

    Intermediates that several jobs behind ``outputs`` read are written to the checkpoint folder as the
    query is built; the returned plan holds the other jobs.  ``chains`` adds is-a chains deeper
    than the original's limit, and follows them without one.
    """
    bills = outputs is None or not {"billdata", "match_concept"}.isdisjoint(needed_tables(outputs))
    return ProblemListMetrics(Inputs.from_mapping(load_bridge(spark, sf_dir, chains, bills)), study_end=STUDY_END,
                              integer_ratio=integer_ratio, materialise=materialise,
                              max_depth=None if chains else REFERENCE_DEPTH, outputs=outputs)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = [F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def _one_patient(m: ProblemListMetrics) -> DataFrame:
    return snapshot.patient_snapshot(m.log, m.inputs.disch, m.terms, snapshot.busiest_patient(m.log),
                                     loads=m.loads)


def _one_patient_latest(m: ProblemListMetrics) -> DataFrame:
    # D6 on the one-patient snapshot (names attached after the selection).
    patient = snapshot.busiest_patient(m.log)
    edits, stays_of = snapshot.patient_rows(m.log, patient), snapshot.patient_rows(m.inputs.disch, patient)
    keys = snapshot.snapshot_keys(edits, stays_of, m.concepts, loads=m.loads)
    return snapshot.attach_terms(snapshot.latest_from_keys(keys, edits, stays_of), m.terms, snapshot.SNAPSHOT_COLUMNS)


def _lookup_functions(m: ProblemListMetrics) -> DataFrame:
    # D9 as the original writes it: a function call per row of the published table
    prefix = "lookup_functions_"
    m.latest.createOrReplaceTempView(prefix + "pldata2")
    plain, log = m.register_functions(prefix)
    return m.spark.sql(f"SELECT {', '.join(FLAG_KEYS)}, {plain}(conceptid) AS descendants, "
                       f"{log}(conceptid) AS descendantslog FROM {prefix}pldata2")


# Per query: the tables it reads, once for every read, and what it does with them.
_JOBS: dict[str, tuple[str, Callable[[ProblemListMetrics], DataFrame]]] = {
    "current_names": ("names", lambda m: m.names),
    "backfill_noted": ("log", lambda m: m.log),
    "missing_audit": ("log", lambda m: snapshot.missing_audit(m.log)),
    "problems_per_patient": ("log", lambda m: snapshot.problems_per_patient(m.log)),
    "patient_timeline": ("log terms log log", lambda m: snapshot.patient_timeline(m.log, m.terms, snapshot.busiest_patient(m.log))),
    "patient_mrns": ("log log log", lambda m: snapshot.patient_mrns(m.log, snapshot.busiest_patient(m.log))),
    "snapshot_pairs": ("snapshot", lambda m: m.snapshot),
    "snapshot_one_patient": ("log log log terms terms loads", _one_patient),
    "latest_update": ("latest", lambda m: m.latest),
    "latest_update_one_patient": ("log log log concepts terms loads", _one_patient_latest),
    "duplicate_groups": ("latest", lambda m: snapshot.duplicate_groups(m.latest)),
    "duplicate_flag": ("problems", lambda m: m.problems.select(*FLAG_KEYS, "duplic")),
    "closure": ("closure", lambda m: m.closure),
    "closure_full": ("closure", lambda m: m.closure),
    "subsumed_pairs": ("subsumption", lambda m: m.subsumption),
    "subsumed_flag": ("problems", lambda m: m.problems.select(*FLAG_KEYS, "subsumed")),
    "subsumed_review": ("subsumption terms terms", lambda m: snapshot.subsumed_review(m.subsumption, m.terms)),
    "review_topk": ("problems terms", lambda m: snapshot.review_top(m.problems, m.terms, 1000)),
    "review_flags_topk": ("problems terms", lambda m: snapshot.review_top(m.problems, m.terms, 1000, "flags")),
    "review_specificity_topk": ("problems terms", lambda m: snapshot.review_top(m.problems, m.terms, 1000, "specificity")),
    "lookup_functions": ("latest closure closure", _lookup_functions),
    "specificity": ("problems", lambda m: m.problems.select(*FLAG_KEYS, "descendants", "descendantslog")),
    "semantic_tag": ("problems", lambda m: m.problems.select(*FLAG_KEYS, "finding", "snomedtype")),
    "discharge_summary": ("summary", lambda m: m.summary),
    "discharge_summary_int": ("problems", lambda m: snapshot.discharge_summary(m.problems, integer_ratio=True)),
    "overall_summary": ("problems problems", lambda m: snapshot.overall_summary(m.problems)),
    "no_priority_count": ("disch2", lambda m: snapshot.no_priority_count(m.disch2)),
    "readmission": ("disch2", lambda m: m.disch2),
    "updated_during": ("updated_during", lambda m: m.updated_during),
    "present_during": ("present_during", lambda m: m.present_during),
    "active_counts": ("pr_present", lambda m: m.pr_present),
    "active_totals": ("present_during present_during", lambda m: stays.active_totals(m.present_during)),
    "update_activity": ("pr_updated", lambda m: m.pr_updated),
    "update_totals": ("updated_during updated_during", lambda m: stays.update_totals(m.updated_during)),
    "activity_ratios": ("pusumm", lambda m: m.pusumm),
    "activity_ratios_int": ("pr_present pr_updated", lambda m: stays.activity_ratios(m.pr_present, m.pr_updated, integer_ratio=True)),
    "discharge_activity": ("disch3", lambda m: m.disch3),
    "billing_load": ("billdata", lambda m: m.billdata),
    "bill_match_dx": ("match_dx", lambda m: m.match_dx),
    "match_coverage_dx": ("match_dx", lambda m: billing.coverage_dx(m.match_dx)),
    "bill_match_concept": ("match_concept", lambda m: m.match_concept),
    "match_coverage_concept": ("match_concept", lambda m: billing.coverage_concept(m.match_concept)),
    "match_stats_dx": ("stats_dx", lambda m: m.stats_dx),
    "match_stats_concept": ("stats_concept", lambda m: m.stats_concept),
    "final_discharge": ("disch4", lambda m: m.disch4),
    "reconciliation": ("summary disch2 pr_updated pr_present pusumm disch3 disch4", lambda m: m.reconciliation()),
    "edits_outside": ("outside", lambda m: m.outside),
    "edit_totals": ("log updated_during", lambda m: stays.row_totals(m.log, m.updated_during)),
}


# the same jobs with the original's truncating integer ratios all along the chain
_INTEGER_JOBS = {
    "overall_summary_int": ("problems problems", lambda m: snapshot.overall_summary(m.problems, integer_ratio=True)),
    "readmission_int": ("disch2", lambda m: m.disch2),
    "discharge_activity_int": ("disch3", lambda m: m.disch3),
    "final_discharge_int": ("disch4", lambda m: m.disch4),
}


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    integer_ratio = name in _INTEGER_JOBS
    reads, job = _INTEGER_JOBS[name] if integer_ratio else _JOBS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(job(metrics(spark, sf_dir, integer_ratio=integer_ratio, outputs=reads.split(),
                                         chains=name == "closure_full")))

    run.__name__ = name
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: query(name) for name in [*_JOBS, *_INTEGER_JOBS]}
