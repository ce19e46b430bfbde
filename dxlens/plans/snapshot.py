"""The problem list as it stood at each discharge, its flags and summaries.

D2 back-fill, D2a audit, D3/D4 exploration, D5 snapshot, D6 latest update,
D6a duplicates, D8 subsumption, D8a review lists, D11 summaries, D12 discharge
enrichment with readmission.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dxlens.functions.keys import all_present, composite_key
from dxlens.functions.ratios import percent
from dxlens.functions.temporal import day, days_between, micros_between, midnight, ts_literal
from dxlens.operators.grouping import (
    argmin_then_max, fill_from_group_min, flag_members, flag_repeats, flag_repeats_and_members, packed_argmin)
from dxlens.operators.dyadic import KeyLoads, ancestors, cover, day_number, interval_join
from dxlens.operators.intervals import DEFAULT_TASK_PAIRS

# Fixed values of the longitudinal problem key.
NOTED_SENTINEL = "1900-01-01 00:00:00"
SNOMED_SENTINEL = 1010
# A problem at a discharge: patient, discharge, diagnosis, concept, noted date.
PROBLEM_KEY = ["ptid", "dischid", "pdxid", "conceptid", "noteddate"]

SNAPSHOT_COLUMNS = [
    "ptid", "dischid", "pdxid", "probid", "conceptid", "term", "picd9", "phcc", "csn", "mrn", "admitdate",
    "dischdate", "noteddate", "entrydate", "resoldate", "deldate", "hospprob", "probdesc", "overview",
    "overlen", "priority", "prov_id", "provtype", "provdept", "datediff", "dcprobid",
]
# Snapshot columns that the summaries, flags and review lists read.
MEASURED_COLUMNS = ["dischid", "pdxid", "probid", "conceptid", "resoldate", "deldate", "hospprob", "probdesc", "overview",
                    "overlen", "priority", "datediff"]
# Snapshot columns taken from the discharge; the others come from the edit.
_FROM_DISCHARGE = {"ptid", "dischid", "csn", "mrn", "admitdate", "dischdate"}


# --------------------------------------------------------------------------- D2

def with_longitudinal_key(log: DataFrame) -> DataFrame:
    """``dxlongit``: text key of patient, diagnosis, noted date and concept."""
    return log.withColumn("dxlongit", composite_key(
        "ptid", "pdxid", F.coalesce(F.col("noteddate"), ts_literal(NOTED_SENTINEL)),
        F.coalesce(F.col("snomed"), F.lit(SNOMED_SENTINEL))))


def backfill_noted(log: DataFrame) -> DataFrame:
    """Fill a missing ``noteddate`` with the oldest entry date of the same problem.

    Same problem = same patient, diagnosis and concept (a missing concept counts
    as the sentinel 1010) among rows without a noted date; a row noted exactly
    at the 1900-01-01 sentinel belongs to that group as well.  Rows with a NULL
    patient or diagnosis are left alone.  The fill applies when a row without a
    noted date holds the group's earliest entry date.
    """
    keyed = with_longitudinal_key(log)
    noted = F.col("noteddate")
    fixable = noted.isNull() | (noted == ts_literal(NOTED_SENTINEL))
    keys = ["ptid", "pdxid", F.coalesce(noted, ts_literal(NOTED_SENTINEL)),
            F.coalesce(F.col("snomed"), F.lit(SNOMED_SENTINEL))]
    return fill_from_group_min(keyed, keys, "noteddate", "entrydate", fixable)


def missing_audit(log: DataFrame) -> DataFrame:
    """Edits still without a noted date or concept."""
    return log.where(F.col("noteddate").isNull() | F.col("snomed").isNull())


# ------------------------------------------------------------------- D3 / D4

def problems_per_patient(log: DataFrame, ordered: bool = False) -> DataFrame:
    """D3: number of edits (non-NULL probid) per patient; ``ordered``: most first."""
    out = log.groupBy("ptid").agg(F.count("probid").alias("problems"))
    return out.orderBy(F.col("problems").desc_nulls_first(), "ptid") if ordered else out


def busiest_patient(log: DataFrame) -> DataFrame:
    """One-row frame with the patient having the most edits (lowest id on ties)."""
    counts = problems_per_patient(log).where(F.col("ptid").isNotNull())
    return counts.agg(F.min_by("ptid", F.struct(-F.col("problems"), F.col("ptid"))).alias("ptid"))


def patient_rows(df: DataFrame, patient: DataFrame | int) -> DataFrame:
    """Rows of one patient: ``patient`` is an id or a one-row ``ptid`` frame."""
    if isinstance(patient, DataFrame):
        return df.join(patient.select("ptid"), "ptid", "left_semi")
    return df.where(F.col("ptid") == F.lit(int(patient)))


def patient_timeline(log: DataFrame, names: DataFrame, patient: DataFrame | int) -> DataFrame:
    """One patient's edits with concept names."""
    p = patient_rows(log, patient)
    n = names.select("conceptid", "term")
    return (p.join(n, p.snomed == n.conceptid)
            .select("ptid", "probid", "pdxid", "dischid", "snomed", "term", "admitdate", "noteddate",
                    "entrydate", "resoldate", "deldate"))


def patient_mrns(log: DataFrame, patient: DataFrame | int) -> DataFrame:
    """Distinct record numbers of one patient."""
    return patient_rows(log, patient).select("mrn").distinct()


def patient_snapshot(log: DataFrame, disch: DataFrame, names: DataFrame, patient: DataFrame | int,
                     loads: KeyLoads | None = None) -> DataFrame:
    """D5 for one patient: both sides pinned to the patient before the join."""
    return snapshot(patient_rows(log, patient), patient_rows(disch, patient), names, loads=loads)


# ----------------------------------------------------------------------- D5

def snapshot_pairs(log: DataFrame, disch: DataFrame, concepts: DataFrame,
                   task_pairs: int = DEFAULT_TASK_PAIRS, loads: KeyLoads | None = None) -> DataFrame:
    """D5 without names: every edit active at each discharge of its patient.

    At day level: noted <= discharge, entered <= discharge, and resolved or
    deleted after the discharge day (or neither); only edits with a provider.
    ``concepts`` (``conceptid``) restricts to concepts with a name.
    ``datediff`` = discharge midnight - entry time in days (negative for an
    entry on the discharge day).
    """
    pairs = _active_pairs(log, disch, concepts, task_pairs, loads)
    return _snapshot_columns(pairs)


def snapshot_keys(log: DataFrame, disch: DataFrame, concepts: DataFrame,
                  task_pairs: int = DEFAULT_TASK_PAIRS, loads: KeyLoads | None = None) -> DataFrame:
    """The pairs of D5 as far as D6 chooses by them: problem key, ``probid`` and ``micros`` (datediff in microseconds)."""
    edits = log.select("probid", "ptid", "pdxid", "snomed", "prov_id", "noteddate", "entrydate", "resoldate", "deldate")
    pairs = _active_pairs(edits, disch.select("ptid", "dischid", "dischdate"), concepts, task_pairs, loads)
    return pairs.select("s.ptid", "s.dischid", "b.pdxid", F.col("b.snomed").alias("conceptid"), "b.noteddate", "b.probid",
                        micros_between(F.col("b.entrydate"), midnight(F.col("s.dischdate"))).alias("micros"))


def _listed(log: DataFrame) -> DataFrame:
    """Edits that can be on a list: all that the conditions of D5 read is there."""
    return log.where(F.col("prov_id").isNotNull() & F.col("snomed").isNotNull() & F.col("noteddate").isNotNull()
                     & F.col("entrydate").isNotNull() & F.col("ptid").isNotNull())


def _active() -> Column:
    """Edit ``b`` is active on the day of discharge ``s``."""
    dd = day(F.col("s.dischdate"))
    return ((day(F.col("b.noteddate")) <= dd) & (day(F.col("b.entrydate")) <= dd)
            & ((day(F.col("b.resoldate")) > dd) | (day(F.col("b.deldate")) > dd)
               | (F.col("b.resoldate").isNull() & F.col("b.deldate").isNull())))


def _active_pairs(log: DataFrame, disch: DataFrame, concepts: DataFrame, task_pairs: int,
                  loads: KeyLoads | None) -> DataFrame:
    p = _listed(log).join(concepts, F.col("snomed") == concepts.conceptid, "left_semi")
    d = disch.where(F.col("ptid").isNotNull() & F.col("dischdate").isNotNull())
    # an edit is active from the later of noting and entry to the day before the later of its ends
    low = F.greatest(day_number(F.col("noteddate")), day_number(F.col("entrydate")))
    high = F.greatest(day_number(F.col("resoldate")), day_number(F.col("deldate"))) - 1
    # numbered once a row, not once a pair; the test of two numbers is that of :func:`_active`
    p, d = p.withColumns({"_low": low, "_high": high}), d.withColumn("_at", day_number(F.col("dischdate")))
    active = (F.col("b._low") <= F.col("s._at")) & (F.col("b._high").isNull() | (F.col("b._high") >= F.col("s._at")))
    return interval_join(p, d, ["ptid"], lambda n: cover(F.col("_low"), F.col("_high"), n), lambda n: ancestors(F.col("_at"), n),
                         active, row_id=["probid"], small_row_id=["dischid"], task_pairs=task_pairs, loads=loads)


def _snapshot_columns(pairs: DataFrame) -> DataFrame:
    """The columns of D5, without the name, of pairs of an edit ``b`` and a discharge ``s``."""
    cols = [F.col("b.snomed" if c == "conceptid" else f"{'s' if c in _FROM_DISCHARGE else 'b'}.{c}").alias(c)
            for c in SNAPSHOT_COLUMNS if c not in ("term", "datediff", "dcprobid")]
    cols.append(days_between(F.col("b.entrydate"), midnight(F.col("s.dischdate"))).alias("datediff"))
    out = pairs.select(*cols)
    return out.withColumn("dcprobid", composite_key(*PROBLEM_KEY))


def attach_terms(df: DataFrame, names: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Inner join of concept names (ties fan out) and column order ``columns``."""
    n = names.select("conceptid", "term")
    out = df.join(n, "conceptid", "inner")
    return out.select(*(columns or [*df.columns, "term"]))


def snapshot(log: DataFrame, disch: DataFrame, names: DataFrame, task_pairs: int = DEFAULT_TASK_PAIRS,
             loads: KeyLoads | None = None) -> DataFrame:
    """Problem list at each discharge, with names."""
    concepts = names.select("conceptid").distinct()
    return attach_terms(snapshot_pairs(log, disch, concepts, task_pairs, loads), names, SNAPSHOT_COLUMNS)


# ----------------------------------------------------------------------- D6

def latest_update(pairs: DataFrame) -> DataFrame:
    """Per problem and discharge keep the edit entered last before discharge.

    Smallest ``datediff`` first, then the highest ``probid``; every row of that
    (problem, probid) is kept.  Problems with a NULL key part are dropped.
    """
    return argmin_then_max(pairs, PROBLEM_KEY, "datediff", "probid")


def latest_from_keys(keys: DataFrame, log: DataFrame, disch: DataFrame) -> DataFrame:
    """D6 from :func:`snapshot_keys`: the same rows as :func:`latest_update` of the pairs.

    The edits are chosen on narrow rows by a hash aggregate; the other columns are fetched for the
    chosen ones only, from the log and the discharges (repeated rows of either give repeated rows, as in the pairs).
    Choosing by whole microseconds tells apart what ``datediff`` does, and more beyond 285 years.
    """
    chosen = packed_argmin(keys, PROBLEM_KEY, "micros", "probid")
    w = chosen.select("ptid", "dischid", *[F.col(c).alias(f"_{c}") for c in ("pdxid", "conceptid", "noteddate", "probid")])
    s = w.join(disch.where(F.col("dischdate").isNotNull()), ["ptid", "dischid"]).alias("s")
    b = _listed(log).alias("b")
    same = ((F.col("b.ptid") == F.col("s.ptid")) & (F.col("b.pdxid") == F.col("s._pdxid"))
            & (F.col("b.snomed") == F.col("s._conceptid")) & (F.col("b.noteddate") == F.col("s._noteddate"))
            & (F.col("b.probid") == F.col("s._probid")))
    return _snapshot_columns(b.join(s, same & _active()))


def latest_in_place(log: DataFrame, disch: DataFrame, concepts: DataFrame, task_pairs: int = DEFAULT_TASK_PAIRS,
                    loads: KeyLoads | None = None) -> DataFrame:
    """D6 from the pairs where they stand: the same rows as :func:`latest_update` of the pairs.

    For pairs dealt by patient (``loads.partitions``): a window over the problem sorts each task's own pairs, so they
    are neither shuffled nor joined back to the log and the discharges.  A task spills what it cannot sort in memory.
    """
    pairs = _active_pairs(log, disch, concepts, task_pairs, loads)
    problem = [F.col(c) for c in ("s.ptid", "s.dischid", "b.pdxid", "b.snomed", "b.noteddate")]
    last_first = [micros_between(F.col("b.entrydate"), midnight(F.col("s.dischdate"))).asc(), F.col("b.probid").desc()]
    chosen = F.first("b.probid").over(Window.partitionBy(*problem).orderBy(*last_first))
    named = pairs.where(all_present(*problem, F.col("b.probid")))
    return _snapshot_columns(named.withColumn("_chosen", chosen).where(F.col("b.probid") == F.col("_chosen")))


# ---------------------------------------------------------------------- D6a

def duplicate_groups(problems: DataFrame) -> DataFrame:
    """(dischid, conceptid) occurring more than once."""
    return (problems.groupBy("dischid", "conceptid").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1).select("dischid", "conceptid"))


def with_duplicate_flag(problems: DataFrame) -> DataFrame:
    """``duplic`` = 1 when the concept occurs twice on the discharge."""
    return flag_repeats(problems, ["dischid", "conceptid"], "duplic")


# ----------------------------------------------------------------------- D8

def subsumption_pairs(problems: DataFrame, closure_df: DataFrame) -> DataFrame:
    """A problem and a more specific problem on the same discharge.

    One row per (problem row, closure edge, specific problem row) with a
    different diagnosis id.  The specific problems are expanded to their
    ancestors first (few per concept), then matched on (discharge, ancestor):
    no pairs within a discharge are ever formed.
    """
    spec = problems.select("dischid", F.col("conceptid").alias("subsumed_by"), F.col("pdxid").alias("pdxid2"))
    c = closure_df.select(F.col("destinationid").alias("conceptid"), F.col("sourceid").alias("subsumed_by"),
                          "depth")
    up = spec.join(c, "subsumed_by")
    gen = problems.select("dischid", "conceptid", F.col("pdxid").alias("pdxid1"))
    pairs = gen.join(up, ["dischid", "conceptid"]).where(F.col("pdxid1") != F.col("pdxid2"))
    return pairs.select("dischid", "conceptid", "subsumed_by", "depth", "pdxid1", "pdxid2")


def with_subsumed_flag(problems: DataFrame, pairs: DataFrame) -> DataFrame:
    """``subsumed`` = 1 on every row of a concept subsumed on its discharge."""
    return flag_members(problems, pairs, ["dischid", "conceptid"], "subsumed")


def with_list_flags(problems: DataFrame, pairs: DataFrame) -> DataFrame:
    """D6a and D8 at once: ``duplic`` and ``subsumed``, which share their key."""
    return flag_repeats_and_members(problems, pairs, ["dischid", "conceptid"], "duplic", "subsumed")


# ---------------------------------------------------------------------- D8a

def subsumed_review(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Subsumption pairs with both names."""
    n1 = names.select("conceptid", F.col("term").alias("term"))
    n2 = names.select(F.col("conceptid").alias("subsumed_by"), F.col("term").alias("subsumed_term"))
    return pairs.join(n1, "conceptid").join(n2, "subsumed_by").select(
        "dischid", "conceptid", "subsumed_by", "depth", "pdxid1", "pdxid2", "term", "subsumed_term")


# Review lists: (columns shown, leading sort keys, descending).
REVIEW_LISTS = {
    "flags": (["dischid", "conceptid", "duplic", "subsumed"], ["dischid", "conceptid"]),
    "specificity": (["dischid", "probid", "conceptid", "duplic", "subsumed", "descendants", "descendantslog"],
                    ["dischid", "probid"]),
    "all": (["dischid", "probid", "conceptid", "duplic", "subsumed", "descendants", "descendantslog",
             "finding", "snomedtype"], ["dischid", "probid"]),
}


def review_top(problems: DataFrame, names: DataFrame, k: int = 1000, kind: str = "all") -> DataFrame:
    """The first ``k`` problems with their flags and name.

    ``kind`` picks the columns and the leading descending sort keys (see
    :data:`REVIEW_LISTS`).  The limit is the feature (a review list); the
    remaining columns break ties so the list is deterministic.
    """
    cols, keys = REVIEW_LISTS[kind]
    rows = problems.select(*cols).join(names.select("conceptid", "term"), "conceptid").select(*cols, "term")
    rest = [c for c in cols + ["term"] if c not in keys]
    order = [F.col(c).desc_nulls_first() for c in keys] + [F.col(c).asc_nulls_last() for c in rest]
    return rows.orderBy(*order).limit(k)


# ---------------------------------------------------------------------- D11

def _summary_aggs(integer_ratio: bool, per_discharge: bool) -> list:
    """All measures except ``probcount`` (computed apart, see :func:`_with_probcount`)."""
    n = F.count("conceptid")

    def pct_flag(c):
        return F.avg(c) * 100

    aggs = [
        n.cast("int").alias("snomedcount"),
        F.count("resoldate").cast("int").alias("countresol"),
        percent(F.count("resoldate"), n, integer_ratio).alias("percentresol"),
        F.count("deldate").cast("int").alias("countdel"),
        percent(F.count("deldate"), n, integer_ratio).alias("percentdel"),
        F.sum("duplic").cast("int").alias("countdup"), pct_flag("duplic").alias("percentdup"),
        F.sum("subsumed").cast("int").alias("countsubs"), pct_flag("subsumed").alias("percentsubs"),
        F.avg("descendants").alias("meandesc"), F.median("descendants").alias("mediandesc"),
    ]
    if per_discharge:
        aggs.append(F.avg("descendantslog").alias("meanlogdesc"))
    aggs += [
        F.sum("finding").cast("int").alias("countfinding"), pct_flag("finding").alias("percentfinding"),
        F.sum("hospprob").cast("int").alias("counthospprob"), pct_flag("hospprob").alias("percenthospprob"),
        F.sum("overview").cast("int").alias("countoverview"), pct_flag("overview").alias("percentoverview"),
        F.avg("overlen").alias("avgoverlen"),
    ]
    if per_discharge:
        aggs.append(F.avg(F.log10(F.col("overlen") + 1)).alias("avgoverlenlog"))
    aggs += [
        F.sum("probdesc").cast("int").alias("countprobdesc"), pct_flag("probdesc").alias("percentprobdesc"),
        F.count("priority").cast("int").alias("countpriority"),
        percent(F.count("priority"), n, integer_ratio).alias("percentpriority"),
        F.avg("datediff").alias("avdatediff"),
    ]
    return aggs


SUMMARY_COLUMNS = [
    "probcount", "snomedcount", "countresol", "percentresol", "countdel", "percentdel", "countdup",
    "percentdup", "countsubs", "percentsubs", "meandesc", "mediandesc", "meanlogdesc", "countfinding",
    "percentfinding", "counthospprob", "percenthospprob", "countoverview", "percentoverview", "avgoverlen",
    "avgoverlenlog", "countprobdesc", "percentprobdesc", "countpriority", "percentpriority", "avdatediff",
]


def _with_probcount(problems: DataFrame, measures: DataFrame, keys: list[str]) -> DataFrame:
    # The exact distinct count runs as its own two-phase aggregate (dedupe on
    # (keys, probid), then count per key); folded into the measures it would
    # carry every other aggregate, the median's buffer included, per
    # (keys, probid) group.
    distinct = (problems.select(*keys, "probid").where(F.col("probid").isNotNull()).distinct()
                .groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("probcount")))
    if not keys:
        joined = measures.withColumn("_one", F.lit(1)).join(distinct.withColumn("_one", F.lit(1)), "_one")
    else:
        # both sides are dealt by the key already, which a NULL-safe comparison would not make use of;
        # the group of the NULL key comes from its own single row
        key, = keys
        missing = (problems.where(F.col(key).isNull() & F.col("probid").isNotNull()).select("probid").distinct()
                   .agg(F.count(F.lit(1)).cast("int").alias("_missing")))
        met = measures.join(distinct, measures[key] == distinct[key], "left").crossJoin(F.broadcast(missing))
        count = F.when(measures[key].isNull(), F.col("_missing")).otherwise(F.col("probcount"))
        joined = met.select(*[measures[c] for c in measures.columns], count.alias("probcount"))
    cols = [c for c in SUMMARY_COLUMNS if c in measures.columns or c == "probcount"]
    return joined.select(*[measures[k] for k in keys],
                         *[F.coalesce(F.col("probcount"), F.lit(0)).alias("probcount") if c == "probcount"
                           else measures[c] for c in cols])


def discharge_summary(problems: DataFrame, integer_ratio: bool = False) -> DataFrame:
    """Problem-list quality measures per discharge (``plsumm``).

    ``integer_ratio=True`` truncates the three count ratios (resolved, deleted,
    prioritised) to whole multiples of 100 as integer division did originally.
    """
    measures = problems.groupBy("dischid").agg(*_summary_aggs(integer_ratio, True))
    return _with_probcount(problems, measures, ["dischid"])


def overall_summary(problems: DataFrame, integer_ratio: bool = False) -> DataFrame:
    """The same measures over all discharges (one row)."""
    return _with_probcount(problems, problems.agg(*_summary_aggs(integer_ratio, False)), [])


def no_priority_count(disch2: DataFrame) -> DataFrame:
    """Discharges whose problem list has no prioritised problem."""
    return disch2.where(F.col("countpriority") == 0).agg(F.count(F.lit(1)).alias("discharges"))


# ---------------------------------------------------------------------- D12

DISCH2_BASE = ["ptid", "dischid", "pt_age", "pt_gender", "adm_ed", "adm_sched", "department", "service",
               "admitdate", "dischdate", "los", "losicu", "transfers", "specialties", "pews_peak",
               "pews_mean"]
DISCH2_TAIL = ["opvisits", "ipvisits", "cc_time"]


def readmission_measures(study_end: str) -> list:
    """``readmitcensored`` (whole days discharge -> readmission or study end) and
    ``readmit30d`` (readmitted within 31 days of the discharge time)."""
    disch_day = midnight(F.col("dischdate"))
    censored = F.when(F.col("readmit").isNull(), days_between(disch_day, ts_literal(f"{study_end} 00:00:00"))) \
        .otherwise(days_between(disch_day, midnight(F.col("readmit"))))
    within = F.when(days_between(F.col("dischdate"), F.col("readmit")) < 31, 1).otherwise(0)
    return [censored.alias("readmitcensored"), within.alias("readmit30d")]


def discharge_enrichment(disch: DataFrame, summary: DataFrame, study_end: str) -> DataFrame:
    """Each discharge with readmission measures and its problem-list summary."""
    d = disch.select(*DISCH2_BASE, *readmission_measures(study_end), *DISCH2_TAIL)
    s = summary.select("dischid", *SUMMARY_COLUMNS)
    return d.join(s, "dischid", "left").select(*d.columns, *SUMMARY_COLUMNS)


