"""Problem-list activity during each hospital stay.

D13 edits made during a stay, D14 problems present during a stay, D15 active
counts, D16 update activity, D17 activity ratios, D18 merge into the discharge
table, D25 edits made outside any stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dxlens.functions.keys import composite_key, tuple_or_null
from dxlens.functions.ratios import int_div, safe_div
from dxlens.functions.temporal import day, days_between, midnight
from dxlens.operators.dyadic import KeyLoads, ancestors, cover, day_number, interval_join
from dxlens.operators.intervals import DEFAULT_TASK_PAIRS


def _still_open_at(admit) -> F.Column:
    """Resolved or deleted on/after the admission day, or neither (three-valued)."""
    a = day(admit)
    return ((day(F.col("b.resoldate")) >= a) | (day(F.col("b.deldate")) >= a)
            | (F.col("b.resoldate").isNull() & F.col("b.deldate").isNull()))


def _named(edits: DataFrame, names: DataFrame) -> DataFrame:
    """Edits with the names of their concepts (ties fan out): met before the stays, not once for every pair."""
    return edits.join(names.withColumnRenamed("conceptid", "snomed"), "snomed")


UPDATED_COLUMNS = [
    "ptid", "dischid", "pdxid", "probid", "conceptid", "term", "admitdate", "dischdate", "noteddate",
    "entrydate", "resoldate", "deldate", "hospprob", "prov_id", "provtype", "provdept", "datediff",
    "dayofentry", "dateposition", "dcprobid", "del", "resol", "noted",
]


def updated_during(log: DataFrame, disch: DataFrame, names: DataFrame,
                   task_pairs: int = DEFAULT_TASK_PAIRS, loads: KeyLoads | None = None) -> DataFrame:
    """Edits entered during a stay of the same patient (``updated_during``).

    Day level: entered between admission and discharge day, noted by the
    discharge day, not closed before the admission day; only edits with a
    provider.  ``dayofentry`` = days since admission midnight, ``dateposition``
    = that / max(los, 1); ``del``/``resol``/``noted`` flag an entry on the day
    of deletion / resolution / noting.  Day measures are exact fractions of a
    day (not cut to whole microseconds of the divided interval).  One edit can
    fall into several stays.
    """
    p = log.where(F.col("prov_id").isNotNull() & F.col("snomed").isNotNull()
                  & F.col("noteddate").isNotNull() & F.col("entrydate").isNotNull()
                  & F.col("ptid").isNotNull())
    p = _named(p, names.select("conceptid", "term"))
    d = disch.where(F.col("ptid").isNotNull() & F.col("dischdate").isNotNull()
                    & F.col("admitdate").isNotNull())
    dd, ad, ed = day(F.col("s.dischdate")), day(F.col("s.admitdate")), day(F.col("b.entrydate"))
    residual = ((day(F.col("b.noteddate")) <= dd) & _still_open_at(F.col("s.admitdate"))
                & (ed <= dd) & (ed >= ad))
    pairs = interval_join(p, d, ["ptid"], lambda n: ancestors(day_number(F.col("entrydate")), n),
                          lambda n: cover(day_number(F.col("admitdate")), day_number(F.col("dischdate")), n),
                          residual, row_id=["probid"], small_row_id=["dischid"], task_pairs=task_pairs, loads=loads)
    since_admit = days_between(midnight(F.col("s.admitdate")), F.col("b.entrydate"))
    rows = pairs.select(
        F.col("s.ptid").alias("ptid"), F.col("s.dischid").alias("dischid"), F.col("b.pdxid").alias("pdxid"),
        F.col("b.probid").alias("probid"), F.col("b.snomed").alias("conceptid"), F.col("b.term").alias("term"),
        F.col("s.admitdate").alias("admitdate"), F.col("s.dischdate").alias("dischdate"),
        *[F.col(f"b.{c}").alias(c) for c in ("noteddate", "entrydate", "resoldate", "deldate", "hospprob",
                                             "prov_id", "provtype", "provdept")],
        days_between(F.col("b.entrydate"), midnight(F.col("s.dischdate"))).alias("datediff"),
        since_admit.alias("dayofentry"),
        (since_admit / F.greatest(F.col("s.los"), F.lit(1))).alias("dateposition"),
        *[F.when(ed == day(F.col(f"b.{src}")), 1).otherwise(0).alias(out)
          for out, src in (("del", "deldate"), ("resol", "resoldate"), ("noted", "noteddate"))],
    ).withColumn("dcprobid", composite_key("ptid", "dischid", "pdxid", "conceptid", "noteddate"))
    return rows.select(*UPDATED_COLUMNS)


# which of the two starts lies in the other interval, above the node numbers
_EDIT_STARTS, _STAY_STARTS = 1 << 20, 1 << 21

PRESENT_COLUMNS = [
    "ptid", "admitdate", "dischdate", "dischid", "pdxid", "conceptid", "term", "noteddate", "resoldate",
    "deldate", "dcprobid", "dcdxid", "dcbilldxid", "picd9desc",
]
# what the counts (D15) and the billing match (D20, D21) read of them
COUNTED_COLUMNS = ["ptid", "dischid", "pdxid", "conceptid", "noteddate", "picd9desc"]


def present_during(log: DataFrame, disch: DataFrame, names: DataFrame,
                   task_pairs: int = DEFAULT_TASK_PAIRS, loads: KeyLoads | None = None) -> DataFrame:
    """Distinct problems present during a stay (``present_during``).

    Noted by the discharge day and not closed before the admission day.  Both
    sides are reduced to the distinct columns the result depends on before the
    join, so the result is distinct without a shuffle of the joined rows.
    Ids: ``dcprobid`` (patient, stay, diagnosis, concept, noted), ``dcdxid``
    (patient, stay, diagnosis, noted), ``dcbilldxid`` (patient, stay, diagnosis).
    """
    p = (log.where(F.col("snomed").isNotNull() & F.col("noteddate").isNotNull() & F.col("ptid").isNotNull())
         .select("ptid", "pdxid", "snomed", "noteddate", "resoldate", "deldate", "picd9desc").distinct())
    p = _named(p, names.select("conceptid", "term").distinct())
    d = (disch.where(F.col("ptid").isNotNull() & F.col("dischdate").isNotNull())
         .select("ptid", "dischid", "admitdate", "dischdate").distinct())
    residual = (day(F.col("b.noteddate")) <= day(F.col("s.dischdate"))) & _still_open_at(F.col("s.admitdate"))
    row_id = ["ptid", "pdxid", "snomed", "noteddate", "resoldate", "deldate", "picd9desc"]
    # two intervals overlap if the edit's starts within the stay, or else the stay's within the edit; a
    # stay without an admission day starts, for edits without an end, after its discharge day
    noted, admit, left = (day_number(F.col(c)) for c in ("noteddate", "admitdate", "dischdate"))
    closed = F.greatest(day_number(F.col("resoldate")), day_number(F.col("deldate")))

    def edit_nodes(n):
        return F.when(n == 0, F.array(F.lit(0))).otherwise(
            F.concat(ancestors(noted, n, _EDIT_STARTS), cover(noted + 1, closed, n, _STAY_STARTS)))

    def stay_nodes(n):
        return F.when(n == 0, F.array(F.lit(0))).otherwise(
            F.concat(cover(admit, left, n, _EDIT_STARTS), ancestors(F.coalesce(admit, left + 1), n, _STAY_STARTS)))

    starts_within = day(F.col("b.noteddate")) >= day(F.col("s.admitdate"))
    once = (F.when(F.col("b._node") >= _STAY_STARTS, ~F.coalesce(starts_within, F.lit(False)))
            .when(F.col("b._node") >= _EDIT_STARTS, starts_within).otherwise(True))
    pairs = interval_join(p, d, ["ptid"], edit_nodes, stay_nodes, residual & once, row_id=row_id,
                          small_row_id=["dischid", "admitdate", "dischdate"], task_pairs=task_pairs, loads=loads)
    rows = pairs.select(
        F.col("b.ptid").alias("ptid"), F.col("s.admitdate").alias("admitdate"),
        F.col("s.dischdate").alias("dischdate"), F.col("s.dischid").alias("dischid"),
        F.col("b.pdxid").alias("pdxid"), F.col("b.snomed").alias("conceptid"), F.col("b.term").alias("term"),
        *[F.col(f"b.{c}").alias(c) for c in ("noteddate", "resoldate", "deldate", "picd9desc")])
    rows = (rows.withColumn("dcprobid", composite_key("ptid", "dischid", "pdxid", "conceptid", "noteddate"))
            .withColumn("dcdxid", composite_key("ptid", "dischid", "pdxid", "noteddate"))
            .withColumn("dcbilldxid", composite_key("ptid", "dischid", "pdxid")))
    return rows.select(*PRESENT_COLUMNS)


def _active(present: DataFrame, by: list[str]) -> DataFrame:
    """Distinct diagnoses and problems per ``by``: problems are grouped, then counted
    per diagnosis, then summed, so no row is expanded per count.  A tuple with a missing part counts as none."""
    dx = ["dischid", "ptid", "pdxid", "noteddate"]
    whole = F.col(dx[0]).isNotNull()
    for c in dx[1:]:
        whole = whole & F.col(c).isNotNull()
    problems = present.select(*dx, "conceptid").distinct()
    per_dx = problems.groupBy(*dx).agg(F.count("conceptid").alias("problems"))
    none = F.lit(0).cast("long")
    return per_dx.groupBy(*by).agg(F.count(F.when(whole, True)).alias("dx_active"),
                                   F.coalesce(F.sum(F.when(whole, F.col("problems"))), none).alias("pr_active"))


def active_counts(present: DataFrame) -> DataFrame:
    """Distinct active diagnoses and problems per stay (``pr_present``)."""
    return _active(present, ["dischid"]).select(
        "dischid", F.col("dx_active").cast("double").alias("dx_active"), F.col("pr_active").cast("double").alias("pr_active"))


def active_totals(present: DataFrame) -> DataFrame:
    """The same counts over all stays."""
    return _active(present, [])


def _activity_aggs():
    return [
        F.countDistinct(tuple_or_null("ptid", "dischid", "pdxid", "conceptid", "noteddate")).cast("int").alias("pr_updated"),
        F.count(F.lit(1)).cast("int").alias("tot_updates"),
        F.sum("del").cast("int").alias("del_updates"), F.sum("resol").cast("int").alias("resol_updates"),
        F.sum("noted").cast("int").alias("noted_updates"),
        (F.avg("resol") * 100).alias("perc_resol_upd"), (F.avg("del") * 100).alias("perc_del_upd"),
        (F.avg("noted") * 100).alias("perc_noted_upd"),
        F.avg("dayofentry").alias("avgdayofentry"), F.avg("dateposition").alias("avgdateposition"),
    ]


def update_activity(updated: DataFrame, ordered: bool = False) -> DataFrame:
    """Updated problems, updates and their kinds per stay (``pr_updated``).

    ``ordered`` lists the busiest stays first, as the original report did.
    """
    out = updated.groupBy("dischid").agg(*_activity_aggs())
    return out.orderBy(F.col("tot_updates").desc_nulls_first(), "dischid") if ordered else out


def update_totals(updated: DataFrame) -> DataFrame:
    """The same over all stays."""
    return updated.agg(*_activity_aggs())


RATIO_COLUMNS = [
    "dx_active", "pr_active", "pr_updated", "pr_notupdated", "perc_updated", "tot_updates",
    "upd_perupdprob", "upd_peractprob", "del_updates", "resol_updates", "noted_updates", "perc_resol_upd",
    "perc_del_upd", "perc_noted_upd", "perc_resol_upd1", "perc_del_upd1", "perc_noted_upd1",
    "avgdayofentry", "avgdateposition",
]


def activity_ratios(counts: DataFrame, activity: DataFrame, integer_ratio: bool = False) -> DataFrame:
    """Active vs updated problems per stay with a present problem (``pusumm``).

    Missing activity counts become 0; the raw percentages and averages stay
    NULL, their ``…1`` variants are 0-filled.  ``upd_perupdprob`` divides two
    integers (truncated when ``integer_ratio``).  A zero denominator gives 0.
    """
    p1, p2 = counts.alias("p1"), activity.alias("p2")
    j = p1.join(p2, F.col("p1.dischid") == F.col("p2.dischid"), "left")
    act, upd, tot = F.col("p1.pr_active"), F.col("p2.pr_updated"), F.col("p2.tot_updates")
    per_upd = int_div(tot, upd).cast("double") if integer_ratio else safe_div(tot, upd)

    def zero(c):
        return F.coalesce(c, F.lit(0))

    return j.select(
        F.col("p1.dischid").alias("dischid"),
        F.col("p1.dx_active").cast("int").alias("dx_active"), act.cast("int").alias("pr_active"),
        zero(upd).alias("pr_updated"), F.coalesce(act - upd, act).cast("int").alias("pr_notupdated"),
        zero(safe_div(upd, act) * 100).cast("double").alias("perc_updated"),
        zero(tot).alias("tot_updates"), zero(per_upd).cast("double").alias("upd_perupdprob"),
        zero(safe_div(tot, act)).cast("double").alias("upd_peractprob"),
        zero(F.col("p2.del_updates")).alias("del_updates"), zero(F.col("p2.resol_updates")).alias("resol_updates"),
        zero(F.col("p2.noted_updates")).alias("noted_updates"),
        F.col("p2.perc_resol_upd").alias("perc_resol_upd"), F.col("p2.perc_del_upd").alias("perc_del_upd"),
        F.col("p2.perc_noted_upd").alias("perc_noted_upd"),
        zero(F.col("p2.perc_resol_upd")).cast("double").alias("perc_resol_upd1"),
        zero(F.col("p2.perc_del_upd")).cast("double").alias("perc_del_upd1"),
        zero(F.col("p2.perc_noted_upd")).cast("double").alias("perc_noted_upd1"),
        F.col("p2.avgdayofentry").alias("avgdayofentry"), F.col("p2.avgdateposition").alias("avgdateposition"))


def discharge_activity(disch2: DataFrame, ratios: DataFrame) -> DataFrame:
    """Each discharge with its activity ratios (``disch3``)."""
    r = ratios.select("dischid", *RATIO_COLUMNS)
    return disch2.join(r, "dischid", "left").select(*disch2.columns, *RATIO_COLUMNS)


OUTSIDE_COLUMNS = ["ptid", "noteddate", "pdxid", "entrydate", "probid", "snomed", "resoldate", "deldate",
                   "picd9desc", "provtype", "provdept"]


def edits_outside(log: DataFrame, updated: DataFrame) -> DataFrame:
    """Distinct edits whose probid falls in no stay."""
    inside = updated.select("probid").distinct()
    return log.join(inside, "probid", "left_anti").select(*OUTSIDE_COLUMNS).distinct()


def row_totals(log: DataFrame, updated: DataFrame) -> DataFrame:
    """Rows in the edit log and in ``updated_during``."""
    a = log.agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit("pldata"))
    b = updated.agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit("updated_during"))
    return a.unionByName(b).select("table", "rows")
