"""Problem list against billing diagnoses.

D19 billing key, D20/D21 match tables, D20a coverage counts, D22 per-stay match
statistics, D23 final discharge table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dxlens.functions.keys import all_present, composite_key
from dxlens.operators.matching import full_match, match_stats

BILL_KEY = [("ptid", "ptid"), ("dischid", "dischid"), ("pdxid", "bepicdxid")]


def billing_keys(billdata: DataFrame) -> DataFrame:
    """Billing rows with ``dcxbillid`` (patient, stay, diagnosis id)."""
    return billdata.withColumn("dcxbillid", composite_key("ptid", "dischid", "bepicdxid"))


def _match(present: DataFrame, billdata: DataFrame, problem_cols: list[str], partitions: int | None) -> DataFrame:
    # Both sides are cut to the distinct columns the result uses, then fully
    # joined on the column tuple (NULL parts never match).  Duplicates are
    # removed once more before the text ids are made, which are functions of
    # the columns kept: on unmatched rows the other side's diagnosis is NULL.
    p = present.select("ptid", "dischid", "pdxid", *problem_cols, "picd9desc")
    b = billdata.select("ptid", "dischid", "bepicdxid", "bicd9desc")
    if partitions:  # explicit, so that pairs that pack well are not merged into few partitions
        p, b = p.repartition(partitions, *[c for c, _ in BILL_KEY]), b.repartition(partitions, *[c for _, c in BILL_KEY])
    j = full_match(p.distinct(), b.distinct(), BILL_KEY, "p", "b").select(
        F.coalesce(F.col("p.ptid"), F.col("b.ptid")).alias("ptid"),
        F.coalesce(F.col("p.dischid"), F.col("b.dischid")).alias("dischid"),
        F.col("p.pdxid").alias("pdxid"), *[F.col(f"p.{c}").alias(c) for c in problem_cols],
        F.col("b.bepicdxid").alias("bepicdxid"),
        F.coalesce(F.col("b.bicd9desc"), F.col("p.picd9desc")).alias("icd9desc"))
    if partitions:  # dealt by what the statistics group by
        j = j.repartition(partitions, "ptid", "dischid")
    j = j.distinct()
    return (j.withColumn("dcbilldxid", composite_key("ptid", "dischid", "pdxid"))
            .withColumn("dcxbillid", composite_key("ptid", "dischid", "bepicdxid")))


MATCH_DX_COLUMNS = ["ptid", "dischid", "pdxid", "bepicdxid", "icd9desc", "dcbilldxid", "dcxbillid"]
MATCH_CONCEPT_COLUMNS = ["ptid", "dischid", "pdxid", "conceptid", "bepicdxid", "icd9desc", "dcbilldxid",
                         "dcxbillid", "dcprobid"]


def match_dx(present: DataFrame, billdata: DataFrame) -> DataFrame:
    """Problem-list diagnosis ids against billing diagnosis ids (``pbmatchdx``)."""
    return _match(present, billdata, [], None).select(*MATCH_DX_COLUMNS)


def match_dx_from_concept(match_pr: DataFrame) -> DataFrame:
    """D20 from an existing D21 table: its distinct projection on the D20 columns.

    Every D20 row is the projection of some D21 row (each diagnosis of a
    present problem carries at least one concept), and D20's columns are a
    subset of D21's, so no second full join is needed.
    """
    parts = match_pr.select("ptid", "dischid", "pdxid", "bepicdxid", "icd9desc").distinct()
    return (parts.withColumn("dcbilldxid", composite_key("ptid", "dischid", "pdxid"))
            .withColumn("dcxbillid", composite_key("ptid", "dischid", "bepicdxid")).select(*MATCH_DX_COLUMNS))


def match_concept(present: DataFrame, billdata: DataFrame, partitions: int | None = None) -> DataFrame:
    """The same at concept level, with ``conceptid`` and ``dcprobid`` (``pbmatchpr``).

    The noted date counts as far as it shows in ``dcprobid``.  ``partitions``: both sides are dealt by the key into
    so many, and the result by patient and stay.
    """
    named = ["ptid", "dischid", "pdxid", "conceptid"]
    shown = present.withColumn("noteddate", F.when(all_present(*named), F.col("noteddate")))
    m = _match(shown, billdata, ["conceptid", "noteddate"], partitions)
    return m.withColumn("dcprobid", composite_key(*named, "noteddate")).select(*MATCH_CONCEPT_COLUMNS)


# Distinct counts use column tuples: an undelimited text id can stand for two
# different tuples, the parts cannot.  Each kind of tuple is grouped once, its flags
# kept as maxima; sums over the groups are the distinct counts.  A text id is NULL
# exactly where its side or one of its parts is missing.
def _coverage(groups: list[DataFrame], names: list[str]) -> DataFrame:
    """One row of ``names``, each the sum of its column over the groups that have it."""
    parts = [g.select(*[(F.col(n) if n in g.columns else F.lit(0)).cast("long").alias(n) for n in names]) for g in groups]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.agg(*[F.coalesce(F.sum(n), F.lit(0).cast("long")).alias(n) for n in names])


def _grouped(rows: DataFrame, keys: list[str], count: str, **flags) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.max(c.cast("int")).alias(n) for n, c in flags.items()]).withColumn(count, F.lit(1))


def coverage_dx(match: DataFrame) -> DataFrame:
    """Distinct problem-list and billing ids, matched and unmatched."""
    pl, bill = F.col("dcbilldxid").isNotNull(), F.col("dcxbillid").isNotNull()
    return _coverage([
        _grouped(match.where(pl), ["ptid", "dischid", "pdxid"], "pl_dxids", pl_unmatched=~bill),
        _grouped(match.where(bill), ["ptid", "dischid", "bepicdxid"], "bill_dxids", matched=pl, bill_unmatched=~pl),
    ], ["pl_dxids", "bill_dxids", "matched", "bill_unmatched", "pl_unmatched"])


def coverage_concept(match: DataFrame) -> DataFrame:
    """Distinct problem ids and billing ids, matched and unmatched (the problem id also stands for its noted date)."""
    prob, bill = F.col("dcprobid").isNotNull(), F.col("dcxbillid").isNotNull()
    return _coverage([
        _grouped(match.where(prob), ["ptid", "dischid", "pdxid", "conceptid", "dcprobid"], "pl_concepts",
                 matched=bill & F.col("dcbilldxid").isNotNull(), pl_unmatched=~bill),
        _grouped(match.where(bill), ["ptid", "dischid", "bepicdxid"], "bill_dxids", bill_unmatched=~prob),
    ], ["pl_concepts", "bill_dxids", "matched", "bill_unmatched", "pl_unmatched"])


DX_STATS = ["pldxids", "billdxids", "dxidmatch", "unmatchedpldxid", "unmatchedbilldxid"]
CONCEPT_STATS = ["plconceptids", "conceptidmatch", "unmatchedconceptid"]


def match_stats_dx(match: DataFrame) -> DataFrame:
    """Per (patient, stay): problem-list ids, billing ids, both, each side only."""
    pl, bill = F.col("pdxid").isNotNull(), F.col("bepicdxid").isNotNull()
    return match_stats(match, ["ptid", "dischid"], {
        "pldxids": pl, "billdxids": bill, "dxidmatch": pl & bill,
        "unmatchedpldxid": pl & ~bill, "unmatchedbilldxid": ~pl & bill})


def match_stats_concept(match: DataFrame) -> DataFrame:
    """Per (patient, stay): concepts, concepts billed, concepts not billed."""
    c, bill = F.col("conceptid").isNotNull(), F.col("bepicdxid").isNotNull()
    return match_stats(match, ["ptid", "dischid"], {
        "plconceptids": c, "conceptidmatch": c & bill, "unmatchedconceptid": c & ~bill})


def match_stats_both(match_pr: DataFrame) -> DataFrame:
    """D22 at both levels from one pass over a D21 table: the columns of both statistics per (patient, stay).

    The rows of D20 are the groups of :func:`match_dx_from_concept`; each carries how many D21 rows with a concept
    it stands for, so no row is matched or dealt a second time.
    """
    groups = (match_pr.groupBy("ptid", "dischid", "pdxid", "bepicdxid", "icd9desc")
              .agg(F.count("conceptid").alias("_concepts")))
    pl, bill, concepts = F.col("pdxid").isNotNull(), F.col("bepicdxid").isNotNull(), F.col("_concepts")
    return match_stats(groups, ["ptid", "dischid"], {
        "pldxids": pl, "billdxids": bill, "dxidmatch": pl & bill,
        "unmatchedpldxid": pl & ~bill, "unmatchedbilldxid": ~pl & bill,
        "plconceptids": concepts, "conceptidmatch": F.when(bill, concepts).otherwise(0),
        "unmatchedconceptid": F.when(bill, 0).otherwise(concepts)})


FINAL_COLUMNS = ["pldxids", "plconceptids", "billdxids", "dxidmatch", "conceptidmatch", "unmatchedpldxid",
                 "unmatchedbilldxid", "unmatchedconceptid"]


def final_discharge(disch3: DataFrame, stats_dx: DataFrame, stats_concept: DataFrame) -> DataFrame:
    """Each discharge with its billing match statistics (``disch4``).

    The statistics are keyed by (patient, stay) but joined on the stay only,
    as the published table is; a stay id shared by two patients fans out.
    """
    pr = stats_concept.select("dischid", *CONCEPT_STATS)
    p2 = stats_dx.join(pr, "dischid", "left").select("dischid", *DX_STATS, *CONCEPT_STATS)
    return disch3.join(p2, "dischid", "left").select(*disch3.columns, *FINAL_COLUMNS)
