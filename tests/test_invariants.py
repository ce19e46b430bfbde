
import pytest
from pyspark.sql import functions as F

from dxlens.plans import billing, snapshot, terminology
from dxlens.plans.catalog import metrics

from .conftest import SMALL


@pytest.fixture(scope="module")
def m(spark):
    out = metrics(spark, SMALL, materialise="table")
    yield out
    out.release()


def test_dx_coverage_adds_up(m):
    c = billing.coverage_dx(m.match_dx).first()
    assert c.matched + c.pl_unmatched == c.pl_dxids
    assert c.matched + c.bill_unmatched == c.bill_dxids


def test_concept_coverage_adds_up(m):
    c = billing.coverage_concept(m.match_concept).first()
    assert c.matched + c.pl_unmatched == c.pl_concepts


def test_left_join_stages_keep_every_discharge(m):
    counts = {r.stage: r.discharges for r in m.reconciliation().collect()}
    assert counts["disch"] == counts["disch2"] == counts["disch3"] == counts["disch4"] == 1500
    assert counts["pusumm"] == counts["pr_present"]
    assert counts["pr_updated"] <= counts["pr_present"]


def test_one_row_per_discharge(m):
    assert m.disch4.count() == m.inputs.disch.count()
    assert m.summary.count() == m.summary.select("dischid").distinct().count()


def test_duplicate_groups_at_most_half_of_flagged_rows(m):
    groups = snapshot.duplicate_groups(m.latest).count()
    flagged = m.problems.where("duplic = 1").count()
    assert 2 * groups <= flagged


def test_seed_count_equals_distinct_concepts(m):
    seeds = terminology.concept_seeds(m.latest).count()
    assert seeds == m.latest.select("conceptid").distinct().count()
    assert m.closure.select("destinationid").distinct().count() <= seeds


def test_subsumed_flags_cover_pairs(m):
    pairs = m.subsumption.select("dischid", "conceptid").distinct().count()
    flagged = m.problems.where("subsumed = 1").select("dischid", "conceptid").distinct().count()
    assert pairs == flagged


def test_updates_inside_and_outside_cover_the_log(m):
    inside = m.updated_during.select("probid").distinct().count()
    outside = m.log.join(m.updated_during.select("probid").distinct(), "probid", "left_anti") \
        .select("probid").distinct().count()
    assert inside + outside == m.log.select("probid").distinct().count()


def test_closure_depth_bounds(m):
    r = m.closure.agg(F.min("depth").alias("lo"), F.max("depth").alias("hi")).first()
    assert r.lo == 1 and r.hi <= 15


def test_sql_views_answer_report_queries(m, spark):
    m.register_views()
    assert spark.sql("SELECT COUNT(DISTINCT dischid) AS n FROM disch4").first().n == 1500
    no_priority = spark.sql("SELECT COUNT(*) AS n FROM disch2 WHERE countpriority = 0").first().n
    assert no_priority == snapshot.no_priority_count(m.disch2).first().discharges
    top = spark.sql("SELECT ptid, COUNT(probid) AS c FROM pldata GROUP BY ptid ORDER BY c DESC LIMIT 1").first()
    assert top.c == snapshot.problems_per_patient(m.log, ordered=True).first().problems
    assert spark.sql("SELECT COUNT(*) AS n FROM pldata2 WHERE duplic = 1").first().n == \
        m.problems.where("duplic = 1").count()
