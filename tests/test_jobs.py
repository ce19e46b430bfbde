"""Hand-made cases the test tables do not reach (FIXTURES.md §3)."""

from pyspark.sql import functions as F

from dxlens.functions.ratios import percent
from dxlens.operators.closure import descendant_closure
from dxlens.operators.grouping import flag_repeats
from dxlens.plans import billing, snapshot, stays, terminology

from .conftest import ts
from .helpers import descr, disch, pldata, relats


def _closure(spark, edges, seeds, max_depth=15):
    e = relats(spark, edges)
    s = spark.createDataFrame([(c,) for c in seeds], "conceptid long")
    out = descendant_closure(terminology.isa_edges(e), s, max_depth=max_depth)
    return {(r.destinationid, r.sourceid): r.depth for r in out.collect()}


def test_closure_cycle_and_self_edge(spark):
    # edges are (child, parent)
    assert _closure(spark, [(2, 1), (1, 2)], [1]) == {(1, 2): 1}
    assert _closure(spark, [(2, 1), (1, 2)], [1, 2]) == {(1, 2): 1, (2, 1): 1}
    assert _closure(spark, [(1, 1), (3, 1)], [1]) == {(1, 1): 1, (1, 3): 1}


def test_closure_depth_cap_and_shortest_path(spark):
    chain = [(k + 1, k) for k in range(17)]
    got = _closure(spark, chain, [0])
    assert got == {(0, k): k for k in range(1, 16)}
    assert _closure(spark, chain, [0], max_depth=None) == {(0, k): k for k in range(1, 18)}
    # two paths to 12: 10 -> 11 -> 12 and 10 -> 12
    assert _closure(spark, [(11, 10), (12, 11), (12, 10)], [10]) == {(10, 11): 1, (10, 12): 1}


def test_closure_ignores_inactive_and_other_types(spark):
    e = relats(spark, [(2, 1)]).unionByName(relats(spark, [(3, 1)], active=0)) \
        .unionByName(relats(spark, [(4, 1)], typeid=363698007))
    s = spark.createDataFrame([(1,)], "conceptid long")
    out = descendant_closure(terminology.isa_edges(e), s)
    assert [(r.destinationid, r.sourceid, r.depth) for r in out.collect()] == [(1, 2, 1)]


def test_current_names_keeps_ties_and_ignores_inactive(spark):
    d = descr(spark, [
        {"id": 1, "conceptid": 7, "term": "old (finding)", "effectivetime": "20020131"},
        {"id": 2, "conceptid": 7, "term": "a (finding)", "effectivetime": "20100131"},
        {"id": 3, "conceptid": 7, "term": "b (disorder)", "effectivetime": "20100131"},
        {"id": 4, "conceptid": 7, "term": "gone", "effectivetime": "20120131", "active": 0},
        {"id": 5, "conceptid": 7, "term": "syn", "effectivetime": "20150131", "typeid": 9},
    ])
    names = terminology.current_names(d)
    assert sorted(r.term for r in names.collect()) == ["a (finding)", "b (disorder)"]
    assert terminology.current_names(d, dedupe=True).count() == 1


def test_semantic_tags_later_update_wins(spark):
    names = descr(spark, [
        {"id": 1, "conceptid": 1, "term": "x (morphologic abnormality)"},
        {"id": 2, "conceptid": 2, "term": "x (person)"},
        {"id": 3, "conceptid": 3, "term": "x (body structure)"},
        {"id": 4, "conceptid": 4, "term": "x (finding)"},
        {"id": 5, "conceptid": 4, "term": "x (disorder)"},
        {"id": 6, "conceptid": 5, "term": "no tag"},
    ])
    problems = spark.createDataFrame([(c,) for c in range(1, 7)], "conceptid long")
    got = {r.conceptid: (r.finding, r.snomedtype)
           for r in terminology.with_semantic_tags(problems, names).collect()}
    assert got == {1: (0, "morphology"), 2: (0, "person"), 3: (0, "bodystruc"), 4: (1, "disorder"),
                   5: (0, "other"), 6: (0, "other")}


def test_backfill_noted(spark):
    log = pldata(spark, [
        {"probid": 1, "ptid": 1, "pdxid": 1, "snomed": 5, "entrydate": ts("2024-01-05 10:00")},
        {"probid": 2, "ptid": 1, "pdxid": 1, "snomed": 5, "entrydate": ts("2024-01-03 10:00")},
        {"probid": 3, "ptid": 1, "pdxid": 1, "snomed": 5, "noteddate": ts("1900-01-01 00:00"),
         "entrydate": ts("2024-01-04 10:00")},
        {"probid": 4, "ptid": 2, "snomed": 5, "entrydate": ts("2024-01-01 10:00")},
        {"probid": 5, "ptid": 3, "pdxid": 1, "entrydate": ts("2024-02-01 10:00")},
        {"probid": 6, "ptid": 4, "pdxid": 1, "snomed": 5},
        {"probid": 7, "ptid": 4, "pdxid": 1, "snomed": 5, "entrydate": ts("2024-03-01 10:00")},
        {"probid": 8, "ptid": 1, "pdxid": 1, "snomed": 5, "noteddate": ts("2023-05-05 00:00"),
         "entrydate": ts("2023-01-01 10:00")},
    ])
    got = {r.probid: r.noteddate for r in snapshot.backfill_noted(log).collect()}
    assert got[1] == got[2] == got[3] == ts("2024-01-03 10:00")
    assert got[4] is None                      # NULL diagnosis: never filled
    assert got[5] == ts("2024-02-01 10:00")    # missing concept counts as 1010
    assert got[6] == got[7] == ts("2024-03-01 10:00")
    assert got[8] == ts("2023-05-05 00:00")    # a real noted date is untouched


def _snapshot(spark, log_rows, stay_rows):
    log, d = pldata(spark, log_rows), disch(spark, stay_rows)
    concepts = spark.createDataFrame([(5,)], "conceptid long")
    return snapshot.snapshot_pairs(log, d, concepts)


STAY = {"dischid": 10, "ptid": 1, "admitdate": ts("2024-01-10 08:00"), "dischdate": ts("2024-01-20 15:00"),
        "los": 10}
EDIT = {"ptid": 1, "pdxid": 1, "snomed": 5, "noteddate": ts("2024-01-01 00:00"), "prov_id": 3}


def test_snapshot_validity_disjunction(spark):
    rows = [
        {**EDIT, "probid": 1, "entrydate": ts("2024-01-05 09:00"), "resoldate": ts("2024-01-02 00:00"),
         "deldate": ts("2024-01-25 00:00")},                     # resolved before, deleted after: kept
        {**EDIT, "probid": 2, "entrydate": ts("2024-01-05 09:00")},          # neither: kept
        {**EDIT, "probid": 3, "entrydate": ts("2024-01-05 09:00"),
         "resoldate": ts("2024-01-20 23:00")},                    # resolved on the discharge day: dropped
        {**EDIT, "probid": 4, "entrydate": ts("2024-01-20 18:00")},          # entered on discharge day
        {**EDIT, "probid": 5, "entrydate": ts("2024-01-21 09:00")},          # after discharge: dropped
        {**EDIT, "probid": 6, "entrydate": ts("2024-01-05 09:00"), "prov_id": None},  # no provider
    ]
    got = {r.probid: r.datediff for r in _snapshot(spark, rows, [STAY]).collect()}
    assert set(got) == {1, 2, 4}
    assert got[4] < 0                                         # negative for a same-day entry
    assert abs(got[2] - (15 - 9 / 24)) < 1e-9


def test_latest_update_keeps_all_rows_of_winner(spark):
    pairs = spark.createDataFrame([
        (1, 10, 1, 5, ts("2024-01-01 00:00"), 100, 2.0),
        (1, 10, 1, 5, ts("2024-01-01 00:00"), 100, 9.0),   # same probid, other entry: kept
        (1, 10, 1, 5, ts("2024-01-01 00:00"), 90, 2.0),    # same datediff, lower probid: dropped
        (1, 10, 1, 5, ts("2024-01-01 00:00"), 120, 3.0),   # later datediff: dropped
        (1, 10, None, 5, ts("2024-01-01 00:00"), 130, 1.0),  # NULL key part: dropped
    ], "ptid long, dischid long, pdxid long, conceptid long, noteddate timestamp_ntz, probid long, "
       "datediff double")
    got = sorted((r.probid, r.datediff) for r in snapshot.latest_update(pairs).collect())
    assert got == [(100, 2.0), (100, 9.0)]


def test_duplicate_flag_null_discharge(spark):
    df = spark.createDataFrame([(None, 5), (None, 5), (1, 5), (1, 5), (1, 6)], "dischid long, conceptid long")
    got = sorted((r.dischid or 0, r.conceptid, r.duplic) for r in flag_repeats(df, ["dischid", "conceptid"],
                                                                               "duplic").collect())
    assert got == [(0, 5, 0), (0, 5, 0), (1, 5, 1), (1, 5, 1), (1, 6, 0)]


def test_updated_during_day_measures(spark):
    names = descr(spark, [{"id": 1, "conceptid": 5, "term": "x (finding)"}])
    stays_rows = [STAY, {**STAY, "dischid": 11, "los": None, "admitdate": ts("2024-02-01 08:00"),
                         "dischdate": ts("2024-02-01 20:00")},
                  {**STAY, "dischid": 12, "los": 0, "admitdate": ts("2024-03-01 08:00"),
                   "dischdate": ts("2024-03-01 20:00")}]
    log = pldata(spark, [
        {**EDIT, "probid": 1, "entrydate": ts("2024-01-10 06:00"), "deldate": ts("2024-01-10 07:00")},
        {**EDIT, "probid": 2, "entrydate": ts("2024-02-01 12:00")},
        {**EDIT, "probid": 3, "entrydate": ts("2024-03-01 18:00")},
    ])
    got = {r.probid: r for r in stays.updated_during(log, disch(spark, stays_rows), names).collect()}
    assert got[1].dischid == 10 and got[1].dayofentry == 0.25 and got[1]["del"] == 1
    assert abs(got[1].dateposition - 0.025) < 1e-12
    assert got[2].dateposition == got[2].dayofentry == 0.5       # NULL los counts as 1
    assert got[3].dateposition == got[3].dayofentry == 0.75      # los 0 counts as 1


def test_readmission_measures(spark):
    d = disch(spark, [
        {"dischid": 1, "ptid": 1, "dischdate": ts("2024-01-10 15:00"), "readmit": ts("2024-01-09 09:00")},
        {"dischid": 2, "ptid": 1, "dischdate": ts("2024-01-10 15:00"), "readmit": ts("2024-02-10 15:00")},
        {"dischid": 3, "ptid": 1, "dischdate": ts("2024-01-10 15:00"), "readmit": ts("2024-02-10 14:00")},
        {"dischid": 4, "ptid": 1, "dischdate": ts("2024-01-10 15:00")},
    ])
    summary = spark.createDataFrame([], "dischid long").select(
        "dischid", *[F.lit(None).cast("double").alias(c) for c in snapshot.SUMMARY_COLUMNS])
    got = {r.dischid: (r.readmitcensored, r.readmit30d)
           for r in snapshot.discharge_enrichment(d, summary, "2024-06-06").collect()}
    assert got == {1: (-1.0, 1), 2: (31.0, 0), 3: (31.0, 1), 4: (148.0, 0)}


def test_median_counts(spark):
    rows = []
    for dischid, values in {1: [None], 2: [4], 3: [1, 2, 3, 10], 4: [1, 5, 9]}.items():
        for i, v in enumerate(values):
            rows.append((dischid, dischid * 100 + i, 5, v))
    base = spark.createDataFrame(rows, "dischid long, probid long, conceptid long, descendants int")
    cols = {"resoldate": "timestamp_ntz", "deldate": "timestamp_ntz", "duplic": "int", "subsumed": "int",
            "descendantslog": "double", "finding": "int", "hospprob": "int", "overview": "int",
            "overlen": "int", "probdesc": "int", "priority": "string", "datediff": "double"}
    for c, t in cols.items():
        base = base.withColumn(c, F.lit(None).cast(t))
    got = {r.dischid: r.mediandesc for r in snapshot.discharge_summary(base).collect()}
    assert got == {1: None, 2: 4.0, 3: 2.5, 4: 5.0}


def test_percent_integer_and_corrected(spark):
    df = spark.createDataFrame([(1, 3), (3, 3), (0, 0)], "a long, b long")
    got = [(r.i, r.c) for r in df.select(percent(F.col("a"), F.col("b"), True).alias("i"),
                                         percent(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got[0][0] == 0.0 and abs(got[0][1] - 100 / 3) < 1e-9
    assert got[1] == (100.0, 100.0)
    assert got[2] == (None, None)


def test_activity_ratios_zero_denominators(spark):
    counts = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0)], "dischid long, dx_active double, pr_active double")
    activity = spark.createDataFrame(
        [(1, 0, 2, 0, 0, 0, None, None, None, 1.0, 0.5), (2, 3, 7, 1, 1, 1, 10.0, 10.0, 10.0, 2.0, 0.4)],
        "dischid long, pr_updated int, tot_updates int, del_updates int, resol_updates int, noted_updates int, "
        "perc_resol_upd double, perc_del_upd double, perc_noted_upd double, avgdayofentry double, "
        "avgdateposition double")
    got = {r.dischid: r for r in stays.activity_ratios(counts, activity, integer_ratio=True).collect()}
    assert got[1].perc_updated == 0 and got[1].upd_perupdprob == 0 and got[1].upd_peractprob == 0
    assert got[2].upd_perupdprob == 2.0 and got[2].pr_notupdated == 1 and got[2].perc_updated == 75.0
    corrected = {r.dischid: r for r in stays.activity_ratios(counts, activity).collect()}
    assert abs(corrected[2].upd_perupdprob - 7 / 3) < 1e-12


def test_billing_match_uses_column_tuples(spark):
    present = spark.createDataFrame([(1, 23, 4, 5, ts("2024-01-01 00:00"), "a")],
                                    "ptid long, dischid long, pdxid long, conceptid long, "
                                    "noteddate timestamp_ntz, picd9desc string")
    bill = spark.createDataFrame([(12, 3, 4, "b")], "ptid long, dischid long, bepicdxid long, bicd9desc string")
    rows = billing.match_dx(present, bill).collect()
    assert len(rows) == 2 and {r.dcbilldxid for r in rows} == {"1234", None}
    assert all(r.dcbilldxid is None or r.dcxbillid is None for r in rows)
    cov = billing.coverage_dx(billing.match_dx(present, bill)).first()
    assert (cov.pl_dxids, cov.bill_dxids, cov.matched, cov.pl_unmatched, cov.bill_unmatched) == (1, 1, 0, 1, 1)


def test_final_discharge_fans_out_on_shared_stay_id(spark):
    disch3 = spark.createDataFrame([(1, 7)], "ptid long, dischid long")
    dx = spark.createDataFrame([(1, 7, 1.0, 1.0, 1.0, 0.0, 0.0), (2, 7, 2.0, 0.0, 0.0, 2.0, 0.0)],
                               "ptid long, dischid long, pldxids double, billdxids double, dxidmatch double, "
                               "unmatchedpldxid double, unmatchedbilldxid double")
    pr = spark.createDataFrame([(1, 7, 1.0, 1.0, 0.0)], "ptid long, dischid long, plconceptids double, "
                                                        "conceptidmatch double, unmatchedconceptid double")
    assert billing.final_discharge(disch3, dx, pr).count() == 2


def test_match_dx_is_projection_of_concept_match(spark):
    from dxlens.plans.catalog import metrics
    from .conftest import SMALL

    m = metrics(spark, SMALL, materialise="none")
    direct = billing.match_dx(m.present_during, m.inputs.billdata)
    derived = billing.match_dx_from_concept(billing.match_concept(m.present_during, m.inputs.billdata))
    assert direct.exceptAll(derived).count() == 0 and derived.exceptAll(direct).count() == 0


def test_pipeline_release_deletes_its_tables(spark):
    import os

    from dxlens.plans.catalog import metrics
    from .conftest import SMALL

    m = metrics(spark, SMALL, materialise="table")
    assert m.names.count() == 207
    paths = list(m._tables)
    assert paths and all(os.path.exists(p.replace("file:", "")) for p in paths)
    m.release()
    assert not any(os.path.exists(p.replace("file:", "")) for p in paths)
    assert m.names.count() == 207                  # rebuilt on demand


def test_pipeline_run_parallel_branches(spark):
    from dxlens.plans.catalog import metrics
    from .conftest import SMALL

    m = metrics(spark, SMALL, materialise="table")
    steps = []
    out = m.run(parallel=3, on_step=lambda name, sec: steps.append(name))
    assert out["discharge_metrics"].count() == 1500
    assert set(steps) == {n for stage in m.RUN_PLAN for branch in stage for n in branch}
    m.release()


def test_one_patient_jobs_accept_an_id(spark):
    from dxlens.plans.catalog import metrics
    from .conftest import SMALL

    m = metrics(spark, SMALL, materialise="none")
    pid = snapshot.busiest_patient(m.log).first().ptid
    by_id = snapshot.patient_timeline(m.log, m.names, pid)
    by_frame = snapshot.patient_timeline(m.log, m.names, snapshot.busiest_patient(m.log))
    assert by_id.count() == by_frame.count() > 0
    snap = snapshot.patient_snapshot(m.log, m.inputs.disch, m.names, pid)
    assert snap.where(F.col("ptid") != pid).count() == 0 and snap.count() > 0


def test_day_logic_ignores_the_session_time_zone(spark):
    rows = [
        {**EDIT, "probid": 1, "entrydate": ts("2024-01-20 23:30"), "resoldate": ts("2024-01-21 00:30")},
        {**EDIT, "probid": 2, "entrydate": ts("2024-01-20 00:10")},
        {**EDIT, "probid": 3, "entrydate": ts("2024-01-05 09:00"), "deldate": ts("2024-01-20 23:59")},
    ]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        results = []
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            results.append(sorted((r.probid, r.datediff) for r in _snapshot(spark, rows, [STAY]).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert results[0] == results[1] == results[2]
    assert [p for p, _ in results[0]] == [1, 2]
