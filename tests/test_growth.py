"""Work that must not grow with settings, or faster than the input."""

from dxlens.operators.closure import _Search, descendant_closure

from .conftest import SMALL, ts
from .helpers import billdata, disch, pldata


def test_closure_levels_pay_for_the_edges_not_for_shuffle_partitions(spark):
    e = spark.range(1, 200).selectExpr("id AS child", "id DIV 2 AS parent")
    seeds = spark.range(3).selectExpr("id AS seed")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        search = _Search(e, seeds, None)
        try:
            assert search.buckets == spark.sparkContext.defaultParallelism < 64
            search.store_edges(e)
            assert search.append(search.reached(seeds.selectExpr("seed", "seed AS node")), 1)
            plan = search.next_level(2)._jdf.queryExecution().executedPlan().toString()
            assert ", 64)" not in plan
        finally:
            search.close()
        got = descendant_closure(e, seeds, child="child", parent="parent", seed_col="seed")
        want = set()
        for node in range(1, 200):
            depth, up = 1, node // 2
            while True:
                if up < 3 and up != node:
                    want.add((up, node, depth))
                if up == 0:
                    break
                depth, up = depth + 1, up // 2
        assert {tuple(r) for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_pairs_dealt_by_patient_are_not_shuffled_to_be_counted(spark):
    from dxlens.operators.dyadic import KeyLoads
    from dxlens.plans import stays

    log = pldata(spark, [{"probid": i, "ptid": i % 3, "pdxid": i % 2, "snomed": i % 5, "prov_id": 1, "noteddate": ts("2024-01-01"),
                          "entrydate": ts("2024-01-02"), "resoldate": ts("2024-01-04") if i % 4 == 0 else None} for i in range(40)])
    stay = disch(spark, [{"dischid": i, "ptid": i % 3, "admitdate": ts("2024-01-02"), "dischdate": ts(f"2024-01-0{3 + i % 4}"), "los": 1}
                         for i in range(9)])
    names = spark.createDataFrame([(c, t) for c in range(4) for t in ("a", "b")][1:], "conceptid long, term string")
    none = spark.createDataFrame([], "ptid long, _depth int, _grid boolean")
    general, plain = KeyLoads(none, False), KeyLoads(none, False, 6)
    for build in (stays.present_during, stays.updated_during):
        got, want = build(log, stay, names, loads=plain), build(log, stay, names, loads=general)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() > 0
    present = stays.present_during(log, stay, names, loads=plain)
    plan = stays.active_counts(present)._jdf.queryExecution().executedPlan().toString().split("\n")
    pairs = next(i for i, line in enumerate(plan) if "Join" in line and "ptid" in line)
    assert sum("Exchange" in line for line in plan[:pairs]) == 1   # the counts by stay


def test_match_dealt_by_key_equals_full_match(spark):
    from dxlens.plans import billing

    when = ts("2024-01-01")
    present = spark.createDataFrame(
        [(1, 10, 5, 7, when, "x"), (1, 10, 5, 7, when, "y"), (1, 10, 5, 8, None, "x"), (1, 10, None, 7, when, "x"),
         (1, 10, None, 7, ts("2024-01-02"), "x"), (1, None, 5, 7, when, "x"), (2, 10, 5, 7, when, "z")],
        "ptid long, dischid long, pdxid long, conceptid long, noteddate timestamp_ntz, picd9desc string")
    bill = billdata(spark, [{"ptid": p, "dischid": d, "bepicdxid": x, "bicd9desc": t} for p, d, x, t in [
        (1, 10, 5, "A"), (1, 10, 5, None), (1, 10, 5, "x"), (1, 10, None, "A"), (3, 11, 6, "B"), (3, 11, 6, "B"), (None, 10, 5, "A")]])
    rows = sorted(map(str, billing.match_concept(present, bill).collect()))
    assert rows == sorted(map(str, billing.match_concept(present, bill, 5).collect())) and len(rows) == len(set(rows)) == 11
    plan = billing.match_stats_concept(billing.match_concept(present, bill, 5))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 3   # either side and their rows by stay


def test_summary_of_a_missing_stay_and_its_shuffles(spark):
    from dxlens.plans import snapshot

    columns = ("dischid long, probid long, conceptid long, resoldate timestamp_ntz, deldate timestamp_ntz, duplic int, subsumed int, "
               "descendants int, descendantslog double, finding int, hospprob int, overview int, overlen int, probdesc int, "
               "priority string, datediff double")
    tail = (7, None, None, 0, 0, 1, 0.3, 1, 1, 1, 4, 1, None, 0.5)
    problems = spark.createDataFrame([(d, p, *tail) for d, p in [(1, 1), (1, 1), (1, 2), (None, 3), (None, 4), (None, 4), (2, None)]], columns)
    out = snapshot.discharge_summary(problems)
    assert {r.dischid: (r.probcount, r.snomedcount) for r in out.collect()} == {1: (2, 3), None: (2, 3), 2: (0, 1)}
    assert "hashpartitioning(coalesce" not in out._jdf.queryExecution().executedPlan().toString()


def test_the_match_is_not_stored_and_stored_problems_are_narrow(spark):
    from dxlens.plans import snapshot
    from dxlens.plans.catalog import metrics
    from dxlens.plans.pipeline import shared_tables

    assert "match_concept" not in shared_tables(["disch4"]) and "terms" in shared_tables(["match_concept"])
    m = metrics(spark, SMALL, outputs=["disch4"])
    assert m.latest.columns == snapshot.MEASURED_COLUMNS
    m.release()


def test_latest_in_place_equals_latest_of_pairs_and_does_not_shuffle_them(spark):
    from dxlens.operators.dyadic import KeyLoads
    from dxlens.plans import snapshot

    days = ["2024-01-01", "2024-01-02 07:00:00", "2024-01-02 09:00:00", None]
    log = pldata(spark, [{"probid": i // 2, "ptid": i % 3 if i % 11 else None, "pdxid": i % 2 if i % 13 else None,
                          "snomed": i % 4, "prov_id": 1 if i % 17 else None, "noteddate": ts("2024-01-01"),
                          "entrydate": ts(days[i % 4]) if days[i % 4] else None, "overlen": i % 5,
                          "resoldate": ts(f"2024-01-0{1 + i % 6}") if i % 3 == 0 else None,
                          "deldate": ts(f"2024-01-0{2 + i % 5}") if i % 5 == 0 else None} for i in range(200)])
    log = log.unionByName(log.where("probid % 5 = 0"))             # repeated edits stay repeated
    stays = [{"dischid": i // 2, "ptid": i % 3, "dischdate": ts(f"2024-01-0{1 + i % 7} 10:00:00") if i % 6 else None}
             for i in range(20)]
    stay = disch(spark, stays + stays[3:6])                        # and so do discharges
    concepts = spark.range(1, 4).selectExpr("id AS conceptid")
    loads = KeyLoads(spark.createDataFrame([], "ptid long, _depth int, _grid boolean"), False, 6)
    got = snapshot.latest_in_place(log, stay, concepts, loads=loads)
    want = snapshot.latest_update(snapshot.snapshot_pairs(log, stay, concepts, loads=loads)).select(*got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() > got.distinct().count() > 20
    plan = got._jdf.queryExecution().executedPlan().toString().split("\n")
    pairs = next(i for i, line in enumerate(plan) if "Join" in line and "ptid" in line and "LeftSemi" not in line)
    assert sum("Exchange" in line for line in plan[:pairs]) == 0


def test_both_match_statistics_in_one_pass_equal_the_two(spark):
    from dxlens.plans import billing
    from dxlens.plans.catalog import metrics
    from dxlens.plans.pipeline import shared_tables
    from dxlens.plans.stays import COUNTED_COLUMNS

    when = ts("2024-01-01")
    present = spark.createDataFrame(
        [(1, 10, 5, 7, when, "x"), (1, 10, 5, 7, when, "y"), (1, 10, 5, 8, None, "x"), (1, 10, None, 7, when, "x"),
         (1, 10, 5, None, when, "x"), (1, None, 5, 7, when, "x"), (2, 10, 5, 7, when, "z"), (1, 10, 6, 7, when, None)],
        "ptid long, dischid long, pdxid long, conceptid long, noteddate timestamp_ntz, picd9desc string")
    bill = billdata(spark, [{"ptid": p, "dischid": d, "bepicdxid": x, "bicd9desc": t} for p, d, x, t in [
        (1, 10, 5, "A"), (1, 10, 5, None), (1, 10, 5, "x"), (1, 10, None, "A"), (3, 11, 6, "B"), (3, 11, 6, "B"), (None, 10, 5, "A")]])
    match = billing.match_concept(present, bill, 5)
    both = billing.match_stats_both(match.drop("dcbilldxid", "dcxbillid", "dcprobid"))
    keys = ["ptid", "dischid"]
    for got, want in ((both.select(*keys, *billing.DX_STATS), billing.match_stats_dx(billing.match_dx_from_concept(match))),
                      (both.select(*keys, *billing.CONCEPT_STATS), billing.match_stats_concept(match))):
        assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 3   # either side and their rows by stay
    assert "match_stats" in shared_tables(["disch4"]) and "match_dx" not in shared_tables(["disch4"])
    m = metrics(spark, SMALL, outputs=["disch4"])
    assert m.present_during.columns == COUNTED_COLUMNS
    m.release()


def test_stored_presence_is_dealt_into_as_many_partitions_as_its_rows_fill(spark):
    from dxlens.operators.dyadic import KeyLoads
    from dxlens.plans.catalog import metrics

    m = metrics(spark, SMALL, outputs=["pr_present", "match_concept"])
    m.loads = KeyLoads(m.hot_patients, False, 13)
    assert ", 13)" in m.pr_present._jdf.queryExecution().executedPlan().toString() and m.pr_present.count() > 0
    m.release()


def test_pairs_of_hot_patients_are_dealt_and_counted_in_as_many_partitions_as_they_fill(spark):
    from dxlens.operators.dyadic import key_depths, pairs_of
    from dxlens.plans.catalog import metrics
    from dxlens.plans.pipeline import Inputs, ProblemListMetrics
    from pyspark.sql import functions as F

    base = metrics(spark, SMALL, materialise="none").inputs
    log = base.pldata.withColumn("ptid", F.when(F.col("probid") % 3 == 0, F.lit(7)).otherwise(F.col("ptid")))
    stay = base.disch.withColumn("ptid", F.when(F.col("dischid") % 5 == 0, F.lit(7)).otherwise(F.col("ptid")))
    inputs = Inputs(base.descr, base.relats, log, stay, base.billdata)
    both = [x.where(F.col("ptid").isNotNull()) for x in (log, stay)]
    hot = key_depths(*both, ["ptid"])
    edits, stays_of = (x.where("ptid = 7").count() for x in both)
    assert [r.ptid for r in hot.collect()] == [7] and pairs_of(*both, ["ptid"], hot) == edits * stays_of
    for task_pairs, grid in ((50_000_000, False), (2_000, True)):
        m = ProblemListMetrics(inputs, study_end="2024-06-06", materialise="none", task_pairs=task_pairs, outputs=["pr_present", "stats_concept"])
        found = m.loads
        assert found.partitions is None and found.dealt == found.tasks >= 1 and found.split == grid
        rows = {}
        for dealt in (None, 13):
            found.dealt = dealt
            for name in ("pr_present", "stats_concept", "present_during", "updated_during"):
                m.__dict__.pop(name, None)
            m.__dict__.pop("match_concept", None)
            plans = {name: getattr(m, name) for name in ("pr_present", "stats_concept", "updated_during")}
            text = plans["pr_present"]._jdf.queryExecution().executedPlan().toString()
            assert text.count(", 13)") == (3 if dealt else 0)   # either side by node, their pairs by stay
            rows[dealt] = {name: sorted(map(str, df.collect())) for name, df in plans.items()}
        assert rows[13] == rows[None] and all(rows[13].values())


def test_rows_behind_the_bills_are_dealt_by_their_number(spark, monkeypatch):
    from dxlens.plans import catalog
    from dxlens.sources import bridge

    lines = spark.createDataFrame([(o, p, f, "O") for o, p, f in [(1, 41, "A"), (1, 5, None), (1, 5, None), (2, None, "R"), (None, 3, "A"), (9, 4, "N")]],
                                  "l_orderkey long, l_partkey long, l_returnflag string, l_linestatus string")
    orders = spark.createDataFrame([(1, 10), (1, 11), (2, None), (None, 12)], "o_orderkey long, o_custkey long")
    plain, dealt = bridge.billdata_from_lineitem(lines, orders), bridge.billdata_from_lineitem(lines, orders, 7)
    assert dealt._jdf.queryExecution().executedPlan().toString().count(", 7)") == 2
    assert sorted(map(str, plain.collect())) == sorted(map(str, dealt.collect())) and plain.count() == 7
    assert bridge.bill_partitions(lines, orders) is None
    few, many = (bridge.bill_partitions(spark.range(n * bridge.BILL_ROWS), spark.range(1)) for n in (3, 300))
    assert few <= 4 and many == 300
    monkeypatch.setattr(bridge, "bill_partitions", lambda *tables: 7)
    for outputs, reads in ((["match_dx"], True), (["billdata"], True), (["pr_present"], False)):
        text = catalog.metrics(spark, SMALL, outputs=outputs).inputs.billdata._jdf.queryExecution().executedPlan().toString()
        assert (text.count(", 7)") == 2) == reads
