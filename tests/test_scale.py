"""Skew handling and plan shape."""

import collections
import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from dxlens.operators.dyadic import KeyLoads, ancestors, cover, day_number, interval_join, key_depths, with_nodes
from dxlens.operators.intervals import hot_key_join, hot_keys


def test_hot_key_join_equals_plain_join(spark):
    big = spark.range(0, 3000).select((F.when(F.col("id") < 2000, 1).otherwise(F.col("id") % 7)).alias("k"),
                                      F.col("id").alias("rid"), (F.col("id") % 10).alias("v"))
    small = spark.range(0, 40).select((F.col("id") % 8).alias("k"), (F.col("id") % 10).alias("w"))
    cond = F.col("b.v") <= F.col("s.w")
    salted = hot_key_join(big, small, ["k"], cond, row_id=["rid"], task_pairs=100)
    got = collections.Counter((r[0], r[1], r[2]) for r in salted.select("b.k", "b.rid", "s.w").collect())
    plain = big.alias("b").join(small.alias("s"), (F.col("b.k") == F.col("s.k")) & cond)
    want = collections.Counter((r[0], r[1], r[2]) for r in plain.select("b.k", "b.rid", "s.w").collect())
    assert got == want
    hot = {r.k: (r._buckets, r._spread) for r in hot_keys(big, ["k"], 100, small, split_small=False).collect()}
    assert hot[1] == (108, 1)                  # 2143 x 5 pairs, 100 a task
    assert hot_keys(big, ["k"], 2143 * 5, small).count() == 0


def test_snapshot_scan_prunes_columns_and_pushes_filters(spark):
    from dxlens.plans.catalog import metrics
    from .conftest import SMALL

    m = metrics(spark, SMALL, materialise="none")
    plan = m.inputs.disch._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan
    text = m.names._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string,p_type:string>" in text


def test_pipeline_with_a_patient_holding_a_third_of_all_edits(spark):
    """One patient owns a third of the edits: dyadic and grid-split range joins give the same rows."""
    from dxlens.plans.catalog import metrics
    from dxlens.plans.pipeline import ProblemListMetrics
    from .conftest import SMALL

    base = metrics(spark, SMALL, materialise="none").inputs
    skewed_log = base.pldata.withColumn("ptid", F.when(F.col("probid") % 3 == 0, F.lit(7)).otherwise(F.col("ptid")))
    inputs = type(base)(base.descr, base.relats, skewed_log, base.disch, base.billdata)
    plain = ProblemListMetrics(inputs, study_end="2024-06-06", materialise="none")
    salted = ProblemListMetrics(inputs, study_end="2024-06-06", materialise="none", task_pairs=40)
    assert {r.ptid: r._grid for r in salted.hot_patients.collect()}[7]
    deep = ProblemListMetrics(inputs, study_end="2024-06-06", materialise="none", task_pairs=40)
    both = [x.where(F.col("ptid").isNotNull()) for x in (deep.log, inputs.disch)]
    deep.loads = KeyLoads(key_depths(*both, ["ptid"], 40, gain=0))
    assert max(r._depth for r in deep.loads.depths.collect()) > 4
    for name in ("snapshot_pairs", "updated_during", "present_during"):
        a = getattr(plain, name)
        for b in (getattr(salted, name), getattr(deep, name)):
            assert a.count() == b.count() and a.exceptAll(b).count() == 0, name


def _point_in_interval(intervals, points, **options):
    low, high, at = day_number(F.col("low")), day_number(F.col("high")), day_number(F.col("at"))
    exact = (F.col("b.low") <= F.col("s.at")) & (F.col("b.high").isNull() | (F.col("b.high") >= F.col("s.at")))
    return interval_join(intervals, points, ["k"], lambda n: cover(low, high, n), lambda n: ancestors(at, n), exact,
                         row_id=["b_id"], small_row_id=["s_id"], **options)


def test_interval_join_equals_range_join_for_any_days(spark):
    rng = random.Random(3)

    def some_day():
        return date(1900, 1, 1) + timedelta(rng.choice([rng.randint(0, 60), rng.randint(-900, 90_000), 65_535, 65_536, 0]))

    rows = [(rng.randint(0, 3), i, some_day(), rng.choice([None, some_day()])) for i in range(400)]
    intervals = spark.createDataFrame(rows, "k int, b_id int, low date, high date")
    points = spark.createDataFrame([(rng.randint(0, 3), i, rng.choice([some_day(), some_day(), None])) for i in range(300)], "k int, s_id int, at date")
    plain = intervals.alias("b").join(points.alias("s"), F.expr("b.k = s.k AND b.low <= s.at AND coalesce(b.high >= s.at, true)"))
    want = sorted(tuple(r) for r in plain.select("b_id", "s_id").collect())
    assert len(want) > 1000
    for depth in (0, 1, 5, 16):
        depths = spark.createDataFrame([(k, depth, k < 2) for k in range(4)], "k int, _depth int, _grid boolean")
        for split, task_pairs in ((True, 50), (False, 50)):
            got = _point_in_interval(intervals, points, loads=KeyLoads(depths, split), task_pairs=task_pairs)
            assert sorted(tuple(r) for r in got.select("b_id", "s_id").collect()) == want, depth


def test_one_patient_with_many_edits_and_stays_forms_few_pairs(spark):
    """20,000 intervals and 20,000 points of one key: the pairs tested are near the pairs found."""
    start = F.lit("1950-01-01").cast("date")
    intervals = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("b_id"), F.expr("date_add(DATE'1950-01-01', int(id * 7919 % 20000))").alias("low"))
    intervals = intervals.withColumn("high", F.expr("date_add(low, int(b_id % 9))"))
    points = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("s_id"), F.date_add(start, F.expr("int(id * 31 % 20000)")).alias("at"))
    depths = key_depths(intervals, points, ["k"])
    assert [tuple(r) for r in depths.collect()] == [(1, 15, True)]
    b = with_nodes(intervals, ["k"], depths, lambda n: cover(day_number(F.col("low")), day_number(F.col("high")), n))
    s = with_nodes(points, ["k"], depths, lambda n: ancestors(day_number(F.col("at")), n))
    formed = b.join(s, ["k", "_node"]).count()
    found = _point_in_interval(intervals, points).count()
    assert found == intervals.select(F.sum(F.least(F.lit(19_999), F.expr("datediff(high, DATE'1950-01-01')")) - F.expr("datediff(low, DATE'1950-01-01')") + 1)).first()[0]
    assert formed < 2 * found  # all pairs would be 400 million


def test_grid_split_when_both_sides_are_hot(spark):
    big = spark.range(0, 2000).select((F.col("id") % 3).alias("k"), F.col("id").alias("rid"),
                                      (F.col("id") % 11).alias("v"))
    small = spark.range(0, 600).select(F.when(F.col("id") < 500, 0).otherwise(F.col("id") % 3).alias("k"),
                                       F.col("id").alias("sid"), (F.col("id") % 13).alias("w"))
    cond = F.col("b.v") <= F.col("s.w")
    hot = {r.k: (r._buckets, r._spread) for r in hot_keys(big, ["k"], 2000, small).collect()}
    assert hot[0][0] > 1 and hot[0][1] > 1          # a grid: 667 x 533 pairs, few rows on either side
    pairs = hot_key_join(big, small, ["k"], row_id=["rid"], small_row_id=["sid"], task_pairs=2000)
    cells = [r["count"] for r in pairs.where("b.k = 0").groupBy("b._sa", "b._sb").count().collect()]
    assert sum(cells) == 667 * 533 and max(cells) < 3 * 2000
    salted = hot_key_join(big, small, ["k"], cond, row_id=["rid"], small_row_id=["sid"], task_pairs=100)
    got = collections.Counter(tuple(r) for r in salted.select("b.rid", "s.sid").collect())
    plain = big.alias("b").join(small.alias("s"), (F.col("b.k") == F.col("s.k")) & cond)
    want = collections.Counter(tuple(r) for r in plain.select("b.rid", "s.sid").collect())
    assert got == want and max(got.values()) == 1


def test_closure_loop_shuffles_neither_edges_nor_visited(spark):
    from dxlens.operators.closure import _Search

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    e = spark.range(1, 200).selectExpr("id AS child", "id DIV 2 AS parent")
    search = _Search(e, spark.range(3).selectExpr("id AS seed"), None)
    try:
        search.store_edges(e)
        assert search.append(search.reached(spark.range(3).selectExpr("id AS seed", "id AS node")), 1)
        plan = search.next_level(2)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        search.close()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    depth_of = [len(line) - len(line.lstrip(" :+-|")) for line in plan]

    def exchanges_above(at):
        # the operators on the way from this scan up to the root
        found, depth = [], depth_of[at]
        for i in range(at - 1, -1, -1):
            if depth_of[i] < depth:
                depth = depth_of[i]
                found.append(plan[i])
        return found

    scans = [i for i, line in enumerate(plan) if "Scan parquet" in line]
    assert len(scans) == 3
    for i in scans:
        shuffled = False
        for line in exchanges_above(i):
            if "Join" in line:
                break
            shuffled = shuffled or "Exchange" in line
        is_level = "PartitionFilters: [isnotnull(depth" in plan[i]
        assert shuffled == is_level, "\n".join(plan)


def test_shared_tables_are_those_read_twice(spark):
    from dxlens.plans.catalog import _INTEGER_JOBS, _JOBS, metrics
    from dxlens.plans.pipeline import GRAPH, ProblemListMetrics, shared_tables
    from .conftest import SMALL

    stored = shared_tables(["disch4"])
    assert len(stored) <= 9 and {"log", "terms", "latest", "problems", "present_during"} <= stored
    assert "disch2" not in stored and "disch3" not in stored and "disch4" not in stored
    assert all(set(reads.split()) <= set(GRAPH) for reads, _ in [*_JOBS.values(), *_INTEGER_JOBS.values()])

    # what the jobs really read is what the graph declares
    seen, stack = {}, []

    class Traced(ProblemListMetrics):
        def __getattribute__(self, name):
            if name not in GRAPH:
                return super().__getattribute__(name)
            if stack:
                seen.setdefault(stack[-1], set()).add(name)
            stack.append(name)
            try:
                return super().__getattribute__(name)
            finally:
                stack.pop()

    plain = metrics(spark, SMALL, outputs=["disch4", "outside", "snapshot"])
    traced = Traced(plain.inputs, study_end=plain.study_end, max_depth=3, outputs=["disch4", "outside", "snapshot"])
    for name in ("disch4", "outside", "snapshot"):
        getattr(traced, name)
    assert {job: read for job, read in seen.items() if read != set(GRAPH[job])} == {}
    assert len(traced._tables) <= 11
    traced.release()


def test_final_discharge_is_a_plan_of_its_own_operators(spark):
    from dxlens.plans.catalog import QUERIES
    from .conftest import SMALL

    plan = QUERIES["final_discharge"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Aggregate" in plan


def test_latest_from_keys_equals_latest_of_pairs(spark):
    from dxlens.plans import snapshot
    from dxlens.plans.catalog import metrics
    from .conftest import SMALL

    m = metrics(spark, SMALL, outputs=["log", "log", "terms", "terms", "loads"])
    log = m.log.unionByName(m.log.where("probid % 11 = 0"))        # repeated edits stay repeated
    pairs = snapshot.snapshot_pairs(log, m.inputs.disch, m.concepts, loads=m.loads)
    keys = snapshot.snapshot_keys(log, m.inputs.disch, m.concepts, loads=m.loads)
    got = snapshot.latest_from_keys(keys, log, m.inputs.disch)
    want = snapshot.latest_update(pairs).select(*got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() > 0
    m.release()
