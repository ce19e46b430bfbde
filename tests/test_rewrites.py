"""Aggregate/join rewrites against plain SQL forms on random tables.

Each test builds many random groups at once (ties, NULL keys, NULL values),
runs the Spark operator and the self-join SQL in DuckDB on the same rows and
compares the multisets of results.
"""

import collections
import random

import duckdb
import pandas as pd
import pytest

from dxlens.operators.closure import descendant_closure
from dxlens.operators.grouping import argmin_then_max, flag_members, flag_repeats, flag_repeats_and_members, latest_per_group, packed_argmin
from dxlens.plans import report, terminology

SEEDS = range(8)


def _rows(seed, n=60):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        out.append((rnd.choice([None, 1, 2, 3]), rnd.choice([1, 2]), rnd.choice([None, 1.0, 2.0, 3.0]),
                    rnd.randint(1, 6), i))
    return out


def _spark_and_duck(spark, rows):
    schema = "k long, g long, v double, p long, rid long"
    df = spark.createDataFrame(rows, schema)
    pdf = pd.DataFrame(rows, columns=["k", "g", "v", "p", "rid"]).astype(
        {"k": "Int64", "g": "Int64", "v": "Float64", "p": "Int64", "rid": "Int64"})
    con = duckdb.connect()
    con.register("t", pdf)
    return df, con


def _bag(rows):
    return collections.Counter(tuple(None if v != v else v for v in r) for r in rows)


def test_latest_per_group_equals_self_anti_join(spark):
    for seed in SEEDS:
        df, con = _spark_and_duck(spark, _rows(seed))
        got = _bag((r.k, r.g, r.v, r.p, r.rid) for r in latest_per_group(
            df.where("k is not null"), ["k", "g"], "v").collect())
        want = _bag(con.execute("""
            SELECT a.k, a.g, a.v, a.p, a.rid FROM t a LEFT JOIN t b
              ON a.k = b.k AND a.g = b.g AND a.v < b.v
            WHERE b.k IS NULL AND a.k IS NOT NULL AND a.v IS NOT NULL""").fetchall())
        assert got == want, seed


def test_argmin_then_max_equals_nested_join_back(spark):
    for seed in SEEDS:
        df, con = _spark_and_duck(spark, _rows(seed))
        got = _bag((r.k, r.g, r.v, r.p, r.rid) for r in argmin_then_max(df, ["k", "g"], "v", "p").collect())
        want = _bag(con.execute("""
            WITH lowest AS (SELECT k, g, min(v) AS v FROM t GROUP BY k, g),
                 winner AS (SELECT x.k, x.g, max(x.p) AS p FROM t x
                            JOIN lowest USING (k, g) WHERE x.v = lowest.v GROUP BY x.k, x.g)
            SELECT x.k, x.g, x.v, x.p, x.rid FROM t x JOIN winner w ON w.k = x.k AND w.g = x.g AND w.p = x.p
            """).fetchall())
        assert got == want, seed


def test_flag_repeats_equals_having_update(spark):
    for seed in SEEDS:
        df, con = _spark_and_duck(spark, _rows(seed))
        got = _bag((r.rid, r.f) for r in flag_repeats(df, ["k", "g"], "f").collect())
        want = _bag(con.execute("""
            SELECT t.rid, CASE WHEN d.k IS NULL THEN 0 ELSE 1 END FROM t LEFT JOIN (
              SELECT k, g FROM t GROUP BY k, g HAVING COUNT(*) > 1) d ON t.k = d.k AND t.g = d.g""").fetchall())
        assert got == want, seed


def _least_depths(edges, seed):
    """Plain breadth-first search over a child list."""
    children = {}
    for child, parent in edges:
        children.setdefault(parent, []).append(child)
    depths, queue = {}, [(seed, 0)]
    for node, depth in queue:
        for child in children.get(node, ()):
            if child not in depths and (child != seed or depth == 0):
                depths[child] = depth + 1
                if child != seed:
                    queue.append((child, depth + 1))
    return depths


def test_closure_equals_plain_search(spark):
    for seed in range(4):
        rnd = random.Random(seed)
        edges = sorted({(rnd.randint(0, 25), rnd.randint(0, 25)) for _ in range(45)})
        seeds = sorted({rnd.randint(0, 25) for _ in range(5)})
        e = spark.createDataFrame(edges, "sourceid long, destinationid long")
        s = spark.createDataFrame([(x,) for x in seeds], "conceptid long")
        for limit in (6, None):
            got = _bag((r.destinationid, r.sourceid, r.depth) for r in descendant_closure(e, s, max_depth=limit).collect())
            want = _bag((top, node, depth) for top in seeds for node, depth in _least_depths(edges, top).items()
                        if limit is None or depth <= limit)
            assert got == want, (seed, limit)


def test_packed_argmin_equals_plain_choice(spark):
    big = 2 ** 62 - 1
    for seed in SEEDS:
        rnd = random.Random(seed)
        rows = [(rnd.choice([None, 1, 2, 3]), rnd.choice([1, 2]), rnd.choice([None, -big, -7, 0, 5, big]),
                 rnd.choice([None, -2 ** 63, -1, 0, 4, 2 ** 63 - 1])) for _ in range(60)]
        df = spark.createDataFrame(rows, "k long, g long, v long, p long")
        got = {(r.k, r.g): r.p for r in packed_argmin(df, ["k", "g"], "v", "p").collect()}
        want = {}
        for k, g, v, p in rows:
            if None not in (k, g, v, p):
                want[k, g] = min(want.get((k, g), (v, -p)), (v, -p))
        assert got == {key: -t for key, (_, t) in want.items()}, seed


def test_packed_argmin_is_a_hash_aggregate(spark):
    df = spark.range(100).selectExpr("id % 7 AS k", "id % 5 AS v", "id AS p")
    plan = packed_argmin(df, ["k"], "v", "p")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_both_flags_equal_the_single_ones(spark):
    """One grouping for repeats and members sets what the two separate joins set, NULL keys included."""
    for seed in SEEDS[:3]:
        df, _ = _spark_and_duck(spark, _rows(seed))
        members = spark.createDataFrame([(k, g) for k, g, *_ in _rows(seed + 100, 8)] + [(9, 9), (None, 1), (1, None)], "k long, g long")
        both = flag_repeats_and_members(df, members, ["k", "g"], "twice", "member")
        single = flag_members(flag_repeats(df, ["k", "g"], "twice"), members, ["k", "g"], "member")
        assert both.schema == single.schema
        assert _bag(both.collect()) == _bag(single.collect())
        none = flag_repeats_and_members(df, members.limit(0), ["k", "g"], "twice", "member")
        assert {r.member for r in none.collect()} == {0}


def test_concept_facts_equal_the_two_joins(spark):
    """D9 and D10 by one join: concepts without descendants, without names, with tied names and a NULL id."""
    problems = spark.createDataFrame([(i, c) for i, c in enumerate([1, 1, 2, 3, 4, 5, None])], "probid long, conceptid long")
    closure = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (2, 3, 1), (4, 3, 1), (None, 7, 1)], "destinationid long, sourceid long, depth int")
    names = spark.createDataFrame([(1, "a (finding)"), (1, "b (disorder)"), (2, "c (person)"), (3, "d"), (5, None), (None, "e (finding)")],
                                  "conceptid long, term string")
    both = terminology.with_concept_facts(problems, closure, names)
    single = terminology.with_semantic_tags(terminology.with_specificity(problems, closure), names)
    assert both.columns == single.columns
    assert [f.dataType for f in both.schema] == [f.dataType for f in single.schema]
    assert _bag(both.collect()) == _bag(single.collect())


def test_reconciliation_equals_distinct_counts(spark):
    """Distinct non-NULL keys of each stage, empty stages and stages of NULLs only as 0, by one shuffle of keys."""
    keys = {"a": [1, 1, 2, None], "b": [2, 3, 4, 4], "c": [], "d": [None, None], "e": [5]}
    stages = {n: spark.createDataFrame([(k, "x") for k in ks], "dischid long, other string") for n, ks in keys.items()}
    out = report.reconciliation(stages)
    assert [(r.stage, r.discharges) for r in out.collect()] == [
        (n, df.select("dischid").where("dischid IS NOT NULL").distinct().count()) for n, df in stages.items()]
    plan = report.reconciliation(stages)._jdf.queryExecution().executedPlan().toString()  # not run yet: one plan, not two
    assert plan.count("hashpartitioning") == 1 and "SortAggregate" not in plan
    with pytest.raises(ValueError):
        report.reconciliation({})
