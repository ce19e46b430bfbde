"""Rejects, versions, ordered outputs and the exact median."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from dxlens import schemas
from dxlens.operators.median import exact_median
from dxlens.plans.catalog import metrics
from dxlens.sources import ordered, rejects, versions
from dxlens.sources.bridge import load_bridge

from .conftest import SMALL


def _write(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(x + "\n" for x in lines))
    return str(folder)


# rejects

def test_rejects_carry_file_line_and_reason(spark, tmp_path):
    good = "1\t20020131\t1\t900\t100\ten\t903\tA \\\"term\\\"\\tx\t905"
    path = _write(tmp_path / "d", "a.txt", [good, "2\t20020131\t1\t900", "x\t20020131\t1\t900\t101\ten\t903\tB\t905"])
    _write(tmp_path / "d", "b.txt", [good + "\textra", "3\t20020131\t1\t900\t\\N\ten\t903\tC\t905", good.replace("1\t2002", "4\t2002")])
    loaded = rejects.load(spark, path, "descr")
    assert sorted((r.id, r.term) for r in loaded.accepted.collect()) == [(1, 'A "term"\tx'), (4, 'A "term"\tx')]
    assert [f.dataType for f in loaded.accepted.schema] == [f.dataType for f in schemas.DESCR]
    found = {(r.file.rsplit("/", 1)[1], r.line.split("\t")[0], r.reason) for r in loaded.rejects.collect()}
    assert found == {("a.txt", "2", "9 fields expected, 4 found"), ("a.txt", "x", "id: not a bigint"),
                     ("b.txt", "1", "9 fields expected, 10 found"), ("b.txt", "3", "conceptid: missing")}
    # the same whatever is read of it
    assert loaded.accepted.count() == 2 == loaded.accepted.select("term").count() and loaded.rejects.count() == 4


@pytest.mark.parametrize("table", sorted(rejects.DIALECTS))
def test_every_input_goes_through_text(spark, tmp_path, table):
    df = load_bridge(spark, SMALL)[table]
    rejects.write_text(df, str(tmp_path / table), table)
    loaded = rejects.load(spark, str(tmp_path / table), table)
    assert loaded.rejects.count() == 0
    schema, null = rejects.DIALECTS[table]
    names = [f.name for f in schema.fields]
    want = df.select(*[F.nullif(F.col(c), F.lit("")) if null == "" and dict(df.dtypes)[c] == "string" else F.col(c) for c in names]).toDF(*names)
    want = want.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    got = loaded.accepted.select(*names)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_bad_timestamps_and_numbers_of_an_extract(spark, tmp_path):
    fields = [""] * len(schemas.PLDATA.fields)
    names = [f.name for f in schemas.PLDATA.fields]

    def line(**values):
        row = list(fields)
        for k, v in values.items():
            row[names.index(k)] = v
        return "\t".join(row)

    path = _write(tmp_path / "p", "p.txt", [line(probid="1", noteddate="2015-01-02"), line(probid="2", noteddate="02.01.2015", overview="many"),
                                            line(ptid="7"), line(probid="3", entrydate="2015-01-02 03:04:05")])
    loaded = rejects.load(spark, path, "pldata")
    assert sorted(r.probid for r in loaded.accepted.collect()) == [1, 3]
    assert {r.reason for r in loaded.rejects.collect()} == {"noteddate: not a timestamp_ntz; overview: not a int", "probid: missing"}
    loaded.release()


# versions

def test_a_refresh_shows_whole_versions_only(spark, tmp_path, monkeypatch):
    table = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        versions.read_current(spark, table)
    versions.refresh(spark.range(10), table)
    assert versions.read_current(spark, table).count() == 10

    def killed(*_):
        raise RuntimeError("killed between write and switch")

    with monkeypatch.context() as m:
        m.setattr(versions, "publish_version", killed)
        with pytest.raises(RuntimeError):
            versions.refresh(spark.range(5), table)
    assert versions.read_current(spark, table).count() == 10
    with pytest.raises(Exception):
        versions.refresh(spark.range(5).select(F.raise_error(F.lit("broken row")).alias("id")), table)
    old = versions.read_current(spark, table)
    versions.refresh(spark.range(7), table)
    assert versions.read_current(spark, table).count() == 7 and old.count() == 10
    # a refresh may read the version that it replaces
    versions.refresh(versions.read_current(spark, table).where("id > 2"), table)
    assert versions.read_current(spark, table).count() == 4
    assert versions.vacuum(spark, table) >= 4 and versions.read_current(spark, table).count() == 4


# ordered outputs

def test_ordered_outputs_follow_the_original_database(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, "a", "b", "é"]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "x int, y string, i int").repartition(7)
    con = duckdb.connect()
    con.execute("CREATE TABLE t (x INT, y VARCHAR, i INT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    for n, (order, sql) in enumerate(((("-x", "y", "i"), "x DESC NULLS FIRST, y NULLS LAST, i"), (("y", "-i"), "y NULLS LAST, i DESC"),
                                      ((F.expr("x % 7"), "x", "i"), "x % 7 NULLS LAST, x NULLS LAST, i"))):
        ordered.write_ordered(df, str(tmp_path / str(n)), order)
        got = [tuple(r) for r in ordered.read_ordered(spark, str(tmp_path / str(n))).collect()]
        assert got == con.execute(f"SELECT * FROM t ORDER BY {sql}").fetchall()


def test_lists_of_the_script_are_written_in_order(spark, tmp_path):
    m = metrics(spark, SMALL)
    from dxlens.plans import snapshot
    out = snapshot.problems_per_patient(m.log)
    ordered.write_ordered(out, str(tmp_path / "p"), ordered.ORDERS["problems_per_patient"])
    rows = [(r.problems, r.ptid) for r in ordered.read_ordered(spark, str(tmp_path / "p")).collect()]
    assert rows == sorted(rows, key=lambda r: (-r[0], r[1])) and len(rows) == out.count()


# median

def test_exact_median_equals_the_built_in(spark):
    rng = random.Random(12)
    tables = []
    for t in range(40):
        tables += [(t, rng.choice([None, "a", "b"]), rng.choice([None, rng.randint(0, 5), rng.random() * 100])) for _ in range(rng.randint(1, 30))]
    df = spark.createDataFrame([(t, g, None if v is None else float(v)) for t, g, v in tables], "t int, g string, v double").repartition(6)
    got = {(r.t, r.g): r.m for r in exact_median(df, ["t", "g"], "v", "m").collect()}
    want = {(r.t, r.g): r.m for r in df.groupBy("t", "g").agg(F.median("v").alias("m")).collect()}
    assert got == pytest.approx(want) and len(got) == len(want)
    assert exact_median(df, [], "v").first()[0] == pytest.approx(df.agg(F.median("v")).first()[0])
    assert [r[0] for r in exact_median(df.limit(0), [], "v").collect()] == [None]


def test_exact_median_of_one_large_group(spark):
    df = spark.range(0, 100_001).select(F.lit(1).alias("k"), ((F.col("id") * 7919) % 100_003).alias("v"))
    assert exact_median(df, ["k"], "v").collect()[0]["median"] == df.agg(F.median("v")).first()[0]
