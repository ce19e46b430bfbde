"""Readers, normalisers and sinks on small files written by the test."""

import decimal
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from dxlens import schemas
from dxlens.sources import normalise, publish, read_billdata, read_descr, read_pldata
from dxlens.sources.sinks import materialise


def _write(lines):
    d = tempfile.mkdtemp(prefix="dxlens-src-")
    path = os.path.join(d, "data.txt")
    with open(path, "w") as fh:
        fh.write("\n".join(lines) + "\n")
    return path


def test_terminology_reader_keeps_quotes_and_long_ids(spark):
    path = _write([
        "id\teffectiveTime\tactive\tmoduleId\tconceptId\tlanguageCode\ttypeId\tterm\tcasSignificanceId",
        '101\t20020131\t1\t900000000000207008\t123456789012345\ten\t900000000000003001\t"Quoted" term\t'
        "900000000000448009",
        "102\t20020131\t1\t900000000000207008\t22\ten\t900000000000003001\tplain %-&-%x%-&-%\t1",
    ])
    df = read_descr(spark, path, header=True, quote_mask="%-&-%")
    rows = sorted(df.collect(), key=lambda r: r.id)
    assert rows[0].term == '"Quoted" term' and rows[0].conceptid == 123456789012345
    assert rows[0].typeid == 900000000000003001
    assert rows[1].term == 'plain "x"'
    assert df.schema == schemas.DESCR or [f.name for f in df.schema] == [f.name for f in schemas.DESCR]


def test_copy_text_unescape(spark):
    df = spark.createDataFrame([("a\\tb\\\\c\\nd",)], "t string")
    assert df.select(normalise.copy_text_unescape("t").alias("u")).first().u == "a\tb\\c\nd"


def test_extract_reader_empty_is_null_and_failfast(spark):
    cols = [f.name for f in schemas.BILLDATA.fields]
    good = ["1", "2", "3", "", "V1", "desc", "", "", "1.5", "0"]
    path = _write(["\t".join(good)])
    row = read_billdata(spark, path).first()
    assert row.bepicdxid is None and row.bicd10 is None and row.bhcc == decimal.Decimal("1.500")
    assert len(cols) == len(good)
    bad = _write(["\t".join(["x"] + good[1:])])
    with pytest.raises(Exception):
        read_billdata(spark, bad).collect()


def test_problem_log_reader_timestamps(spark):
    values = {f.name: "" for f in schemas.PLDATA.fields}
    values.update(probid="5", ptid="7", noteddate="2024-01-02 03:04:05", overlen="12")
    path = _write(["\t".join(values[f.name] for f in schemas.PLDATA.fields)])
    row = read_pldata(spark, path).first()
    assert row.probid == 5 and row.noteddate.isoformat() == "2024-01-02T03:04:05" and row.overlen == 12


def test_readers_keep_every_row_of_a_headerless_file(spark):
    line = "{}\t20020131\t1\t9\t22\ten\t900000000000003001\tterm {}\t1"
    path = _write([line.format(i, i) for i in range(3)])
    assert sorted(r.id for r in read_descr(spark, path).collect()) == [0, 1, 2]
    with pytest.raises(Exception):  # a first line that is no header fails instead of going missing
        read_descr(spark, path, header=True).collect()


def test_escapes_and_dates_without_a_time(spark):
    values = {f.name: "" for f in schemas.PLDATA.fields}
    values.update(probid="5", noteddate="2024-01-02", prov_id="1", picd9desc="a\\\\b\\tc\\x41\\101\\q\\303\\251")
    path = _write(["\t".join(values[f.name] for f in schemas.PLDATA.fields)])
    row = read_pldata(spark, path).first()
    assert row.noteddate.isoformat() == "2024-01-02T00:00:00"
    assert row.picd9desc == "a\\b\tcAAq\u00e9"
    for bad in ("01/02/2014 10:00", "2024-13-02"):
        path = _write(["\t".join((values | {"noteddate": bad})[f.name] for f in schemas.PLDATA.fields)])
        with pytest.raises(Exception):
            read_pldata(spark, path).collect()


def test_normalisers(spark):
    df = spark.createDataFrame(
        [("Deleted 2014", "2 WEEKS", "x" * 300 + " (finding)", None, "2024-01-02 03:04:05"),
         ("2.5", "3 WEEKS", "short", "  ", "2024-01-02"),
         ("1.2345", "42", "y", "text", None)],
        "hcc string, age string, term string, note string, t string")
    rows = df.select(normalise.recode_hcc("hcc").alias("h"), normalise.recode_hcc("hcc", None).alias("hb"),
                     normalise.recode_age("age").alias("a"), normalise.shorten("term", 255).alias("s"),
                     normalise.presence_flag("note").alias("p"), normalise.text_length("note").alias("n"),
                     normalise.to_ntz("t").alias("t")).collect()
    assert rows[0].h == decimal.Decimal("0.000") and rows[0].hb is None and rows[0].a == 0.5
    assert len(rows[0].s) == 254 and rows[0].s.endswith("x (finding)") and rows[0].p == 0 and rows[0].n == 0
    assert rows[1].h == decimal.Decimal("2.500") and rows[1].a == 0.75 and rows[1].t.hour == 0
    assert rows[1].p == 1 and rows[1].n == 2  # a cell of blanks is not an empty cell
    assert rows[2].h == decimal.Decimal("1.235") and rows[2].a == 42.0 and rows[2].p == 1 and rows[2].n == 4


@pytest.mark.parametrize("read, bad", [(normalise.recode_hcc, "9.99999x"), (normalise.recode_hcc, "12.5"),
                                       (normalise.recode_age, "old"), (normalise.to_ntz, "01/02/2014 10:00")])
def test_bad_values_fail_or_are_null_on_request(spark, read, bad):
    df = spark.createDataFrame([(bad,)], "v string")
    with pytest.raises(Exception, match="not a"):
        df.select(read("v").alias("x")).collect()
    assert df.select(read("v", strict=False).alias("x")).first().x is None


def test_long_terms_keep_their_semantic_tag(spark):
    from dxlens.plans.terminology import with_semantic_tags

    names = normalise.prepare_terms(spark.createDataFrame([(1, "y" * 300 + " (finding)")], "conceptid long, term string"))
    row = with_semantic_tags(spark.createDataFrame([(1,)], "conceptid long"), names).first()
    assert (row.finding, row.snomedtype) == (1, "finding")


def test_missing_columns_fail_unless_named(spark):
    raw = spark.createDataFrame([(1, "0.25")], "billingid long, bhcc string")
    with pytest.raises(ValueError, match="bepicdxid"):
        normalise.prepare_billing_extract(raw)


def test_prepare_problem_extract(spark):
    raw = spark.createDataFrame([(1, "free text", "", "Deleted 2014", "2024-01-02 03:04:05")],
                                "probid long, probdesc string, overview string, phcc string, noteddate string")
    absent = tuple(f.name for f in schemas.PLDATA.fields)
    row = normalise.prepare_problem_extract(raw, may_be_absent=absent).first()
    assert (row.probdesc, row.overview, row.overlen) == (1, 0, 0)
    assert row.phcc == decimal.Decimal("0.000") and row.noteddate.year == 2024
    assert [f.name for f in normalise.prepare_problem_extract(raw, may_be_absent=absent).schema] == \
        [f.name for f in schemas.PLDATA.fields]


def test_publish_and_materialise(spark):
    root = tempfile.mkdtemp(prefix="dxlens-out-")
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    paths = publish({"t": df}, root)
    assert spark.read.parquet(paths["t"]).count() == 5
    assert materialise(df, "checkpoint").count() == 5
    assert materialise(df, "none") is df
    assert materialise(df, "table").count() == 5


def test_relationship_reader_and_not_null_audit(spark):
    from dxlens.sources import read_relats
    from dxlens.sources.text import not_null_violations

    path = _write([
        "id\teffectiveTime\tactive\tmoduleId\tsourceId\tdestinationId\trelationshipGroup\ttypeId\t"
        "characteristicTypeId\tmodifierId",
        "1\t20020131\t1\t900000000000207008\t22298006\t64572001\t0\t116680003\t900000000000010007\t"
        "900000000000451002",
    ])
    row = read_relats(spark, path, header=True).first()
    assert (row.sourceid, row.destinationid, row.typeid) == (22298006, 64572001, 116680003)
    df = spark.createDataFrame([(1, None), (2, "x")], "id long, term string")
    schema = schemas._schema(("id", schemas.L, False), ("term", schemas.S, False))
    assert not_null_violations(df, schema).count() == 1


def test_prepare_discharge_and_billing_extracts(spark):
    raw_d = spark.createDataFrame([(1, 7, "2 WEEKS", "2024-01-02 03:04:05")],
                                  "dischid long, ptid long, pt_age string, dischdate string")
    d = normalise.prepare_discharge_extract(raw_d, may_be_absent=tuple(f.name for f in schemas.DISCH.fields)).first()
    assert d.pt_age == 0.5 and d.dischdate.day == 2 and d.readmit is None
    raw_b = spark.createDataFrame([(1, "Deleted 2014"), (2, "0.25")], "billingid long, bhcc string")
    got = {r.billingid: r.bhcc for r in normalise.prepare_billing_extract(
        raw_b, may_be_absent=tuple(f.name for f in schemas.BILLDATA.fields)).collect()}
    assert got == {1: None, 2: decimal.Decimal("0.250")}
