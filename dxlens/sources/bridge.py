"""Deterministic projections of the shared test tables onto the five inputs.

The test tables hold no clinical data.  Each input is derived from one of them
by a fixed rule (stated once here and mirrored in :mod:`dxlens.oracle` for the
SQL side), so that every job's work grows with the test tables.

* ``descr``  from ``part``: five row sets per part key (latest name with ties,
  an inactive later version, a synonym row of another type).
* ``relats`` from ``part``: two is-a edges per key > 0, to key/3 (inactive when
  key % 19 = 0) and to key/5.
  With ``chains``, besides, for every part key a node :data:`CHAIN_BASE` + key below the node of
  key - 1, or, where key % 40 = 0, below concept key/40: chains 40 levels deep that nothing shortens.
* ``pldata`` from ``events``: one edit per event.
* ``disch``  from ``orders``: one stay per order.
* ``billdata`` from ``lineitem`` joined to ``orders``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dxlens import schemas
from dxlens.functions.temporal import ts_literal
from dxlens.operators.dyadic import PLAIN_ROWS, plain_partitions

# Fixed values of the test projection.
FSN_TYPE = 900000000000003001        # fully specified name
SYNONYM_TYPE = 900000000000013009    # synonym
ISA_TYPE = 116680003                 # is-a relationship
MODULE = 900000000000207008
CASE_SIGNIFICANCE = 900000000000448009
STATED = 900000000000010007
MODIFIER = 900000000000451002
# Semantic tag per part type; any other type gets "regime/therapy".
TAG_BY_TYPE = [("PROMO", "finding"), ("ECONOMY", "disorder"), ("MEDIUM", "procedure"),
               ("SMALL", "situation"), ("LARGE", "organism")]
OTHER_TAG = "regime/therapy"
NOTED_BASE = "2023-12-29 00:00:00"
ADMIT_BASE = "2024-01-01 08:00:00"
DISCH_BASE = "2024-01-01 15:00:00"
READMIT_BASE = "2024-01-01 09:00:00"
STUDY_END = "2024-06-06"
CHAIN_BASE = 1_000_000_000_000
CHAIN_LENGTH = 40

# narrow rows of both sides in a partition of the join that makes the bills
BILL_ROWS = 10 * PLAIN_ROWS

TABLES = ("part", "events", "orders", "lineitem")


def _days(n) -> F.Column:
    return F.make_dt_interval(days=n.cast("int"))


def descr_from_part(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    tag = None
    for ptype, label in TAG_BY_TYPE:
        cond = F.col("p_type") == ptype
        tag = F.when(cond, label) if tag is None else tag.when(cond, label)
    fsn = F.concat(F.col("p_name"), F.lit(" ("), tag.otherwise(OTHER_TAG), F.lit(")"))

    def variant(n, when, et, active, typeid, term):
        return F.struct(F.lit(n).alias("n"), when.alias("keep"), F.lit(et).alias("et"),
                        F.lit(active).alias("active"), F.lit(typeid).cast("long").alias("typeid"),
                        term.alias("term"))

    variants = F.array(
        variant(1, F.lit(True), "20020131", 1, FSN_TYPE, fsn),
        variant(2, key % 3 == 0, "20100131", 1, FSN_TYPE, fsn),
        variant(3, key % 33 == 0, "20100131", 1, FSN_TYPE, fsn),
        variant(4, key % 7 == 0, "20120131", 0, FSN_TYPE, fsn),
        variant(5, F.lit(True), "20020131", 1, SYNONYM_TYPE, F.col("p_name")),
    )
    rows = part.select(key, F.explode(variants).alias("v")).where(F.col("v.keep"))
    return schemas.conform(rows.select(
        (key * 10 + F.col("v.n")).alias("id"), F.col("v.et").alias("effectivetime"),
        F.col("v.active").alias("active"), F.lit(MODULE).alias("moduleid"), key.alias("conceptid"),
        F.lit("en").alias("languagecode"), F.col("v.typeid").alias("typeid"), F.col("v.term").alias("term"),
        F.lit(CASE_SIGNIFICANCE).alias("cassignificanceid")), schemas.DESCR)


def relats_from_part(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    edges = F.array(
        F.struct(F.lit(1).alias("n"), F.floor(key / 3).alias("parent"),
                 F.when(key % 19 == 0, 0).otherwise(1).alias("active")),
        F.struct(F.lit(2).alias("n"), F.floor(key / 5).alias("parent"), F.lit(1).alias("active")),
    )
    rows = part.where(key > 0).select(key, F.explode(edges).alias("e"))
    return schemas.conform(rows.select(
        (key * 10 + F.col("e.n")).alias("id"), F.lit("20020131").alias("effectivetime"),
        F.col("e.active").alias("active"), F.lit(MODULE).alias("moduleid"), key.alias("sourceid"),
        F.col("e.parent").alias("destinationid"), F.lit(0).alias("relationshipgroup"),
        F.lit(ISA_TYPE).alias("typeid"), F.lit(STATED).alias("characteristictypeid"),
        F.lit(MODIFIER).alias("modifierid")), schemas.RELATS)


def chains_from_part(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey").cast("long")
    parent = F.when(key % CHAIN_LENGTH == 0, F.floor(key / CHAIN_LENGTH)).otherwise(key - 1 + CHAIN_BASE)
    return schemas.conform(part.select(
        (key * 10 + 3).alias("id"), F.lit("20020131").alias("effectivetime"), F.lit(1).alias("active"),
        F.lit(MODULE).alias("moduleid"), (key + CHAIN_BASE).alias("sourceid"), parent.alias("destinationid"),
        F.lit(0).alias("relationshipgroup"), F.lit(ISA_TYPE).alias("typeid"),
        F.lit(STATED).alias("characteristictypeid"), F.lit(MODIFIER).alias("modifierid")), schemas.RELATS)


def pldata_from_events(events: DataFrame) -> DataFrame:
    e, ts = F.col("event_id"), F.col("ts")
    overlen = e % 50
    return schemas.conform(events.select(
        e.alias("probid"), F.col("user_id").alias("ptid"), F.lit(None).alias("dischid"),
        (e + 700000000).alias("csn"), (F.col("user_id") + 500000).alias("mrn"),
        F.lit(None).cast("timestamp_ntz").alias("admitdate"),
        F.when(e % 53 != 0, e % 40).alias("snomed"), F.when(e % 41 != 0, e % 5).alias("pdxid"),
        F.col("event_type").alias("picd9"), F.lit(None).cast("string").alias("picd10"),
        (e % 10).cast("decimal(4,3)").alias("phcc"), (e % 2).alias("probdesc"),
        F.col("event_type").alias("picd9desc"), F.lit(None).cast("string").alias("picd10desc"),
        F.when(e % 37 != 0, ts_literal(NOTED_BASE) + _days(e % 3)).alias("noteddate"),
        ts.alias("entrydate"),
        F.when(e % 7 == 1, ts + _days(e % 9)).alias("deldate"),
        F.when(e % 6 == 0, ts + _days(e % 13)).alias("resoldate"),
        F.lit(None).cast("int").alias("dischprob"), F.lit(None).cast("int").alias("ptobmatch"),
        (overlen > 0).cast("int").alias("overview"), overlen.alias("overlen"), (e % 2).alias("hospprob"),
        F.when(e % 3 == 0, F.lit("High")).alias("priority"),
        F.when(e % 17 != 0, e % 23).alias("prov_id"),
        F.lit("Physician").alias("provtype"), F.lit("General Medicine").alias("provdept")),
        schemas.PLDATA)


def disch_from_orders(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    start, los, gap = k % 25, k % 6, k % 60
    return schemas.conform(orders.select(
        k.alias("dischid"), F.col("o_custkey").alias("ptid"), (k + 10000000).alias("csn"),
        (F.col("o_custkey") + 500000).alias("mrn"), (k % 90).alias("pt_age"), (k % 2).alias("pt_gender"),
        (k % 3 == 0).cast("int").alias("adm_ed"), (k % 3 == 1).cast("int").alias("adm_sched"),
        F.col("o_orderpriority").alias("department"), F.col("o_orderstatus").alias("service"),
        (ts_literal(DISCH_BASE) + _days(start + los)).alias("dischdate"),
        (ts_literal(ADMIT_BASE) + _days(start)).alias("admitdate"),
        los.alias("los"), (k % 3).alias("losicu"), (k % 4).alias("transfers"),
        (k % 5 + 1).alias("specialties"), (k % 7).alias("pews_peak"), ((k % 70) / 10.0).alias("pews_mean"),
        F.when(k % 4 == 0, ts_literal(READMIT_BASE) + _days(start + los + gap)).alias("readmit"),
        (k % 8).alias("opvisits"), (k % 9).alias("ipvisits"), F.col("o_orderstatus").alias("soi"),
        F.col("o_orderpriority").alias("rom"), (k % 100).alias("cc_time")), schemas.DISCH)


def bill_partitions(lineitem: DataFrame, orders: DataFrame) -> int | None:
    """Partitions that the rows behind the bills fill; None where one is enough.  Counted from the files' footers."""
    rows = lineitem.count() + orders.count()
    return plain_partitions(lineitem.sparkSession, rows * PLAIN_ROWS // BILL_ROWS) if rows > 2 * BILL_ROWS else None


def billdata_from_lineitem(lineitem: DataFrame, orders: DataFrame, partitions: int | None = None) -> DataFrame:
    """``partitions``: both sides are dealt into so many, as narrow rows pack so well that they would be merged into few."""
    li = lineitem.select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")
    o = orders.select("o_orderkey", "o_custkey")
    if partitions:
        li, o = li.repartition(partitions, "l_orderkey"), o.repartition(partitions, "o_orderkey")
    joined = li.join(o, li.l_orderkey == o.o_orderkey)
    pk = F.col("l_partkey")
    return schemas.conform(joined.select(
        F.lit(None).cast("long").alias("billingid"), F.col("o_custkey").alias("ptid"),
        F.col("l_orderkey").alias("dischid"), F.when(pk % 41 != 0, pk % 7).alias("bepicdxid"),
        F.col("l_linestatus").alias("bicd9"), F.col("l_returnflag").alias("bicd9desc"),
        F.lit(None).cast("string").alias("bicd10"), F.lit(None).cast("string").alias("bicd10desc"),
        F.lit(None).cast("decimal(4,3)").alias("bhcc"), F.lit(None).cast("int").alias("btopmatch")),
        schemas.BILLDATA)


def load_bridge(spark: SparkSession, sf_dir: str, chains: bool = False, bills: bool = True) -> dict[str, DataFrame]:
    """The five inputs derived from the test tables under ``sf_dir``; ``chains`` adds deep is-a chains.

    ``bills``: whether the bills are read, and so worth a count of the rows that they are joined from.
    """
    src = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    relats = relats_from_part(src["part"])
    if chains:
        relats = relats.unionByName(chains_from_part(src["part"]))
    return {
        "descr": descr_from_part(src["part"]),
        "relats": relats,
        "pldata": pldata_from_events(src["events"]),
        "disch": disch_from_orders(src["orders"]),
        "billdata": billdata_from_lineitem(src["lineitem"], src["orders"],
                                           bill_partitions(src["lineitem"], src["orders"]) if bills else None),
    }
