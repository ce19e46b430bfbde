"""Declared schemas of the five inputs (operator S1).

Long ids stay ``LongType`` end to end: terminology ids reach 18 digits and must
never pass through a double.  Timestamps are ``timestamp_ntz`` (wall-clock
times without zone, as in the source system).
"""

from __future__ import annotations

from pyspark.sql import types as T

L, I, S, D = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()
TS = T.TimestampNTZType()
HCC = T.DecimalType(4, 3)


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, nullable) for name, dtype, nullable in fields])


# Versioned concept names; primary key (id, effectivetime).
DESCR = _schema(
    ("id", L, False), ("effectivetime", S, False), ("active", I, False), ("moduleid", L, False),
    ("conceptid", L, False), ("languagecode", S, False), ("typeid", L, False), ("term", S, False),
    ("cassignificanceid", L, False),
)

# Versioned concept-to-concept edges, child ``sourceid`` -> parent ``destinationid``.
RELATS = _schema(
    ("id", L, False), ("effectivetime", S, False), ("active", I, False), ("moduleid", L, False),
    ("sourceid", L, False), ("destinationid", L, False), ("relationshipgroup", I, False),
    ("typeid", I, False), ("characteristictypeid", L, False), ("modifierid", L, False),
)

# Problem-list edit log: one row per edit; only probid is required.
PLDATA = _schema(
    ("probid", L, False), ("ptid", L, True), ("dischid", L, True), ("csn", L, True), ("mrn", L, True),
    ("admitdate", TS, True), ("snomed", L, True), ("pdxid", L, True), ("picd9", S, True),
    ("picd10", S, True), ("phcc", HCC, True), ("probdesc", I, True), ("picd9desc", S, True),
    ("picd10desc", S, True), ("noteddate", TS, True), ("entrydate", TS, True), ("deldate", TS, True),
    ("resoldate", TS, True), ("dischprob", I, True), ("ptobmatch", I, True), ("overview", I, True),
    ("overlen", I, True), ("hospprob", I, True), ("priority", S, True), ("prov_id", L, True),
    ("provtype", S, True), ("provdept", S, True),
)

# Hospital discharges.
DISCH = _schema(
    ("dischid", L, True), ("ptid", L, True), ("csn", L, True), ("mrn", L, True), ("pt_age", D, True),
    ("pt_gender", I, True), ("adm_ed", I, True), ("adm_sched", I, True), ("department", S, True),
    ("service", S, True), ("dischdate", TS, True), ("admitdate", TS, True), ("los", I, True),
    ("losicu", I, True), ("transfers", I, True), ("specialties", I, True), ("pews_peak", I, True),
    ("pews_mean", D, True), ("readmit", TS, True), ("opvisits", I, True), ("ipvisits", I, True),
    ("soi", S, True), ("rom", S, True), ("cc_time", I, True),
)

# Billing diagnoses.
BILLDATA = _schema(
    ("billingid", L, True), ("ptid", L, True), ("dischid", L, True), ("bepicdxid", L, True),
    ("bicd9", S, True), ("bicd9desc", S, True), ("bicd10", S, True), ("bicd10desc", S, True),
    ("bhcc", HCC, True), ("btopmatch", I, True),
)

INPUTS = {"descr": DESCR, "relats": RELATS, "pldata": PLDATA, "disch": DISCH, "billdata": BILLDATA}


def conform(df, schema: T.StructType):
    """Project ``df`` onto ``schema`` by name, casting each column (operator S6)."""
    from pyspark.sql import functions as F

    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
