"""Small hand-made frames with the declared input schemas."""

from dxlens import schemas


def frame(spark, schema, rows):
    """DataFrame of ``schema`` from dicts; missing columns are NULL."""
    names = [f.name for f in schema.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def pldata(spark, rows):
    return frame(spark, schemas.PLDATA, rows)


def disch(spark, rows):
    return frame(spark, schemas.DISCH, rows)


def descr(spark, rows):
    base = {"effectivetime": "20020131", "active": 1, "moduleid": 1, "languagecode": "en",
            "typeid": 900000000000003001, "cassignificanceid": 1}
    return frame(spark, schemas.DESCR, [{**base, **r} for r in rows])


def relats(spark, edges, active=1, typeid=116680003):
    rows = [{"id": i, "effectivetime": "20020131", "active": active, "moduleid": 1, "sourceid": c,
             "destinationid": p, "relationshipgroup": 0, "typeid": typeid, "characteristictypeid": 1,
             "modifierid": 1} for i, (c, p) in enumerate(edges)]
    return frame(spark, schemas.RELATS, rows)


def billdata(spark, rows):
    return frame(spark, schemas.BILLDATA, rows)
