"""Tab-delimited text readers with declared schemas (operators S2, S3, S4a, S4i).

Two dialects exist in the source system's exports:

* terminology release files (``descr``, ``relats``): tab, ``\\N`` = NULL;
* hospital extracts (``pldata``, ``disch``, ``billdata``): tab, empty field = NULL.

The files carry no header line; ``header=True`` reads files that do, and fails
when the line does not name the declared columns in order.  Quoting is switched
off (``quote=""``): a term that starts with ``"`` is data, not the start of a
quoted field.  Backslash escapes of the bulk-load text format are decoded in every
text column.  A timestamp may lack its time of day (midnight).  ``mode="FAILFAST"``
rejects a malformed row instead of turning it into NULLs, as a bulk load would.  Which
relationship file to read (stated or inferred) is the caller's choice of ``path``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dxlens import schemas
from dxlens.sources.normalise import copy_text_unescape, restore_quotes


def _read(spark: SparkSession, path, schema, null_value: str, header: bool, mode: str,
          unescape: bool = True) -> DataFrame:
    df = (spark.read.schema(schema)
          .option("sep", "\t").option("header", header).option("enforceSchema", not header).option("quote", "")
          .option("nullValue", null_value).option("emptyValue", "" if null_value else None)
          .option("mode", mode)
          .option("timestampNTZFormat", "yyyy-MM-dd[ HH:mm:ss][.SSSSSS]")
          .csv(path))
    if not unescape:
        return df
    return df.select(*[copy_text_unescape(f.name).alias(f.name) if isinstance(f.dataType, T.StringType) else f.name
                       for f in schema.fields])


def read_descr(spark: SparkSession, path, header: bool = False, mode: str = "FAILFAST",
               quote_mask: str | None = None, unescape: bool = True) -> DataFrame:
    """Concept names.  ``quote_mask`` restores ``"`` in exports that masked it."""
    df = _read(spark, path, schemas.DESCR, "\\N", header, mode, unescape)
    return restore_quotes(df, "term", quote_mask) if quote_mask else df


def read_relats(spark: SparkSession, path, header: bool = False, mode: str = "FAILFAST") -> DataFrame:
    """Concept relationships (child ``sourceid`` -> parent ``destinationid``)."""
    return _read(spark, path, schemas.RELATS, "\\N", header, mode)


def read_pldata(spark: SparkSession, path, header: bool = False, mode: str = "FAILFAST") -> DataFrame:
    """Problem-list edit log (empty field = NULL)."""
    return _read(spark, path, schemas.PLDATA, "", header, mode)


def read_disch(spark: SparkSession, path, header: bool = False, mode: str = "FAILFAST") -> DataFrame:
    """Discharges (empty field = NULL)."""
    return _read(spark, path, schemas.DISCH, "", header, mode)


def read_billdata(spark: SparkSession, path, header: bool = False, mode: str = "FAILFAST") -> DataFrame:
    """Billing diagnoses (empty field = NULL)."""
    return _read(spark, path, schemas.BILLDATA, "", header, mode)


def not_null_violations(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows breaking a NOT NULL column of the declared ``schema``, for a data-quality count.

    The schema must be the declared one: a frame read from files says that every column may be null.
    """
    required = [f.name for f in schema.fields if not f.nullable]
    if not required:
        return df.limit(0)
    cond = None
    for name in required:
        c = F.col(name).isNull()
        cond = c if cond is None else cond | c
    return df.where(cond)
