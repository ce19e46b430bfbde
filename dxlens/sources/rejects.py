"""Loading with rejects as a second output.

A line that the declared schema cannot hold does not fail the load: it goes to the
rejects with its file, its text and the reason, and every other line to the
accepted rows.  Both come from one parse, stored once, so no line is in both
or in neither, whatever columns are read later.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dxlens import schemas
from dxlens.sources.normalise import copy_text_unescape
from dxlens.sources.sinks import delete_path, write_table

# table: (schema, text of a NULL)
DIALECTS = {
    "descr": (schemas.DESCR, "\\N"), "relats": (schemas.RELATS, "\\N"),
    "pldata": (schemas.PLDATA, ""), "disch": (schemas.DISCH, ""), "billdata": (schemas.BILLDATA, ""),
}
TIMESTAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_LINE, _FILE, _REASON = "_line", "_file", "_reason"


@dataclass
class Loaded:
    """``accepted`` in the declared schema; ``rejects``: file, line, reason."""

    accepted: DataFrame
    rejects: DataFrame
    path: str

    def release(self) -> None:
        """Delete the stored parse, when both outputs have been used."""
        delete_path(self.accepted.sparkSession, self.path)


def _unreadable(schema: T.StructType, null_value: str) -> Column:
    """Names of the columns whose field has a text but no value, or must have a value and has none."""
    fields = F.split(F.col(_LINE), "\t", -1)
    bad = []
    for i, f in enumerate(schema.fields):
        text = F.get(fields, F.lit(i))
        lost = F.col(f.name).isNull() & (text != null_value)
        missing = F.col(f.name).isNull() & (text == null_value) if not f.nullable else F.lit(False)
        bad.append(F.when(lost, F.lit(f"{f.name}: not a {f.dataType.simpleString()}")).when(missing, F.lit(f"{f.name}: missing")))
    return F.array_join(F.array_compact(F.array(*bad)), "; ")


def load(spark: SparkSession, path, table: str, header: bool = False) -> Loaded:
    """Read the tab-delimited files of ``table`` (a key of ``DIALECTS``), apart by accepted rows and rejects.

    A line is rejected if it has not one field per column, if a field cannot be read as its
    column's type, or if a NOT NULL column has none.  Blank lines are skipped, as the reader does.
    """
    schema, null_value = DIALECTS[table]
    parsed = (spark.read.schema(T.StructType([*[T.StructField(f.name, f.dataType, True) for f in schema.fields],
                                              T.StructField(_LINE, T.StringType())]))
              .option("sep", "\t").option("header", header).option("enforceSchema", not header).option("quote", "")
              .option("nullValue", null_value).option("emptyValue", "" if null_value else None)
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _LINE)
              .option("timestampNTZFormat", "yyyy-MM-dd[ HH:mm:ss][.SSSSSS]").csv(path))
    width = F.size(F.split(F.col(_LINE), "\t", -1))
    required = F.lit(False)
    for f in schema.fields:
        required = required | (F.col(f.name).isNull() if not f.nullable else F.lit(False))
    short = F.concat(F.lit(f"{len(schema.fields)} fields expected, "), width.cast("string"), F.lit(" found"))
    # a line that parses but lacks a required value keeps no text of its own: it is put together from its fields
    rebuilt = F.concat_ws("\t", *[F.coalesce(F.col(f.name).cast("string"), F.lit(null_value)) for f in schema.fields])
    reason = (F.when(F.col(_LINE).isNotNull() & (width != len(schema.fields)), short)
              .when(F.col(_LINE).isNotNull() | required, _unreadable(schema, null_value)))
    stored, where = write_table(
        parsed.withColumn(_FILE, F.col("_metadata.file_path"))
        .withColumn(_LINE, F.when(F.col(_LINE).isNull() & required, rebuilt).otherwise(F.col(_LINE)))
        .withColumn(_REASON, reason), f"loaded-{table}")
    columns = [copy_text_unescape(f.name).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in schema.fields]
    return Loaded(stored.where(F.col(_REASON).isNull()).select(*columns),
                  stored.where(F.col(_REASON).isNotNull()).select(F.col(_FILE).alias("file"), F.col(_LINE).alias("line"),
                                                                 F.col(_REASON).alias("reason")), where)


def write_text(df: DataFrame, path: str, table: str) -> None:
    """Write ``df`` as the tab-delimited text files that :func:`load` and the readers take.

    In a dialect whose NULL is the empty field an empty text becomes NULL, as in the original extracts.
    """
    schema, null_value = DIALECTS[table]

    def encoded(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            for plain, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
                c = F.replace(c, F.lit(plain), F.lit(escaped))
        elif isinstance(f.dataType, T.TimestampNTZType):
            c = F.date_format(c, TIMESTAMP)
        return F.coalesce(c.cast("string"), F.lit(null_value))

    df.select(F.concat_ws("\t", *[encoded(f) for f in schema.fields]).alias("value")).write.mode("overwrite").text(path)
