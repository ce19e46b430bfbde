"""Totally ordered outputs.

A list that people read is written range-partitioned and sorted inside each
partition, so the order runs through the files by name and no task sorts
the whole list.  NULLs stand where the original database puts them: last in
ascending, first in descending order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# orders of the lists that the original script prints; a leading minus is descending
ORDERS = {
    "missing_audit": ("dxlongit", "entrydate"),
    "problems_per_patient": ("-problems", "ptid"),
    "patient_timeline": ("ptid", "pdxid", "noteddate", "entrydate", "probid", "dischid"),
    "subsumed_review": ("-dischid", "-conceptid"),
    "update_activity": ("-tot_updates", "dischid"),
    "edits_outside": ("ptid", "noteddate", "pdxid", "entrydate", "snomed"),
}


def sort_keys(order: Sequence[str | Column]) -> list[Column]:
    """Names (a leading minus: descending) or expressions (ascending) with the original's places of NULL."""
    keys = []
    for o in order:
        if isinstance(o, str) and o.startswith("-"):
            keys.append(F.col(o[1:]).desc_nulls_first())
        else:
            keys.append((F.col(o) if isinstance(o, str) else o).asc_nulls_last())
    return keys


def write_ordered(df: DataFrame, path: str, order: Sequence[str | Column], mode: str = "errorifexists") -> None:
    """Write ``df`` as Parquet files whose names, and rows inside, follow ``order``."""
    keys = sort_keys(order)
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).parquet(path)


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """The rows of :func:`write_ordered` in their order: by file name and place in the file, whatever the sort keys were."""
    df = spark.read.parquet(path)
    return df.orderBy(F.col("_metadata.file_name"), F.col("_metadata.row_index")).select(*df.columns)
