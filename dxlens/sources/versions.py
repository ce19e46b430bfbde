"""Full refresh that readers never see half done.

A table is a folder of versions.  A refresh writes a whole new version beside the old
ones and then publishes it by creating one empty file in ``_versions`` whose name holds
a rising number and the version's folder; creating a file is atomic on every file
system.  Readers take the highest name, so until that moment they read the version
before, and a refresh that is killed or fails leaves it in place.  Of two refreshes at
once the one with the higher name stands, whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOG = "_versions"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _published(spark: SparkSession, table: str) -> list[tuple[int, str]]:
    """(number, version folder) of every published version, oldest first."""
    folder, fs = _fs(spark, f"{table}/{LOG}")
    if not fs.exists(folder):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if not s.getPath().getName().startswith((".", "_")))
    return [(int(n), version) for n, _, version in (name.partition(".") for name in names)]


def refresh(df: DataFrame, table: str, partition_by: list[str] | None = None) -> str:
    """Replace the whole content of ``table`` by ``df``; returns the new version's folder."""
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{table}/{version}")
    publish_version(spark, table, version)
    return f"{table}/{version}"


def publish_version(spark: SparkSession, table: str, version: str) -> None:
    """The switch: from here on readers take ``version``."""
    last = max((n for n, _ in _published(spark, table)), default=0)
    path, fs = _fs(spark, f"{table}/{LOG}/{last + 1:010d}.{version}")
    fs.create(path, False).close()


def read_current(spark: SparkSession, table: str) -> DataFrame:
    """The latest whole version of ``table``."""
    versions = _published(spark, table)
    if not versions:
        raise FileNotFoundError(f"no version of {table} has been published")
    return spark.read.parquet(f"{table}/{versions[-1][1]}")


def vacuum(spark: SparkSession, table: str, keep: int = 1) -> int:
    """Delete all but the last ``keep`` published versions, and unpublished folders; returns how many folders went.

    Call it when no reader of an older version and no refresh is running.
    """
    versions = _published(spark, table)
    kept = {v for _, v in versions[-keep:]}
    folder, fs = _fs(spark, table)
    gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("v-") and s.getPath().getName() not in kept]
    for n, version in versions[:-keep]:
        path, _ = _fs(spark, f"{table}/{LOG}/{n:010d}.{version}")
        fs.delete(path, False)
    for path in gone:
        fs.delete(path, True)
    return len(gone)
