"""Materialisation and published outputs (operators S5, S7, S8)."""

from __future__ import annotations

import atexit
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from dxlens.session import ensure_checkpoint_dir


_CLEANUP_REGISTERED: set[str] = set()


def table_root(spark) -> str:
    """Folder of this application's materialised tables inside the checkpoint folder.

    The folder holds temporaries only (published outputs go elsewhere); it is
    deleted when the driver process exits.
    """
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/dxlens-{spark.sparkContext.applicationId}"
    if root not in _CLEANUP_REGISTERED:
        _CLEANUP_REGISTERED.add(root)
        atexit.register(_delete_quietly, spark, root)
    return root


def _delete_quietly(spark, path: str) -> None:
    try:
        delete_path(spark, path)
    except Exception:  # the session may already be gone at interpreter exit
        pass


def delete_path(spark, path: str) -> bool:
    """Recursively delete ``path`` through the cluster's file system API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, how: str = "table", name: str = "t") -> DataFrame:
    """Compute ``df`` once for reuse and cut its lineage.

    ``table`` writes Parquet into the shared ``spark.checkpoint.dir`` and
    reads it back: later jobs start from stored columns (column pruning and
    exact sizes for the planner) and a lost executor never forces a
    recomputation from the sources.  ``checkpoint`` is the same through
    ``DataFrame.checkpoint`` (row files, no column pruning); ``persist``
    keeps it on the executors (recomputed from lineage on loss); ``none``
    returns the lazy plan unchanged.
    """
    if how == "none":
        return df
    if how == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    spark = df.sparkSession
    if how == "checkpoint":
        ensure_checkpoint_dir(spark)
        return df.checkpoint(eager=True)
    if how == "table":
        return write_table(df, name)[0]
    raise ValueError(f"unknown materialisation {how!r}")


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet under :func:`table_root`; return it read back and its path."""
    spark = df.sparkSession
    path = f"{table_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), path


def publish(tables: dict[str, DataFrame], root: str, mode: str = "overwrite",
            partition_by: dict[str, list[str]] | None = None,
            sort_within: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Write each table as Parquet under ``root/name`` (full refresh by default).

    ``sort_within`` sorts rows inside each output file (the row order the
    original tables were created in, without a global sort).
    """
    paths = {}
    for name, df in tables.items():
        path = f"{root.rstrip('/')}/{name}"
        order = (sort_within or {}).get(name)
        if order:
            df = df.sortWithinPartitions(*order)
        writer = df.write.mode(mode)
        cols = (partition_by or {}).get(name)
        if cols:
            writer = writer.partitionBy(*cols)
        writer.parquet(path)
        paths[name] = path
    return paths
