"""Shared helpers: scratch tables and files in the cluster's shared folder, Arrow rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dxlens.sources.sinks import delete_path, table_root

# [\x20\x09-\x0D], the white space of every operator; bytes.split() and
# bytes.lower() without arguments use exactly these bytes and exactly A-Z.
WHITE = b" \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_RECORDERS: list[list["Scratch"]] = []


class Scratch:
    """Temporary tables and files of one operator call.

    They live in a folder of their own below the folder that the session names
    in ``spark.checkpoint.dir``, so every executor and the driver see them and
    a lost executor only re-reads them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{_with_authority(table_root(spark))}/{name}-{uuid.uuid4().hex}"
        for made in _RECORDERS:
            made.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back: one computation, no lineage."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete_path(self.spark, self.path(name))

    def release(self) -> None:
        delete_path(self.spark, self.root)


@contextmanager
def recording() -> Iterator[list[Scratch]]:
    """Collects the scratch folders made inside the block."""
    made: list[Scratch] = []
    _RECORDERS.append(made)
    try:
        yield made
    finally:
        _RECORDERS.remove(made)


def _with_authority(uri: str) -> str:
    """``file:/x`` -> ``file:///x``; plain paths get the ``file`` scheme."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        return "file://" + uri[len("file:"):]
    return "file://" + uri if uri.startswith("/") else uri


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, usable on the driver and in tasks."""
    return fs.FileSystem.from_uri(uri)


class TaskFile:
    """A file written by one task under a name of its own.

    Every attempt of a task writes another file; only the rows of the attempt
    that Spark commits name their file, so files of retried or speculative
    attempts are never read.
    """

    def __init__(self, folder: str, prefix: str, suffix: str = ""):
        self.uri = f"{folder}/{prefix}-{uuid.uuid4().hex}{suffix}"
        self.fs, path = open_fs(self.uri)
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(path, compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        """Append ``data``; returns the offset at which it starts."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.out.close()


class RangeReader:
    """Reads byte ranges of files by URI, keeping the last file open."""

    def __init__(self):
        self.uri, self.file = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            self.close()
            filesystem, path = open_fs(uri)
            self.uri, self.file = uri, filesystem.open_input_file(path)
        self.file.seek(offset)
        return self.file.read(length)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.uri, self.file = None, None


def utf8(column: str = "text") -> F.Column:
    """The text's UTF-8 bytes: tasks then skip decoding."""
    return F.col(column).cast("binary")


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096, max_bytes: int = 32 << 20,
            weigh: int | None = None) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows; ``weigh`` names the column whose bytes also bound a batch."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        if weigh is not None:
            weight += len(row[weigh] or b"")
        if len(held) >= size or weight >= max_bytes:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as it needs to differ from every column."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keys_joined(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Equi-join in which null keys match each other; ``on`` columns come from the left."""
    keys = free_names([*left.columns, *right.columns], *on)
    renamed = right.select(*[F.col(c).alias(keys[on.index(c)]) if c in on else F.col(c) for c in right.columns])
    cond = None
    for c, key in zip(on, keys):
        test = left[c].eqNullSafe(renamed[key])
        cond = test if cond is None else cond & test
    return left.join(renamed, cond, how).drop(*keys)


def running_totals(df: DataFrame, order: list, weight: str, scratch: Scratch, name: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``weight`` over all rows that come earlier in the order.

    The rows are range-partitioned and stored with their partition number; the totals of
    the partitions (one row each) are summed up on the driver, and a window inside
    each partition adds the rest, so no task sees more than one partition.
    """
    spark = df.sparkSession
    dealt = scratch.table(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    before, so_far = [], 0
    for part, total in sorted(dealt.groupBy("_part").agg(F.sum(weight)).collect()):
        before.append((part, so_far))
        so_far += total or 0
    starts = spark.createDataFrame(before, "_part int, _start long")
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (dealt.join(F.broadcast(starts), "_part")
            .withColumn("before", F.col("_start") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
            .drop("_part", "_start"))
