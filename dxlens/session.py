"""Session construction and checkpoint-directory handling."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on.  AQE re-plans joins from runtime sizes
# (broadcast only when the shuffled side is measured small, skewed partitions
# split); the session time zone is pinned so that day truncation of
# timestamp_ntz values never depends on the host.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # target shuffle partition size once AQE coalesces (large clusters)
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # remove RDD checkpoint files (closure levels) once nothing references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


LOCAL_DRIVER_MEMORY = "16g"


def get_session(master: str | None = None, app_name: str = "dxlens",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Return a session with :data:`DEFAULT_CONF` applied.

    On a cluster pass ``master=None`` and let the launcher decide; tests pass
    ``local[N]`` and a small ``shuffle_partitions``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            builder = builder.config("spark.driver.memory", LOCAL_DRIVER_MEMORY)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make ``DataFrame.checkpoint()`` write to the cluster's shared folder.

    The folder is read from ``spark.checkpoint.dir``.  Only when that is unset
    and the master is local (tests, laptops) is a private temporary folder
    created; on a cluster an unset value is an error, because a machine-local
    folder would not survive the loss of that machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="dxlens-ckpt-"))
    return sc.getCheckpointDir()
