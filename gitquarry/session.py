"""Session helpers.

Library code never creates a session on its own; these helpers exist for
tests, the benchmark and the driver entry point.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.ui.retainedJobs": "100000",  # what the status tracker remembers, without any web page
}


def build_session(master: str = "local[8]", app: str = "gitquarry",
                  shuffle_partitions: int = 8, driver_memory: str = "16g",
                  extra: dict | None = None) -> SparkSession:
    """Local session for tests and the benchmark.  On a cluster, the
    submitting tool builds the session and passes it in."""
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Intermediate tables are written there, so it must be a folder that the
    driver and all executors share.  Only when the setting is absent *and* the
    master is local (tests, benchmarks), where every task runs on this machine, is a
    folder of our own set; on a cluster without the setting this is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="gitquarry-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        delete_on_exit(spark, f"file://{configured}")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the
    driver's JVM ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/gitquarry-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    return path


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's JVM remove ``path`` when it ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def materialize(df, how: str | None):
    """Cut or keep a reused intermediate result.

    ``"table"`` writes it as a Parquet table to the shared folder named by
    ``spark.checkpoint.dir``: computed once, a lost executor costs a read, and
    it goes when the driver's JVM ends; ``"checkpoint"`` does so by Spark's
    reliable checkpoint.  Both need that folder (see ``checkpoint_dir``).
    ``"persist"`` caches it in memory and on local disk (recomputed from
    lineage if an executor is lost); ``None`` leaves it to Spark's exchange
    reuse.
    """
    if how is None:
        return df
    if how == "table":
        path = scratch_path(df.sparkSession)
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    if how == "checkpoint":
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    if how == "persist":
        from pyspark import StorageLevel
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    raise ValueError("how must be None, 'persist', 'table' or 'checkpoint'")
