"""Session settings and small cluster helpers shared by every module."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings for a local session; a cluster brings its own.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tallgrass")
    for key, value in LOCAL_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and the session is local.

    On a cluster a machine's own folder would not do, so there an unset folder is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='tallgrass-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder with checkpoint() and read it from there: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files and checkpoints that nothing refers to any more.

    It acts when the driver's JVM collects garbage. Before that, Python must have
    given up its references, which another thread passes on once a second, and
    the session its last query, which it keeps until the next one has run.
    """
    gc.collect()
    time.sleep(1.2)
    spark.range(1, numPartitions=1).count()
    spark.sparkContext._jvm.System.gc()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def pieces(batch, size: int = 1 << 20):
    """An Arrow batch in slices of at most size bytes, or of one row: what Python makes of a slice is small, however many rows a batch has."""
    if len(batch) < 2 or batch.nbytes <= size:
        yield batch
    else:
        half = len(batch) // 2
        yield from pieces(batch.slice(0, half), size)
        yield from pieces(batch.slice(half), size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below sf_dir, which may be any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
