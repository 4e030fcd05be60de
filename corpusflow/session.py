"""Session helpers: a local session for tests and benchmarks, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "corpusflow") -> SparkSession:
    """Local session for tests/bench. On a cluster, use the cluster's own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CORPUSFLOW_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is. Only when
    it is unset and the master is local (tests) do we create one of our own.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="corpusflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder (for stream sinks and written tables)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    # one folder per application, which can be removed when the application has ended
    return f"{base}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder of this application that nothing reads any more (other paths are refused)."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/"
    if not path.startswith(base) or ".." in path:
        raise ValueError(f"{path} is not a scratch folder of this application")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def spread(df, min_partitions: int | None = None):
    """Spread rows over the cluster when a scan yields fewer partitions than there are cores.

    Text work (regular expressions, tokenising, scoring) is CPU-bound per row; an input of a few
    large files or row groups would otherwise run on a few tasks. On a large input this is a no-op:
    the scan already has at least as many splits as the cluster has cores, and no shuffle is added.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)


# drops a finished write's shuffle files at once instead of when the driver next collects garbage
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Writes made inside free the shuffles behind them as soon as they have finished."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df, name: str = "table"):
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back; the shuffles behind it are freed.

    Cuts the lineage (a lost executor re-reads files instead of recomputing the plan), runs
    expensive per-row work once for several later jobs, and lets those jobs prune columns (a
    Parquet scan of one id column instead of a recomputation of whole rows).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with freed_shuffles(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
