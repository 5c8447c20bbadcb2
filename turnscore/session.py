"""Session helpers: a local session for tests and bench, and the shared
scratch folder (``spark.checkpoint.dir``) used to cut lineage and for
round-trip sinks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench. On a cluster use the cluster's session;
    nothing in the library depends on these settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("turnscore")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.ansi.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only in a local session, where the driver is the one machine there is, a
    folder of our own stands in for an unset one (removed when the process
    ends); on a cluster an unset folder is an error, since files written to a
    worker's own disk can't be read by the others."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            d = tempfile.mkdtemp(prefix="turnscore-ckpt-")
            atexit.register(shutil.rmtree, d, ignore_errors=True)
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per session), so they find
    it without an installed wheel or a ``PYTHONPATH`` that reaches it."""
    sc = spark.sparkContext
    if getattr(sc, "_turnscore_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="turnscore-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = shutil.make_archive(os.path.join(folder, "turnscore-package"), "zip", os.path.dirname(here), "turnscore")
    sc.addPyFile(archive)
    sc._turnscore_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """This application's folder inside the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/turnscore/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder, removed with all
    others of the application when the driver ends (:func:`remove_scratch`)."""
    sc = spark.sparkContext
    if not getattr(sc, "_turnscore_scratch", False):
        sc._turnscore_scratch = True
        atexit.register(_remove_quietly, spark)
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote under :func:`scratch_root`; tables read
    from there can't be read any more."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _remove_quietly(spark: SparkSession) -> None:
    """At the driver's end: the context may be stopped already."""
    try:
        if spark.sparkContext._jsc is not None:
            remove_scratch(spark)
    except Exception:  # noqa: BLE001 - nothing is left to talk to
        pass


def sf_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def reliable_checkpoint(df):
    """Cut lineage before expensive or iterative work by writing the rows
    once as a Parquet table in the shared checkpoint folder and reading it
    back. Unlike ``RDD.checkpoint`` (whose file-writing job recomputes the
    lineage unless it is cached) the rows are computed exactly once, and a
    lost executor later re-reads files instead of recomputing (never
    ``localCheckpoint``, whose blocks die with the executor)."""
    spark = df.sparkSession
    path = scratch_path(spark, "materialized")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 * 1024 * 1024) -> dict:
    """Settings for a cluster run sized from the input: shuffle partitions so
    a post-shuffle partition stays near ``target_partition_bytes`` (at least
    two waves of the cluster's cores), the same size for file splits, AQE
    coalescing and skew-join splitting on. Apply with
    ``SparkSession.builder.config(map=...)`` (or ``spark.conf.set`` for the SQL
    ones)."""
    parts = max(2 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
