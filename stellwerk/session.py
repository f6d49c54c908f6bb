"""Session settings and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "stellwerk", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on; callers override any setting by name."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        # Recording the Python call site of every column operation dominates plan building.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.files.maxPartitionBytes": "134217728",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Fresh folder below the cluster's checkpoint folder.

    The session names that folder in ``spark.checkpoint.dir``. Only a single-machine session
    may leave it out, and gets a temporary one; on a cluster each executor would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="stellwerk-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/stellwerk-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage so that several consumers share one computation and a lost
    executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
