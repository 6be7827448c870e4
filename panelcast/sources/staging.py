"""Intermediate tables in the cluster's shared scratch folder.

A table that several branches of a job read is written once as Parquet and read back: the expensive scan below it runs
once, later reads prune columns and have real size statistics, and a lost executor re-reads files, not the lineage.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs = {}


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; on a local master without one, a temporary folder."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="panelcast-")
    return _local_dirs[sc.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder, grouped by application so that a finished one can be dropped whole."""
    return f"{scratch_root(spark)}/panelcast/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write the frame once and return it as a Parquet scan."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the staged tables of this application. Call it once the results that read them are stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/panelcast/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
