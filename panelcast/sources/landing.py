"""Outputs that survive a broken run: keyed landing that goes on where it stopped, and versions that are read only when whole.

Both commit by a small manifest, a one-file table that Spark moves into place at the end of its job: what no manifest names
is never read. Nothing is listed or renamed by hand, so any store that Spark writes to will do.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.sources.staging import stage


def _manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The committed entries; none if there is no manifest yet."""
    try:
        return spark.read.schema(schema).json(f"{path}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def landed_keys(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, n_rows) of all keys that are completely landed."""
    return _manifest(spark, path, f"`{key}` string, n_rows long")


def land(expected: DataFrame, fetch: Callable[[DataFrame], DataFrame], path: str, key="airport", batch_keys=1000, max_batches=None) -> int:
    """Fetches the expected keys that are not landed yet and returns how many were.

    ``fetch`` turns a table of keys into their rows. Keys are worked on in batches; a batch's rows replace the folders of its
    keys and are then named in the manifest, also keys without rows. If a run breaks, the next one fetches
    only what no manifest names, and what the broken batch left is replaced. ``max_batches`` ends a run early.
    """
    spark = expected.sparkSession
    known = landed_keys(spark, path, key).select(key)
    wanted = expected.select(F.col(key).cast("string").alias(key)).filter(F.col(key).isNotNull()).distinct()
    pending = stage(wanted.join(known, key, "left_anti"), "pending-keys")
    batches = -(-pending.count() // batch_keys)
    dealt = pending.withColumn("_batch", F.pmod(F.xxhash64(key), F.lit(max(batches, 1))))
    done = 0
    for batch in range(batches if max_batches is None else min(batches, max_batches)):
        keys = stage(dealt.filter(F.col("_batch") == batch).select(key), "batch-keys")
        if keys.isEmpty():
            continue
        rows = stage(fetch(keys).withColumn(key, F.col(key).cast("string")).join(keys, key, "left_semi"), "fetched")
        rows.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(f"{path}/rows")
        counts = keys.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")), key, "left").select(key, F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
        counts.coalesce(1).write.mode("append").json(f"{path}/manifest")  # the commit: a row per key of the batch
        done += keys.count()
    return done


def read_landed(spark: SparkSession, path: str, schema, key="airport") -> DataFrame:
    """Rows of all keys that the manifest names, with the given columns; folders of a broken batch are left out."""
    names = landed_keys(spark, path, key).filter("n_rows > 0").select(key)
    try:
        rows = spark.read.schema(schema).parquet(f"{path}/rows")
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return rows.join(names, key, "left_semi").select(spark.createDataFrame([], schema).columns)


VERSIONS = "version string, section string, n_rows long"


def write_version(sections: dict[str, DataFrame], path: str) -> str:
    """Writes the sections as JSON lines into a new version and then names it in the manifest. Older versions stay."""
    spark = next(iter(sections.values())).sparkSession
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    counts = []
    for name, table in sections.items():
        folder = f"{path}/versions/{version}/{name}"
        table.write.json(folder)
        counts.append((version, name, spark.read.schema(table.schema).json(folder).count()))
    spark.createDataFrame(counts, VERSIONS).coalesce(1).write.mode("append").json(f"{path}/manifest")
    return version


def newest_version(spark: SparkSession, path: str) -> dict[str, str]:
    """Folders by section of the newest whole version."""
    named = _manifest(spark, path, VERSIONS)
    newest = named.agg(F.max("version")).first()[0]
    if newest is None:
        raise FileNotFoundError(f"no whole version below {path}")
    return {r.section: f"{path}/versions/{newest}/{r.section}" for r in named.filter(F.col("version") == newest).collect()}
