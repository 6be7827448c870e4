"""Panel, feature and report tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.clean import nan_to_null


def write_panel(df: DataFrame, path: str, fmt="parquet", partition="route", order="date") -> None:
    """One folder per route, each written by one task (a route has at most one row per calendar day)."""
    writer = df.repartition(partition).sortWithinPartitions(partition, order).write.mode("error").partitionBy(partition)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def read_panel(spark: SparkSession, path: str, schema=None, fmt="parquet") -> DataFrame:
    """Panel or feature table, NaN as null; a filter on route prunes folders, the columns used prune the rest."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return nan_to_null((reader.schema(schema) if schema is not None else reader).load(path))


def profile_table(df: DataFrame, key="route", date="date") -> DataFrame:
    """Row count, distinct keys, date span and per-column null counts, in long form (name, value as text).

    Keys are counted after a group-by, so that no task holds them all.
    """
    nulls = [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in df.columns]
    per_key = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"), F.min(date).alias("lo"), F.max(date).alias("hi"), *nulls
    )
    totals = per_key.agg(
        F.sum("rows").alias("rows"),
        F.count(key).alias("distinct_keys"),
        F.min("lo").alias("first_date"),
        F.max("hi").alias("last_date"),
        *[F.sum(f"nulls_{c}").alias(f"nulls_{c}") for c in df.columns],
    )
    items = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in totals.columns])
    return totals.select(F.inline(items))
