"""Broken runs: landing goes on without fetching twice, half-written versions are never read."""

import pytest
from pyspark.sql import functions as F

from panelcast.sources import landing

SCHEMA = "airport string, x int"


def fetcher(spark, asked, fail_on=None):
    """Rows of two per key, remembering every key it was asked for; breaks in the batch that holds ``fail_on``."""

    def fetch(keys):
        names = [r.airport for r in keys.collect()]
        asked.extend(names)
        rows = spark.createDataFrame([(a, i) for a in names for i in (1, 2)], SCHEMA)
        if fail_on in names:
            rows = rows.withColumn("x", F.when(F.col("x") == 2, F.raise_error(F.lit("fetch broke"))).otherwise(F.col("x")))
        return rows

    return fetch


def test_a_broken_landing_resumes_without_fetching_again(spark, tmp_path):
    keys = [f"A{i:02d}" for i in range(20)]
    expected = spark.createDataFrame([(k,) for k in keys + keys + [None]], "airport string")
    path, asked = f"{tmp_path}/w", []
    assert landing.read_landed(spark, path, SCHEMA).count() == 0
    with pytest.raises(Exception, match="fetch broke"):
        landing.land(expected, fetcher(spark, asked, "A13"), path, batch_keys=4)
    done = {r.airport for r in landing.landed_keys(spark, path, "airport").collect()}
    assert "A13" not in done and set(asked) - done and {r.airport for r in landing.read_landed(spark, path, SCHEMA).collect()} == done
    again = []
    assert landing.land(expected, fetcher(spark, again), path, batch_keys=4) == 20 - len(done)
    assert set(again) == set(keys) - done and len(again) == len(set(again))
    rows = sorted(tuple(r) for r in landing.read_landed(spark, path, SCHEMA).collect())
    assert rows == [(k, i) for k in keys for i in (1, 2)]
    assert landing.land(expected, fetcher(spark, again), path) == 0


def test_rows_without_a_commit_are_not_read_and_are_replaced(spark, tmp_path):
    path, asked = f"{tmp_path}/w", []
    expected = spark.createDataFrame([("A",), ("B",)], "airport string")
    landing.land(expected.filter("airport = 'A'"), fetcher(spark, asked), path)
    spark.createDataFrame([("B", 99)], SCHEMA).write.mode("append").partitionBy("airport").parquet(f"{path}/rows")  # broke before its manifest
    assert {r.airport for r in landing.read_landed(spark, path, SCHEMA).collect()} == {"A"}
    landing.land(expected, fetcher(spark, asked), path)
    assert sorted(tuple(r) for r in landing.read_landed(spark, path, SCHEMA).collect()) == [("A", 1), ("A", 2), ("B", 1), ("B", 2)]
    assert asked == ["A", "B"]


def test_a_key_without_rows_is_landed_too(spark, tmp_path):
    path = f"{tmp_path}/w"
    expected = spark.createDataFrame([("A",)], "airport string")
    none = lambda keys: spark.createDataFrame([], SCHEMA)
    assert landing.land(expected, none, path) == 1 and landing.land(expected, none, path) == 0
    assert landing.read_landed(spark, path, SCHEMA).count() == 0


def test_half_written_versions_are_never_read(spark, tmp_path):
    path = f"{tmp_path}/v"
    one = lambda x: spark.createDataFrame([(x,)], "x int")
    read = lambda: [r.x for r in spark.read.schema("x int").json(landing.newest_version(spark, path)["a"]).collect()]
    with pytest.raises(FileNotFoundError):
        landing.newest_version(spark, path)
    landing.write_version({"a": one(1), "b": one(1)}, path)
    broken = one(2).withColumn("x", F.raise_error(F.lit("sink broke")).cast("int"))
    with pytest.raises(Exception, match="sink broke"):
        landing.write_version({"a": one(2), "b": broken}, path)
    assert read() == [1]
    landing.write_version({"a": one(3), "b": one(3)}, path)
    assert read() == [3]
