"""Weather files and landed API payloads."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.clean import nan_to_null

# Payload field of each daily column.
DAILY_FIELDS = {
    "temp_max": "temperature_2m_max", "temp_min": "temperature_2m_min", "temp_avg": "temperature_2m_mean",
    "precip_total": "precipitation_sum", "rain": "rain_sum", "snowfall": "snowfall_sum",
    "wind_speed_max": "wind_speed_10m_max", "wind_gusts_max": "wind_gusts_10m_max", "weather_code": "weather_code",
}
# Payload field of each hourly column.
HOURLY_FIELDS = {
    "temp": "temperature_2m", "precip": "precipitation", "snowfall": "snowfall",
    "wind_speed": "wind_speed_10m", "wind_gusts": "wind_gusts_10m", "weather_code": "weather_code",
}

DAILY_SCHEMA = T.StructType(
    [T.StructField("date", T.DateType()), T.StructField("airport", T.StringType())]
    + [T.StructField(c, T.IntegerType() if c == "weather_code" else T.DoubleType()) for c in DAILY_FIELDS]
)


def _unpack(payloads: DataFrame, section: str, fields: dict, time_name: str, to_time) -> DataFrame:
    values = ", ".join(f"{f}: array<{'int' if f == 'weather_code' else 'double'}>" for f in fields.values())
    body = F.from_json("payload", f"{section} struct<time: array<string>, {values}>")[section]
    zipped = F.arrays_zip(body["time"].alias("time"), *[body[f].alias(c) for c, f in fields.items()])
    rows = payloads.select("airport", F.inline(zipped).alias("time", *fields))
    return rows.select(to_time(F.col("time")).alias(time_name), "airport", *fields)


def parse_daily_payload(payloads: DataFrame) -> DataFrame:
    """Rows (date, airport, ...) of daily payloads (airport, payload JSON of parallel arrays)."""
    return _unpack(payloads, "daily", DAILY_FIELDS, "date", F.to_date)


def parse_hourly_payload(payloads: DataFrame) -> DataFrame:
    """Rows (datetime, airport, ...) of hourly payloads. The time is local and carries no zone."""
    return _unpack(payloads, "hourly", HOURLY_FIELDS, "datetime", F.to_timestamp_ntz)


def pack_payload(rows: DataFrame, section: str, fields: dict, time: str, time_format: str) -> DataFrame:
    """The inverse: one payload per airport, in time order. An airport's arrays are bounded by its calendar."""
    item = F.struct(F.date_format(time, time_format).alias("time"), *[F.col(c).alias(f) for c, f in fields.items()])
    series = rows.groupBy("airport").agg(F.array_sort(F.collect_list(item)).alias("s"))
    arrays = F.struct(*[F.col(f"s.{n}").alias(n) for n in ["time", *fields.values()]])
    return series.select("airport", F.to_json(F.struct(arrays.alias(section)), {"ignoreNullFields": "false"}).alias("payload"))


def scan_weather(spark: SparkSession, path: str, schema=DAILY_SCHEMA) -> DataFrame:
    """Daily weather CSV with a declared schema; NaN texts are missing values."""
    return nan_to_null(spark.read.schema(schema).option("header", True).csv(path))


def missing_keys(expected: DataFrame, landed: DataFrame, keys=("airport",)) -> DataFrame:
    """Expected keys that have no landed row."""
    keys = list(keys)
    return expected.select(*keys).distinct().join(landed.select(*keys), keys, "left_anti")


def keep_first(existing: DataFrame, new: DataFrame, keys=("airport", "date")) -> DataFrame:
    """Union of both with one row per key; the existing row wins.

    The winner is the minimum of (source, row), an aggregate that combines on the map side, so a key with many copies
    is reduced before the shuffle. Equal copies within one source are ordered by their values.
    """
    others = [c for c in existing.columns if c not in keys]
    both = existing.select("*", F.lit(0).alias("_src")).unionByName(
        new.select("*", F.lit(1).alias("_src")), allowMissingColumns=True
    )
    best = both.groupBy(*keys).agg(F.min(F.struct("_src", *others)).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in others])
