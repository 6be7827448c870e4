"""Flight and weather views over a TPC-H-like star schema.

The flight view joins fact to fact on keys only; which side is small enough to broadcast is left to the optimizer's
size statistics. Dimension columns nobody asked for are not joined at all: every line item has exactly one part, so
leaving the part join out keeps the rows.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Event type standing for each airport.
EVENT_AIRPORTS = {"click": "AFR", "error": "AME", "purchase": "ASI", "signup": "EUR", "view": "MID"}
SNOW_CODES = [71, 72, 73, 74, 75, 76, 77, 85, 86]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _region_codes(spark, sf_dir):
    """Nation key to region code as one map value (there are 25 nations).

    A lookup instead of a join keeps the optimizer's size estimate of the supplier and customer tables right: it takes
    a join to be as large as the product of its inputs, and would shuffle tables that it can broadcast.
    """
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    codes = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return codes.groupBy().agg(
        F.map_from_entries(F.collect_list(F.struct("n_nationkey", F.substring("r_name", 1, 3))))
    ).scalar()


def flights(spark: SparkSession, sf_dir: str, carrier=True, distance=True, origin=True, dest=True) -> DataFrame:
    """Line items seen as flights, in the columns of a flight file; columns switched off are not joined.

    Every line item has one part, one supplier and one order, so leaving a join out keeps the rows. Customers join the
    orders first, so that the line items are shuffled by order key only, never by customer.
    """
    codes = _region_codes(spark, sf_dir) if origin or dest else None
    cancelled = ((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 46)).cast("int")
    arr = F.when(cancelled == 0, (F.col("l_quantity") - 18) * 1.5)
    out = _table(spark, sf_dir, "lineitem")
    if origin:
        side = _table(spark, sf_dir, "supplier").select("s_suppkey", codes[F.col("s_nationkey")].alias("ORIGIN"))
        out = out.join(side.dropna(), F.col("l_suppkey") == F.col("s_suppkey"))
    if dest:
        side = _table(spark, sf_dir, "customer").select("c_custkey", codes[F.col("c_nationkey")].alias("DEST"))
        orders = _table(spark, sf_dir, "orders").join(side.dropna(), F.col("o_custkey") == F.col("c_custkey"))
        out = out.join(orders.select("o_orderkey", "DEST"), F.col("l_orderkey") == F.col("o_orderkey"))
    if carrier or distance:
        part = _table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
        out = out.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return out.select(
        F.to_date("l_shipdate").alias("FL_DATE"),
        *([F.col("p_brand").alias("REPORTING_AIRLINE")] if carrier else []),
        *(["ORIGIN"] if origin else []),
        *(["DEST"] if dest else []),
        (arr + (F.col("l_discount") - 0.05) * 100).alias("DEP_DELAY"),
        arr.alias("ARR_DELAY"),
        cancelled.alias("CANCELLED"),
        *([(F.col("p_size") * 100).cast("double").alias("DISTANCE")] if distance else []),
        *([F.concat_ws("-", "ORIGIN", "DEST").alias("route")] if origin and dest else []),
    )


def hourly_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events seen as hourly readings (datetime, airport, temp, precip, snowfall, wind_speed, wind_gusts, code)."""
    code = F.get_json_object("props", "$.k").cast("int")
    airport = F.create_map(*[F.lit(x) for pair in EVENT_AIRPORTS.items() for x in pair])[F.col("event_type")]
    return _table(spark, sf_dir, "events").select(
        F.col("ts").alias("datetime"),
        airport.alias("airport"),
        (F.lit(50.0) + F.col("user_id") % 40).alias("temp"),
        (F.col("value") / 50).alias("precip"),
        F.when(code.isin(SNOW_CODES), F.col("value") / 100).otherwise(0.0).alias("snowfall"),
        F.col("value").alias("wind_speed"),
        (F.col("value") * 1.5).alias("wind_gusts"),
        code.alias("weather_code"),
    )


def daily_weather(hourly: DataFrame) -> DataFrame:
    """Raw daily readings of the hourly view, in the columns of the daily weather file."""
    return hourly.groupBy(F.to_date("datetime").alias("date"), "airport").agg(
        F.max("temp").alias("temp_max"),
        F.min("temp").alias("temp_min"),
        F.avg("temp").alias("temp_avg"),
        F.sum("precip").alias("precip_total"),
        F.sum(F.when(F.col("snowfall") == 0, F.col("precip")).otherwise(0.0)).alias("rain"),
        F.sum("snowfall").alias("snowfall"),
        F.max("wind_speed").alias("wind_speed_max"),
        F.max("wind_gusts").alias("wind_gusts_max"),
        (F.sum("weather_code") % 100).cast("int").alias("weather_code"),
    )


def spread_over_calendar(weather: DataFrame, dates: DataFrame) -> DataFrame:
    """Repeat a month of weather over a calendar, by day of month; of several months the last reading counts."""
    values = [c for c in weather.columns if c not in ("airport", "date")]
    month = weather.groupBy("airport", F.dayofmonth("date").alias("dom")).agg(F.max_by(F.struct(*values), "date").alias("w"))
    days = dates.select("date", F.dayofmonth("date").alias("dom"))
    return days.join(month, "dom").select("date", "airport", "w.*")
