"""Weather roll-ups and the two-sided weather join."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.config import HOURLY_ROLLUP_COLUMNS, WEATHER_COLUMNS
from panelcast.functions import weather as fw


def process_weather(df: DataFrame) -> DataFrame:
    """Condition, severity and flags of raw daily weather; missing precipitation counts as none."""
    df = df.fillna(0, subset=["precip_total", "rain", "snowfall"])
    df = df.withColumns({"condition": fw.weather_condition("weather_code"), "severity": fw.code_severity("weather_code")})
    return df.withColumns({
        "has_precipitation": fw.flag(F.col("precip_total") > 0.1),
        "has_snow": fw.flag(F.col("snowfall") > 0),
        "is_adverse": fw.flag(F.col("severity") >= 3),
        "temp_range": F.col("temp_max") - F.col("temp_min"),
    })


def hourly_to_daily(hourly: DataFrame) -> DataFrame:
    """Daily features of hourly weather in one conditional aggregate; a day needs a reading in operating hours."""
    hour, severity = F.hour("datetime"), fw.code_severity("weather_code")
    # Hours of the operating day, the morning and the evening, inclusive.
    operating, morning, evening = hour.between(6, 23), hour.between(5, 10), hour.between(16, 21)
    out = hourly.groupBy("airport", F.to_date("datetime").alias("date")).agg(
        F.max(F.when(operating, F.col("wind_speed"))).alias("peak_wind_operating"),
        F.sum(F.when(operating, F.col("precip"))).alias("precip_operating"),
        F.max(severity).alias("max_hourly_severity"),
        F.count_if(severity >= 4).alias("storm_hours"),
        F.max(F.when(morning, severity)).alias("morning_severity"),
        F.max(F.when(evening, severity)).alias("evening_severity"),
        F.count_if(operating).alias("_operating"),
    )
    return out.filter("_operating > 0").drop("_operating").fillna(0, subset=HOURLY_ROLLUP_COLUMNS)


def merge_hourly_into_daily(daily: DataFrame, rollup: DataFrame) -> DataFrame:
    """Daily weather with fresh hourly features; earlier ones are replaced, unmatched ones are 0."""
    base = daily.drop(*HOURLY_ROLLUP_COLUMNS)
    fresh = rollup.select("airport", "date", *HOURLY_ROLLUP_COLUMNS)
    return base.join(fresh, ["airport", "date"], "left").fillna(0, subset=HOURLY_ROLLUP_COLUMNS)


def join_weather_two_sided(panel: DataFrame, weather: DataFrame, columns=WEATHER_COLUMNS) -> DataFrame:
    """Panel with the weather of both ends of each route, prefixed ``apt1_`` and ``apt2_``.

    A weather table with two rows for an airport and day is an error, as it would multiply panel rows. It is broadcast
    when its measured size allows, and shuffled otherwise; that choice is the optimizer's.
    """
    once = weather.groupBy("airport", "date").agg(F.any_value(F.struct(*columns)).alias("w"), F.count(F.lit(1)).alias("n"))
    twice = F.raise_error(F.concat(F.lit("two weather rows: "), "airport", F.lit(" "), F.col("date").cast("string")))
    weather = once.withColumn("date", F.when(F.col("n") == 1, F.col("date")).otherwise(twice.cast("date"))).select("airport", "date", "w.*")
    parts = F.split("route", "-")
    out = panel.withColumns({"_a1": parts[0], "_a2": parts[1]})
    for n in (1, 2):
        side = weather.select(
            F.col("date").alias(f"_d{n}"), F.col("airport").alias(f"_k{n}"),
            *[F.col(c).alias(f"apt{n}_{c}") for c in columns],
        )
        match = (F.col("date") == F.col(f"_d{n}")) & (F.col(f"_a{n}") == F.col(f"_k{n}"))
        out = out.join(side, match, "left").drop(f"_d{n}", f"_k{n}", f"_a{n}")
    return out


def weather_pair_features(df: DataFrame) -> DataFrame:
    """Both ends combined: worst severity and wind, mean severity, summed precipitation, hourly features."""
    worst = ["peak_wind_operating", "max_hourly_severity", "morning_severity", "evening_severity"]
    summed = ["precip_operating", "storm_hours"]
    adverse = [F.coalesce(F.col(f"apt{n}_is_adverse") == 1, F.lit(False)) for n in (1, 2)]
    return df.withColumns({
        "weather_severity_max": fw.row_max("apt1_severity", "apt2_severity"),
        "weather_severity_combined": fw.row_mean("apt1_severity", "apt2_severity"),
        "has_adverse_weather": fw.flag(adverse[0] | adverse[1]),
        "total_precip": fw.null_safe_sum("apt1_precip_total", "apt2_precip_total"),
        "total_snowfall": fw.null_safe_sum("apt1_snowfall", "apt2_snowfall"),
        "max_wind": fw.row_max("apt1_wind_speed_max", "apt2_wind_speed_max"),
        **{c: fw.row_max(f"apt1_{c}", f"apt2_{c}") for c in worst},
        **{c: fw.null_safe_sum(f"apt1_{c}", f"apt2_{c}") for c in summed},
    })


def merge_weather(panel: DataFrame, weather: DataFrame) -> DataFrame:
    return weather_pair_features(join_weather_two_sided(panel, weather))


def match_rate(df: DataFrame, column="apt1_severity") -> DataFrame:
    """Share of rows with matched weather, in percent."""
    return df.agg((F.avg(F.col(column).isNotNull().cast("double")) * 100).alias("match_rate"))


def severe_share(weather: DataFrame, by: str, level=3) -> DataFrame:
    """Percent of days at or above a severity, per month or airport."""
    key = F.month("date").alias("month") if by == "month" else F.col(by)
    share = F.avg(F.when(F.col("severity") >= level, 100.0).otherwise(0.0))
    return weather.groupBy(key).agg(share.alias("severe_pct"))


def severe_share_summary(weather: DataFrame, level=3) -> DataFrame:
    """Mean of the monthly shares: all months, December to February, June to August."""
    monthly = severe_share(weather, "month", level)
    return monthly.agg(
        F.avg("severe_pct").alias("all_months"),
        F.avg(F.when(F.col("month").isin(12, 1, 2), F.col("severe_pct"))).alias("winter"),
        F.avg(F.when(F.col("month").isin(6, 7, 8), F.col("severe_pct"))).alias("summer"),
    )
