"""Shared inputs of the registered queries. Each call rebuilds them from the given tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.config import STUDY, TARGET, Fold, shift_years
from panelcast.functions.calendar import day
from panelcast.operators import baselines as ob
from panelcast.operators import evaluation as oe
from panelcast.operators import weather as ow
from panelcast.plans.features import build_features
from panelcast.plans.panel import build_panel, build_weather
from panelcast.sources import starschema
from panelcast.sources.staging import stage

CUT = shift_years(STUDY, -24)
#: The folds of the study and one whose test slice overlaps the first two.
OVERLAPPING = (*CUT.folds, Fold(5, "1999-01-01", "1999-04-01", "1999-04-01", "1999-09-30"))
#: Carriers that reports leave out.
EXCLUDED_CARRIERS = ["Brand#11", "Brand#1", "Brand#2", "Brand#3"]
HOLIDAY_YEARS = (1995, 2002)
#: Routes of the panel, as the library's default; ``TOP_ROUTES`` is the k of the queries that are about the busiest few.
N_ROUTES = 50
TOP_ROUTES = 10
DIGITS = 6
MODELS = ["naive", "seasonal_7", "ma_7", "ma_14", "ma_28"]


def edge(df: DataFrame) -> DataFrame:
    """Doubles rounded for comparison between engines, whose sums differ in the last bits."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            c = F.round(c, DIGITS) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return starschema.flights(spark, sf_dir)


def delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights without carrier and distance, which most reports do not need."""
    return starschema.flights(spark, sf_dir, carrier=False, distance=False)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel as one plan over the staged daily table; queries that read it more than once stage it."""
    return build_panel(delays(spark, sf_dir), N_ROUTES)


def staged_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(panel(spark, sf_dir), "panel")


def month_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily weather of the one month of readings, staged: one row per airport and day."""
    hourly = starschema.hourly_weather(spark, sf_dir)
    return stage(build_weather(starschema.daily_weather(hourly), hourly), "weather")


def carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights of which only the carrier counts: no orders, customers or suppliers."""
    return starschema.flights(spark, sf_dir, distance=False, origin=False, dest=False)


def flight_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with a flight, from the line items alone."""
    bare = starschema.flights(spark, sf_dir, carrier=False, distance=False, origin=False, dest=False)
    return bare.select(F.col("FL_DATE").alias("date")).distinct()


def weather_over(spark: SparkSession, sf_dir: str, days: DataFrame) -> DataFrame:
    """The month of weather repeated over the days from the first to the last of a table."""
    span = days.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    dates = span.select(F.explode(F.sequence("first", "last")).alias("date"))
    return starschema.spread_over_calendar(month_weather(spark, sf_dir), dates)


def calendar_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month of weather over the flight days."""
    return weather_over(spark, sf_dir, flight_days(spark, sf_dir))


def weather_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged_panel(spark, sf_dir)
    return stage(ow.merge_weather(rows, weather_over(spark, sf_dir, rows)), "weather-panel")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_features(weather_panel(spark, sf_dir), CUT, HOLIDAY_YEARS)


def baseline_models() -> dict:
    return {
        "naive": ob.naive(),
        "seasonal_7": ob.seasonal_naive(),
        "ma_7": ob.moving_average(window=7),
        "ma_14": ob.moving_average(window=14),
        "ma_28": ob.moving_average(window=28),
    }


def wide_predictions(base: DataFrame) -> DataFrame:
    """(route, date, actual, one column per baseline) over the test period."""
    models = baseline_models()
    full = ob.predict(base.select("route", "date", TARGET), models)
    return full.filter(F.col("date") >= day(CUT.test_start)).withColumnRenamed(TARGET, "actual")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long predictions of all baselines over the test period."""
    return ob.to_long(wide_predictions(panel(spark, sf_dir)), MODELS)


def staged_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(predictions(spark, sf_dir), "preds")


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oe.error_columns(predictions(spark, sf_dir), CUT)
