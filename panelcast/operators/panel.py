"""Flights to a gap-free daily panel per route."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.config import FFILL_LIMIT

META = ["avg_daily_flights", "total_flights", "avg_distance"]


def top_routes(df: DataFrame, n=20, key="route", weight=None) -> DataFrame:
    """The n busiest routes (route, flight_count) by rows, or by a summed column; ties go to the smaller name."""
    count = F.sum(weight) if weight else F.count(F.lit(1))
    return df.groupBy(key).agg(count.alias("flight_count")).orderBy(F.desc("flight_count"), key).limit(n)


def aggregate_daily(flights: DataFrame, routes: DataFrame = None) -> DataFrame:
    """One row per (date, route): counts, mean delays, distance, carriers and cancel rate.

    All sums combine on the map side. With a carrier column the flights are first reduced per carrier, so that the
    carrier list is gathered from one row per carrier and day and not from the flights. Distance and carriers appear
    when the flights have them.
    """
    if routes is not None:
        flights = flights.join(routes.select("route"), "route", "left_semi")
    has_distance, has_carrier = "DISTANCE" in flights.columns, "REPORTING_AIRLINE" in flights.columns
    sums = {"flight_count": F.count(F.lit(1)), "cancelled_count": F.sum("CANCELLED")}
    for c in ("DEP_DELAY", "ARR_DELAY"):
        sums[f"_s_{c}"], sums[f"_n_{c}"] = F.sum(c), F.count(c)
    if has_distance:
        sums["total_distance"] = F.sum("DISTANCE")
    keys = [F.col("FL_DATE").alias("date"), "route"]
    if has_carrier:
        per_carrier = flights.groupBy(*keys, "REPORTING_AIRLINE").agg(*[v.alias(k) for k, v in sums.items()])
        carriers = F.array_join(F.array_sort(F.collect_list("REPORTING_AIRLINE")), ",").alias("carriers")
        daily = per_carrier.groupBy("date", "route").agg(*[F.sum(k).alias(k) for k in sums], carriers)
    else:
        daily = flights.groupBy(*keys).agg(*[v.alias(k) for k, v in sums.items()])
    mean = lambda c: F.try_divide(F.col(f"_s_{c}"), F.col(f"_n_{c}"))
    return daily.select(
        "date", "route", "flight_count", F.col("cancelled_count").cast("long").alias("cancelled_count"),
        mean("DEP_DELAY").alias("avg_dep_delay"), mean("ARR_DELAY").alias("avg_arr_delay"),
        *([F.coalesce("total_distance", F.lit(0.0)).alias("total_distance")] if has_distance else []),
        *(["carriers"] if has_carrier else []),
        (F.col("cancelled_count") / F.col("flight_count")).alias("cancel_rate"),
    )


def route_metadata(daily: DataFrame) -> DataFrame:
    """Per route: mean flights a day over days flown, all flights, mean distance per flight."""
    return daily.groupBy("route").agg(
        F.avg("flight_count").alias("avg_daily_flights"),
        F.sum("flight_count").alias("total_flights"),
        F.avg(F.col("total_distance") / F.col("flight_count")).alias("avg_distance"),
    )


def add_route_metadata(daily: DataFrame) -> DataFrame:
    """Adds the route metadata to every row, in the partitioning that the later windows use."""
    w = W.partitionBy("route")
    added = {
        "avg_daily_flights": F.avg("flight_count").over(w),
        "total_flights": F.sum("flight_count").over(w),
    }
    if "total_distance" in daily.columns:
        added["avg_distance"] = F.avg(F.col("total_distance") / F.col("flight_count")).over(w)
    return daily.withColumns(added)


def _date_range(daily: DataFrame):
    """First and last date of the whole table, as one scalar sub-query."""
    ends = daily.groupBy().agg(F.struct(F.min("date").alias("first"), F.max("date").alias("last"))).scalar()
    return ends["first"], ends["last"]


def calendar_spine(daily: DataFrame) -> DataFrame:
    """Every (date, route) from the first to the last date of the whole table, one exploded range per route."""
    first, last = _date_range(daily)
    return daily.select("route").distinct().select("route", F.explode(F.sequence(first, last)).alias("date"))


def fill_missing_dates(daily: DataFrame, ffill_limit=FFILL_LIMIT) -> DataFrame:
    """One row per route and calendar day.

    Every row spans the days up to the next row of its route (the first row also those before it, the last those after)
    and is exploded into them, so the calendar is complete without joining a date-by-route grid. Only the row's own day
    keeps its values. Delays then carry forward at most ``ffill_limit`` days, further gaps are 0; counts and rates of
    added days are 0; distance and carriers stay null; route metadata holds for every day. Pass a staged table: its
    date range is read with a small sub-query.
    """
    first, last = _date_range(daily)
    w = W.partitionBy("route").orderBy("date")
    begins = F.when(F.row_number().over(w) == 1, first).otherwise(F.col("date"))
    ends = F.coalesce(F.date_sub(F.lead("date").over(w), 1), last)
    meta = [c for c in META if c in daily.columns]
    values = [c for c in daily.columns if c not in ("route", "date", *meta)]

    spanned = daily.withColumns({"_from": begins, "_to": ends})
    days = spanned.select(
        "route", F.explode(F.sequence("_from", "_to")).alias("day"), "date", *meta, *values
    )
    own = F.col("day") == F.col("date")
    panel = days.select(
        F.col("day").alias("date"), "route", *[F.when(own, F.col(c)).alias(c) for c in values], *meta
    )
    carried = {
        c: F.coalesce(F.last(c, ignorenulls=True).over(w.rowsBetween(-ffill_limit, 0)), F.lit(0.0))
        for c in ("avg_dep_delay", "avg_arr_delay")
        if c in values
    }
    zero = [c for c in ("flight_count", "cancelled_count", "cancel_rate") if c in values]
    return panel.withColumns(carried).fillna(0, subset=zero)


def daily_series(panel: DataFrame, value="avg_arr_delay") -> DataFrame:
    """Mean over routes per date."""
    return panel.groupBy("date").agg(F.avg(value).alias(value))


def rolling_daily_mean(panel: DataFrame, value="avg_arr_delay", days=30) -> DataFrame:
    """Daily mean and its trailing mean including today. The series has one row per calendar day."""
    w = W.partitionBy(F.lit(0)).orderBy("date").rowsBetween(-(days - 1), 0)
    return daily_series(panel, value).withColumn(f"rolling_{days}", F.avg(value).over(w))
