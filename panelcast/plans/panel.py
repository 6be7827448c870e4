"""Flights and weather to the daily panel."""

from pyspark.sql import DataFrame

from panelcast.operators import panel as op
from panelcast.operators import weather as ow
from panelcast.sources.staging import stage


def build_panel(flights: DataFrame, n_routes=50) -> DataFrame:
    """Gap-free panel of the busiest routes, reading the flights once.

    All routes are reduced to days first (a bounded table: routes by days) and staged; the busiest routes, the metadata
    and the calendar come from that table instead of from further passes over the flights.
    """
    daily = stage(op.aggregate_daily(flights), "daily")
    top = op.top_routes(daily, n_routes, weight="flight_count")
    kept = daily.join(top.select("route"), "route", "left_semi")
    return op.fill_missing_dates(op.add_route_metadata(kept))


def build_weather(daily_raw: DataFrame, hourly: DataFrame) -> DataFrame:
    """Daily weather table with condition, flags and hourly features."""
    return ow.merge_hourly_into_daily(ow.process_weather(daily_raw), ow.hourly_to_daily(hourly))


def build_weather_panel(flights: DataFrame, weather: DataFrame, n_routes=50) -> DataFrame:
    return ow.merge_weather(build_panel(flights, n_routes), weather)
