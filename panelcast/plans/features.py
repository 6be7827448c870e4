"""Panel to the feature table."""

from pyspark.sql import DataFrame

from panelcast.functions.calendar import federal_holidays
from panelcast.operators import features as of


def build_features(panel: DataFrame, cut, holiday_years, observed=True, std_fill="median") -> DataFrame:
    """The full feature table of a weather panel; nothing but its own past and training rows reaches a row.

    Pass a staged panel: the medians and the route list are read from it with small sub-queries. Joins with per-date and
    per-route tables come first, then every window shares one partitioning by route.
    """
    holidays = federal_holidays(panel.sparkSession, *holiday_years, observed=observed)
    df = of.temporal_features(panel)
    df = of.holiday_features(df, holidays)
    df = of.era_features(df, cut)
    df = of.route_code(of.impute_weather(df, cut.train_end))
    df = of.weather_derived(df)
    df = of.lag_features(df)
    df = of.weather_lags(df)
    df = of.train_route_stats(df, cut.train_end)
    return of.impute_lags(df, cut.train_end, std_fill)
