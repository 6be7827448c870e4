"""Default cut-offs and column lists. Every operator takes these as parameters."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Fold:
    """One walk-forward fold; every range is half-open, so ``test_end`` itself is never tested."""

    fold: int
    train_end: str
    val_end: str
    test_start: str
    test_end: str


@dataclass(frozen=True)
class Cutoffs:
    """Calendar of one study."""

    data_start: str
    train_end: str
    val_end: str
    test_start: str
    test_end: str
    era_start: str
    era_peak_end: str
    era_recovery_end: str
    folds: tuple


# Study calendar.
STUDY = Cutoffs(
    data_start="2019-01-01",
    train_end="2024-01-01",
    val_end="2024-07-01",
    test_start="2024-07-01",
    test_end="2025-06-30",
    era_start="2020-03-01",
    era_peak_end="2021-06-01",
    era_recovery_end="2022-06-01",
    folds=(
        Fold(1, "2022-07-01", "2023-01-01", "2023-01-01", "2023-06-30"),
        Fold(2, "2023-01-01", "2023-07-01", "2023-07-01", "2023-12-31"),
        Fold(3, "2023-07-01", "2024-01-01", "2024-01-01", "2024-06-30"),
        Fold(4, "2024-01-01", "2024-07-01", "2024-07-01", "2024-12-31"),
    ),
)


def shift_years(cut: Cutoffs, years: int) -> Cutoffs:
    """The same study moved by whole years (all cut-offs fall on days every year has)."""

    def move(value):
        return f"{int(value[:4]) + years:04d}{value[4:]}"

    folds = tuple(
        Fold(f.fold, move(f.train_end), move(f.val_end), move(f.test_start), move(f.test_end)) for f in cut.folds
    )
    dates = {k: move(v) for k, v in vars(cut).items() if k != "folds"}
    return Cutoffs(folds=folds, **dates)


# Target, windows, lags and limits.
TARGET = "avg_arr_delay"
SEQUENCE_LENGTH = 28
LAGS = (1, 7, 14, 28)
ROLLING = (7, 14)
EWM_SPAN = 7
WEATHER_LAGS = (1, 3, 7)
FFILL_LIMIT = 7
DELAY_THRESHOLD = 15.0

# Columns read from flight files.
FLIGHT_COLUMNS = [
    "FL_DATE", "REPORTING_AIRLINE", "OP_UNIQUE_CARRIER", "ORIGIN", "DEST",
    "DEP_DELAY", "ARR_DELAY", "CANCELLED", "DISTANCE",
]

# Daily weather columns carried to each end of a route.
WEATHER_COLUMNS = [
    "temp_avg", "temp_max", "temp_min", "temp_range",
    "precip_total", "snowfall", "wind_speed_max", "wind_gusts_max",
    "severity", "has_precipitation", "has_snow", "is_adverse",
    "peak_wind_operating", "precip_operating", "max_hourly_severity",
    "storm_hours", "morning_severity", "evening_severity",
]
HOURLY_ROLLUP_COLUMNS = [
    "peak_wind_operating", "precip_operating", "max_hourly_severity",
    "storm_hours", "morning_severity", "evening_severity",
]

# Model feature lists.
CALENDAR_FEATURES = [
    "day_of_week", "day_of_month", "month", "quarter", "week_of_year",
    "is_weekend", "is_month_start", "is_month_end",
    "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos",
    "is_federal_holiday", "days_to_holiday", "days_from_holiday", "is_holiday_week", "is_school_break",
]
ERA_FEATURES = ["is_covid_period", "is_covid_recovery", "is_post_covid"]
ROUTE_FEATURES = [
    "route_encoded", "route_mean_demand", "route_std_demand", "route_median_demand",
    "route_delay_mean", "route_delay_std",
]
LAG_FEATURES = [
    "lag_1_arr_delay", "lag_7_arr_delay", "lag_14_arr_delay", "lag_28_arr_delay",
    "rolling_mean_7_arr_delay", "rolling_mean_14_arr_delay",
    "rolling_std_7_arr_delay", "rolling_std_14_arr_delay", "ewm_7_arr_delay",
]
WEATHER_FEATURES = [
    "apt1_severity", "apt2_severity", "weather_severity_max", "weather_severity_combined",
    "has_adverse_weather", "severe_weather_level", "both_clear", "weather_diff",
    "apt1_temp_avg", "apt2_temp_avg", "apt1_precip_total", "apt2_precip_total",
    "apt1_snowfall", "apt2_snowfall", "apt1_wind_speed_max", "apt2_wind_speed_max",
    "total_precip", "total_snowfall", "max_wind",
    "weather_severity_lag_1", "weather_severity_lag_3", "weather_severity_lag_7",
    "peak_wind_operating", "precip_operating", "max_hourly_severity",
    "storm_hours", "morning_severity", "evening_severity",
]
TABULAR_FEATURES = CALENDAR_FEATURES + ERA_FEATURES + ROUTE_FEATURES + LAG_FEATURES + WEATHER_FEATURES
SEQUENCE_FEATURES = [
    "avg_arr_delay",
    "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos",
    "is_weekend", "is_federal_holiday", "is_holiday_week", "is_school_break",
    "is_covid_period", "is_covid_recovery", "is_post_covid",
    "weather_severity_max", "apt1_severity", "apt2_severity", "has_adverse_weather",
    "apt1_temp_avg", "apt2_temp_avg", "total_precip", "total_snowfall", "max_wind", "severe_weather_level",
    "peak_wind_operating", "storm_hours", "morning_severity", "evening_severity",
]

# Regional carrier codes left out of the carrier report.
REGIONAL_CARRIERS = ["OO", "MQ", "OH", "YX", "9E", "YV", "QX", "ZW", "CP", "G7"]


def present(columns, df):
    """The listed columns that the frame has, in list order."""
    return [c for c in columns if c in df.columns]
