"""Panel to model features.

Every per-route column (lags, rolling and exponential means, training statistics, medians for imputation) is a window
over the same partitioning by route, so the whole feature set costs one shuffle. A route's partition is bounded by the
calendar: one row per day. The input must be gap-free (``panel.fill_missing_dates``), as row frames stand for days.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast import config
from panelcast.functions import calendar as cal
from panelcast.functions import weather as fw
from panelcast.functions.stats import exact_median, stack_long

EWM_BLOCK = 64


def _ordered():
    return W.partitionBy("route").orderBy("date")


def _train_value(column, train_end):
    return F.col(column) if train_end is None else F.when(F.col("date") < cal.day(train_end), F.col(column))


def temporal_features(df: DataFrame) -> DataFrame:
    return df.withColumns(cal.calendar_columns())


def holiday_features(df: DataFrame, holidays: DataFrame) -> DataFrame:
    """Holiday flag, capped distances to the next and from the last holiday, holiday week, school break.

    The joined dimension has at most one row per calendar day within reach of a holiday.
    """
    near = cal.holiday_distances(holidays)
    out = df.join(near, "date", "left").fillna(cal.HOLIDAY_CAP, subset=["days_to_holiday", "days_from_holiday"])
    week = (F.col("days_to_holiday") <= 3) | (F.col("days_from_holiday") <= 3)
    return out.fillna(0, subset=["is_federal_holiday"]).withColumns(
        {"is_holiday_week": fw.flag(week), "is_school_break": cal.school_break()}
    )


def era_features(df: DataFrame, cut) -> DataFrame:
    return df.withColumns(cal.era_flags(cut))


def with_ewm(df: DataFrame, value, name, span=config.EWM_SPAN) -> DataFrame:
    """Adds the exponentially weighted mean of all rows before, weights normalised; a missing value has no weight.

    Discounted sums run inside blocks of days; what earlier blocks add is folded from one pair of sums per block, so
    a row looks at its own block and a short list, and nothing is cut off. All windows share the partitioning by route.
    """
    keep, x = 1 - 2.0 / (span + 1), F.col(value).cast("double")
    if keep == 0:
        return df.withColumn(name, F.last(x, ignorenulls=True).over(_ordered().rowsBetween(W.unboundedPreceding, -1)))
    out = df.withColumn("_at", F.row_number().over(_ordered()) - 1)
    out = out.withColumns({"_block": F.floor(F.col("_at") / EWM_BLOCK), "_in": F.col("_at") % EWM_BLOCK})
    inside = W.partitionBy("route", "_block").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    grown, shrunk = F.pow(F.lit(1 / keep), F.col("_in")), F.pow(F.lit(keep), F.col("_in"))
    running = lambda v: F.coalesce(F.sum(v * grown).over(inside), F.lit(0.0)) * shrunk
    out = out.withColumns({"_num": running(x), "_den": running(F.when(x.isNotNull(), 1.0))})
    whole = F.when(F.col("_in") == EWM_BLOCK - 1, F.struct(F.col("_num").alias("num"), F.col("_den").alias("den")))
    before = F.collect_list(whole).over(_ordered().rowsBetween(W.unboundedPreceding, -1))
    fade, zero = keep**EWM_BLOCK, F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den"))
    step = lambda acc, b: F.struct((acc.num * fade + b.num).alias("num"), (acc.den * fade + b.den).alias("den"))
    out = out.withColumn("_carry", F.aggregate(before, zero, step))
    reach = F.pow(F.lit(keep), F.col("_in") + 1)
    out = out.withColumn("_mean", F.try_divide(F.col("_num") + F.col("_carry.num") * reach, F.col("_den") + F.col("_carry.den") * reach))
    return out.withColumn(name, F.lag("_mean").over(_ordered())).drop("_at", "_block", "_in", "_num", "_den", "_carry", "_mean")


def lag_features(df: DataFrame, target=config.TARGET) -> DataFrame:
    """Lags, rolling mean and sample deviation, and exponential mean of the rows before today."""
    suffix = target.replace("avg_", "")
    w = _ordered()
    cols = {f"lag_{k}_{suffix}": F.lag(target, k).over(w) for k in config.LAGS}
    for k in config.ROLLING:
        frame = w.rowsBetween(-k, -1)
        cols[f"rolling_mean_{k}_{suffix}"] = F.avg(target).over(frame)
        cols[f"rolling_std_{k}_{suffix}"] = F.stddev_samp(target).over(frame)
    return with_ewm(df.withColumns(cols), target, f"ewm_{config.EWM_SPAN}_{suffix}")


def route_code(df: DataFrame) -> DataFrame:
    """0-based rank of each route in alphabetic order. The route list is one row per route."""
    ranked = df.select("route").distinct().select(
        "route", (F.row_number().over(W.partitionBy(F.lit(0)).orderBy("route")) - 1).alias("route_encoded")
    )
    return df.join(ranked, "route", "left")


def train_route_stats(df: DataFrame, train_end=None, target=config.TARGET) -> DataFrame:
    """Demand and delay statistics of each route over training rows only, on every row."""
    w = W.partitionBy("route")
    flights, delay = _train_value("flight_count", train_end), _train_value(target, train_end)
    any_train = F.count(flights).over(w) > 0
    return df.withColumns({
        "route_mean_demand": F.avg(flights).over(w),
        "route_std_demand": F.stddev_samp(flights).over(w),
        "route_median_demand": F.median(flights).over(w),
        "route_delay_mean": F.avg(delay).over(w),
        "route_delay_std": F.when(any_train, F.coalesce(F.stddev_samp(delay).over(w), F.lit(0.0))),
    })


def impute_weather(df: DataFrame, train_end=None, default_temp=50.0) -> DataFrame:
    """Missing severity, precipitation and wind become 0, temperatures the training median of the whole table."""
    # every weather feature that is there before the derived and lagged ones, but for the temperatures
    zero = [c for c in config.WEATHER_FEATURES if "temp" not in c]
    temps = ["apt1_temp_avg", "apt2_temp_avg"]
    train = stack_long(df.select(*[_train_value(c, train_end).alias(c) for c in temps]), [], temps, "name", "v")
    medians = exact_median(train, ["name"], "v").groupBy().agg(
        F.map_from_entries(F.collect_list(F.struct("name", "median")))
    ).scalar()
    temps = {c: F.coalesce(F.col(c), medians[c], F.lit(default_temp)) for c in temps}
    return df.fillna(0, subset=config.present(zero, df)).withColumns(temps)


def weather_derived(df: DataFrame) -> DataFrame:
    worst = F.col("weather_severity_max")
    return df.withColumns({
        "severe_weather_level": fw.flag(worst >= 4) + fw.flag(worst >= 5),
        "both_clear": fw.flag((F.col("apt1_severity") == 0) & (F.col("apt2_severity") == 0)),
        "weather_diff": F.abs(F.col("apt1_severity") - F.col("apt2_severity")),
    })


def weather_lags(df: DataFrame) -> DataFrame:
    w = _ordered()
    return df.withColumns({
        f"weather_severity_lag_{k}": F.coalesce(F.lag("weather_severity_max", k).over(w), F.lit(0))
        for k in config.WEATHER_LAGS
    })


def impute_lags(df: DataFrame, train_end=None, std_fill="median") -> DataFrame:
    """Missing lag features become the route's training median, else 0; ``std_fill='zero'`` sends deviations to 0."""
    w = W.partitionBy("route")
    lagged = [c for c in df.columns if c.startswith(("lag_", "rolling_", "ewm_"))]
    filled = {}
    for c in lagged:
        if std_fill == "zero" and c.startswith("rolling_std"):
            filled[c] = F.coalesce(F.col(c), F.lit(0.0))
        else:
            filled[c] = F.coalesce(F.col(c), F.median(_train_value(c, train_end)).over(w), F.lit(0.0))
    return df.withColumns(filled)


def ablated(features, removed=config.WEATHER_FEATURES) -> list:
    """Feature list without the removed ones."""
    drop = set(removed)
    return [f for f in features if f not in drop]
