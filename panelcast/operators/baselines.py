"""Baseline forecasts: last value, seasonal last value, moving average."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.config import TARGET
from panelcast.functions.calendar import day
from panelcast.functions.metrics import published
from panelcast.functions.stats import exact_median


def _ordered():
    return W.partitionBy("route").orderBy("date")


def naive(target=TARGET):
    return F.lag(target, 1).over(_ordered())


def seasonal_naive(target=TARGET, season=7):
    return F.lag(target, season).over(_ordered())


def moving_average(target=TARGET, window=7):
    return F.avg(target).over(_ordered().rowsBetween(-window, -1))


def fit_medians(train: DataFrame, target=TARGET) -> DataFrame:
    """Per-route medians, and the median of all rows under a null route.

    A route's median is over one row per day; the overall one is selected without gathering the table.
    """
    per_route = train.groupBy("route").agg(F.median(target).alias("median"))
    overall = exact_median(train, [], target).select(F.lit(None).cast("string").alias("route"), "median")
    return per_route.unionByName(overall)


def predict(df: DataFrame, models: dict, train_end=None, target=TARGET) -> DataFrame:
    """Adds one prediction column per entry of ``models`` (name to expression), all over one window partitioning.

    With ``train_end`` a missing prediction falls back to the route's training median, then to the overall one. The
    frame must hold the training rows; without it missing predictions stay null.
    """
    out = df.withColumns(models)
    if train_end is None:
        return out
    train = F.when(F.col("date") < day(train_end), F.col(target))
    route_median = F.median(train).over(W.partitionBy("route"))
    overall = exact_median(df.select(train.alias(target)), [], target).scalar()
    return out.withColumns({m: F.coalesce(F.col(m), route_median, overall) for m in models})


def predict_in_slice(
    df: DataFrame, models: dict, start, end=None, target=TARGET, keys=("route", "date")
) -> DataFrame:
    """Predictions that look back only inside [start, end); a route's first rows have none and are dropped."""
    rows = df.filter(F.col("date") >= day(start))
    if end is not None:
        rows = rows.filter(F.col("date") < day(end))
    out = rows.select(*keys, F.col(target).alias("actual"), target).withColumns(models).drop(target)
    return out.dropna(subset=list(models))


def from_features(features: DataFrame, start, target=TARGET) -> DataFrame:
    """Baselines read off the lag features, missing ones 0, rounded half-even to a tenth for publishing."""
    suffix = target.replace("avg_", "")
    tenth = lambda c: published(F.coalesce(F.col(c), F.lit(0.0)))
    return features.filter(F.col("date") >= day(start)).select(
        "route", "date",
        published(target).alias("actual"),
        tenth(f"lag_1_{suffix}").alias("naive"),
        tenth(f"rolling_mean_7_{suffix}").alias("ma"),
    )


def to_long(df: DataFrame, models, keys=("route", "date", "actual")) -> DataFrame:
    """Wide predictions to rows (keys, model, pred)."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("pred")) for m in models])
    return df.select(*keys, F.inline(pairs))
