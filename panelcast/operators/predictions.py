"""Prediction tables: merge, align, history, city pairs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.calendar import day


def merge_predictions(baseline: DataFrame, model_preds: dict) -> DataFrame:
    """Baseline rows (route, date, actual, ...) with one column per model, null where a model has no prediction.

    The models' rows are stacked and pivoted by one group-by on (route, date), then joined once on the same keys.
    """
    names = list(model_preds)
    stacked = None
    for name, df in model_preds.items():
        rows = df.select("route", "date", F.lit(name).alias("model"), F.col("pred").cast("double").alias("pred"))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    wide = stacked.groupBy("route", "date").pivot("model", names).agg(F.max("pred"))
    return baseline.join(wide, ["route", "date"], "left")


def align_predictions(merged: DataFrame, required) -> DataFrame:
    """Rows where every required model has a prediction."""
    return merged.dropna(subset=list(required))


def history_plus_forecast(history: DataFrame, forecast: DataFrame, test_start, target="avg_arr_delay") -> DataFrame:
    """Pre-test actuals and test predictions as one series per route (route, date, actual, predicted, is_test)."""
    before = history.filter(F.col("date") < day(test_start)).select(
        "route", "date", F.col(target).alias("actual"),
        F.lit(None).cast("double").alias("predicted"), F.lit(0).alias("is_test"),
    )
    after = forecast.select(
        "route", "date", "actual", F.col("pred").alias("predicted"), F.lit(1).alias("is_test")
    )
    return before.unionByName(after)


def city_pair(route="route"):
    parts = F.split(route, "-")
    return F.concat_ws("-", F.least(parts[0], parts[1]), F.greatest(parts[0], parts[1]))


def city_pairs(routes: DataFrame) -> DataFrame:
    """Distinct undirected pairs."""
    return routes.select(city_pair().alias("city_pair")).distinct()


def directional_routes(pairs: DataFrame) -> DataFrame:
    """Both directions of each pair."""
    parts = F.split("city_pair", "-")
    return pairs.select(
        "city_pair", F.col("city_pair").alias("outbound"), F.concat_ws("-", parts[1], parts[0]).alias("inbound")
    )


def city_pair_hit_rate(routes: DataFrame, route_metrics: DataFrame) -> DataFrame:
    """Pairs by the mean hit rate of their directions, highest first; a pair without metrics has 0."""
    rated = routes.select("route").distinct().join(route_metrics.select("route", "within_15"), "route", "left")
    mean = F.coalesce(F.avg("within_15"), F.lit(0.0))
    return rated.groupBy(city_pair().alias("city_pair")).agg(mean.alias("hit_rate")).orderBy(F.desc("hit_rate"), "city_pair")
