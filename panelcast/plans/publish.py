"""Serving outputs: nested forecast documents and the error report."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.config import REGIONAL_CARRIERS
from panelcast.functions.metrics import published
from panelcast.functions.stats import stack_long
from panelcast.operators import evaluation as oe
from panelcast.operators import insights as oi
from panelcast.operators.baselines import to_long
from panelcast.operators.predictions import align_predictions
from panelcast.sources.landing import newest_version, write_version

DAY = "yyyy-MM-dd"


def forecast_documents(merged: DataFrame, models) -> DataFrame:
    """One row per route with its predictions as an array of per-day structs, values rounded half-even to a tenth.

    A route's array has one entry per test day, so it is bounded by the test period.
    """
    tenth = lambda c: published(c).alias(c)
    entry = F.struct(F.date_format("date", DAY).alias("date"), tenth("actual"), *[tenth(m) for m in models])
    return merged.groupBy("route").agg(F.array_sort(F.collect_list(entry)).alias("predictions"))


def history_documents(panel: DataFrame, test_start, target="avg_arr_delay") -> DataFrame:
    """One row per route with its pre-test actuals."""
    entry = F.struct(F.date_format("date", DAY).alias("date"), published(target).alias("actual"))
    before = panel.filter(F.col("date") < F.lit(test_start).cast("date"))
    return before.groupBy("route").agg(F.array_sort(F.collect_list(entry)).alias("historical"))


def metadata(panel: DataFrame, cut) -> DataFrame:
    """One row describing the published forecast."""
    per_route = panel.groupBy("route").agg(F.min("date").alias("d"))
    return per_route.agg(
        F.lit("avg_arrival_delay").alias("target"),
        F.lit("daily_route_level").alias("granularity"),
        F.lit("minutes").alias("unit"),
        F.lit(cut.test_start).alias("test_start"),
        F.lit(cut.test_end).alias("test_end"),
        F.date_format(F.min("d"), DAY).alias("train_start"),
        F.lit(cut.train_end).alias("train_end"),
        F.count("route").alias("trained_on_routes"),
    )


def write_forecast(panel: DataFrame, merged: DataFrame, shown: DataFrame, models, cut, path: str, metrics=None, folds=None) -> str:
    """A new version below ``path`` with the documents of the shown routes (predictions with history) and the metadata; tables
    of metrics and of walk-forward results become sections of their own. Readers see it once all sections are written."""
    docs = forecast_documents(merged.join(shown.select("route"), "route", "left_semi"), models)
    docs = docs.join(history_documents(panel, cut.test_start), "route", "left")
    sections = {"routes": docs, "metadata": metadata(panel, cut), "metrics": metrics, "walk_forward": folds}
    return write_version({k: v for k, v in sections.items() if v is not None}, path)


def document_schema(models) -> str:
    values = ", ".join(f"{m}: double" for m in ["actual", *models])
    return f"route string, predictions array<struct<date: string, {values}>>, historical array<struct<date: string, actual: double>>"


def read_forecast(spark: SparkSession, path: str, models) -> DataFrame:
    return read_section(spark, path, "routes", document_schema(models))


def read_section(spark: SparkSession, path: str, section: str, schema) -> DataFrame:
    """A section of the newest whole version."""
    return spark.read.schema(schema).json(newest_version(spark, path)[section])


def published_metrics(metrics: DataFrame) -> DataFrame:
    """Metrics as they are published: one digit, the coefficient of determination three."""
    names = [c for c, t in metrics.dtypes if t == "double"]
    return metrics.withColumns({c: published(c, 3 if c == "r2" else 1) for c in names})


def forecast_metrics(merged: DataFrame, models, shown: DataFrame, aligned=(), decimals=1) -> DataFrame:
    """Published delay metrics: per model over all routes, and per model and shown route.

    Models are compared on the rows where all of ``aligned`` have a value. Values are rounded half-even before the
    metrics, as readers of the published forecast would compute them. Pass a staged table.
    """
    values = to_long(align_predictions(merged, list(aligned)) if aligned else merged, models)
    values = values.withColumns({c: published(c, decimals) for c in ("actual", "pred")})
    by_route = oe.delay_metrics(values.join(shown.select("route"), "route", "left_semi"), ["model", "route"])
    return published_metrics(by_route.unionByName(oe.delay_metrics(values, ["model"]).withColumn("route", F.lit("all"))))


def analysis_documents(features: DataFrame, flights: DataFrame, importance: DataFrame, top_carriers=10, excluded=REGIONAL_CARRIERS) -> DataFrame:
    """The three analysis documents (name, body JSON): weather impact, carrier performance, feature importance.

    Each gathers a report of bounded size: severities, the top carriers, features per model.
    """
    rows = lambda df: F.array_sort(F.collect_list(F.struct(*df.columns)))
    impact, corr = oi.weather_impact(features), oi.weather_correlations(features)
    carriers = oi.carrier_performance(flights, top_carriers, excluded)
    shares = oi.importance_share(importance).select("model", "rank", "feature", "share", "n_features")
    parts = [
        ("weather_impact", "by_severity", impact), ("weather_impact", "correlation", corr),
        ("carrier_performance", "carriers", carriers), ("feature_importance", "features", shares),
    ]
    out = None
    for name, section, df in parts:
        doc = df.groupBy().agg(F.to_json(rows(df)).alias("body")).select(
            F.lit(name).alias("name"), F.lit(section).alias("section"), "body"
        )
        out = doc if out is None else out.unionByName(doc)
    return out


def error_report(errors: DataFrame, n_worst=10) -> DataFrame:
    """The error report in long form (section, key, metric, value): overall, by route, day type and season, and the
    worst forecasts. Pass a staged table of one model's errors."""
    metrics = oe.metrics_by_segments(errors.withColumn("model", F.lit("one")), ("route", "day_type", "season"))
    long = stack_long(metrics, ["section", "key"], ["rmse", "mae", "mape", "r2", "n_samples"], "metric", "value")
    long = long.filter((F.col("section") == "overall") | F.col("metric").isin("rmse", "mae", "mape"))
    worst = oe.worst_forecasts(errors, n_worst).withColumn("key", F.concat_ws(" ", "route", F.date_format("date", DAY)))
    worst = stack_long(worst.withColumn("section", F.lit("worst")), ["section", "key"], ["actual", "pred", "error"], "metric", "value")
    return long.unionByName(worst)


def report_text(report: DataFrame) -> DataFrame:
    """Report lines in order (position, line), for a text file."""
    order = F.array_position(F.array(*[F.lit(s) for s in ("overall", "route", "day_type", "season", "worst")]), F.col("section"))

    line = F.concat_ws(" ", "section", "key", "metric", F.coalesce(F.format_number("value", 2), F.lit("n/a")))
    at = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(order, "key", "metric"))
    return report.select(at.alias("position"), line.alias("line"))
