"""Registered queries: name to function of (spark, sf_dir)."""

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast import config
from panelcast.catalog import base as b
from panelcast.functions import calendar as cal
from panelcast.functions import text as tx
from panelcast.functions import weather as fw
from panelcast.functions.stats import exact_quantiles
from panelcast.operators import baselines as ob
from panelcast.operators import boosting as bo
from panelcast.operators import clean as oc
from panelcast.operators import evaluation as oe
from panelcast.operators import features as of
from panelcast.operators import folds as fo
from panelcast.operators import forecasting as fc
from panelcast.operators import insights as oi
from panelcast.operators import panel as op
from panelcast.operators import predictions as pr
from panelcast.operators import recurrent as rn
from panelcast.operators import weather as ow
from panelcast.plans import publish
from panelcast.plans.panel import build_panel
from panelcast.plans.walkforward import walk_forward
from panelcast.sources import flights as sf
from panelcast.sources import starschema
from panelcast.sources import tables as st
from panelcast.sources import weather as sw
from panelcast.sources.landing import land, read_landed, write_version
from panelcast.sources.staging import scratch_path, stage

QUERIES = {}


def query(fn):
    """Registers a query under its function name; doubles are rounded at the edge."""
    def run(spark, sf_dir):
        return b.edge(fn(spark, sf_dir))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


# ---- flagship -------------------------------------------------------------------------------------------------


@query
def naive_delay_by_route(spark, d):
    """How well yesterday's delay predicts today's, per route: flights to panel to forecast to metrics."""
    panel = b.panel(spark, d)
    preds = ob.predict(panel.select("route", "date", config.TARGET), {"pred": ob.naive()})
    tested = preds.filter(F.col("date") >= cal.day(b.CUT.test_start)).withColumnRenamed(config.TARGET, "actual")
    return oe.delay_metrics(tested, ["route"])


# ---- cleaning and panel ---------------------------------------------------------------------------------------


@query
def clean_flights(spark, d):
    """Flights with untidy text columns and dates in nine forms, cleaned, then counted and summed per route and carrier."""
    forms = ["M/d/yyyy", "yyyyMMdd", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "d-MMM-yyyy", "MMMM d, yyyy", "yyyy/MM/dd", "M/d/yy", "d MMM yyyy"]
    written = F.element_at(F.array(*[F.date_format("FL_DATE", x) for x in forms]), (F.dayofyear("FL_DATE") % len(forms) + 1).cast("int"))
    raw = b.flights(spark, d).select(
        written.alias("FL_DATE"),
        F.concat(F.lit(" "), F.lower("REPORTING_AIRLINE")).alias("REPORTING_AIRLINE"),
        F.lower("ORIGIN").alias("ORIGIN"),
        F.concat("DEST", F.lit("  ")).alias("DEST"),
        F.col("DEP_DELAY").cast("string").alias("DEP_DELAY"),
        F.coalesce(F.col("ARR_DELAY").cast("string"), F.lit("n/a")).alias("ARR_DELAY"),
        F.when(F.col("CANCELLED") == 1, "1.0").alias("CANCELLED"),
        F.col("DISTANCE").cast("string").alias("DISTANCE"),
    )
    return oc.clean_flights(raw).groupBy("route", "REPORTING_AIRLINE").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("CANCELLED").alias("cancelled"),
        F.sum("ARR_DELAY").alias("arr_delay"),
        F.sum("DISTANCE").alias("distance"),
        F.min("FL_DATE").alias("first_date"),
        F.max("FL_DATE").alias("last_date"),
    )


@query
def coalesce_carrier(spark, d):
    """Carrier column filled from the alternative column."""
    fl = b.carriers(spark, d)
    mixed = fl.select(
        F.when(F.col("CANCELLED") == 0, F.col("REPORTING_AIRLINE")).alias("REPORTING_AIRLINE"),
        F.col("REPORTING_AIRLINE").alias("OP_UNIQUE_CARRIER"),
    )
    return oc.coalesce_carrier(mixed).groupBy("REPORTING_AIRLINE").agg(F.count(F.lit(1)).alias("n"))


@query
def split_route(spark, d):
    out = oc.split_route(b.delays(spark, d))
    return out.groupBy("airport1", "airport2").agg(F.count(F.lit(1)).alias("n"))


@query
def top_routes(spark, d):
    return op.top_routes(b.delays(spark, d), b.TOP_ROUTES)


@query
def top_display_routes(spark, d):
    return op.top_routes(b.panel(spark, d), 5, weight="flight_count")


@query
def filter_top_routes(spark, d):
    daily = stage(op.aggregate_daily(b.delays(spark, d)), "daily")
    kept = oc.filter_routes(daily, op.top_routes(daily, b.TOP_ROUTES, weight="flight_count"))
    return kept.select("date", "route", "flight_count")


@query
def daily_route_agg(spark, d):
    return op.aggregate_daily(b.flights(spark, d))


@query
def route_metadata(spark, d):
    return op.route_metadata(op.aggregate_daily(b.flights(spark, d)))


@query
def join_route_stats(spark, d):
    daily = op.add_route_metadata(op.aggregate_daily(b.flights(spark, d)))
    return daily.select("date", "route", "flight_count", *op.META)


@query
def gap_fill_spine(spark, d):
    return op.calendar_spine(stage(op.aggregate_daily(b.delays(spark, d)), "daily"))


@query
def gap_fill_defaults(spark, d):
    """Counts and rates of days without flights are 0; distance and carriers stay null."""
    daily = stage(op.aggregate_daily(b.flights(spark, d)), "daily")
    filled = op.fill_missing_dates(daily)
    return filled.select("date", "route", "flight_count", "cancelled_count", "cancel_rate", "total_distance", "carriers")


@query
def route_meta_first(spark, d):
    """Route metadata held on every calendar day."""
    daily = stage(op.add_route_metadata(op.aggregate_daily(b.flights(spark, d))), "daily")
    return op.fill_missing_dates(daily).select("date", "route", *op.META)


@query
def ffill_limit(spark, d):
    """Delays carried forward at most a week, over all routes."""
    daily = stage(op.aggregate_daily(b.delays(spark, d)), "daily")
    return op.fill_missing_dates(daily).select("date", "route", "avg_dep_delay", "avg_arr_delay")


@query
def panel(spark, d):
    """The whole job from flights to the panel of the busiest routes."""
    return build_panel(b.flights(spark, d), b.N_ROUTES)


@query
def exclude_regional(spark, d):
    kept = oc.exclude_regional(b.carriers(spark, d), codes=b.EXCLUDED_CARRIERS)
    return kept.groupBy("REPORTING_AIRLINE").agg(F.count(F.lit(1)).alias("n"))


@query
def completed_flights(spark, d):
    return oc.completed_flights(b.delays(spark, d)).groupBy("route").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ARR_DELAY").alias("avg_delay")
    )


@query
def sort_panel(spark, d):
    """Panel position of each day within its route, in the order the panel is written."""
    w = W.partitionBy("route").orderBy("date")
    return b.panel(spark, d).select("route", "date", F.row_number().over(w).alias("position"), "flight_count")


@query
def profile_table(spark, d):
    return st.profile_table(b.panel(spark, d).select("route", "date", "flight_count", "avg_arr_delay"))


@query
def profile_flights(spark, d):
    """Profile of the raw flights, where nulls occur."""
    return st.profile_table(b.delays(spark, d), date="FL_DATE")


@query
def sample_head(spark, d):
    return sf.sample_head(b.flights(spark, d), 1000)


@query
def distinct_routes_period(spark, d):
    """Number of routes flown in the first year."""
    fl = b.delays(spark, d).filter(F.col("FL_DATE") < cal.day("1996-01-01"))
    return sf.distinct_route_count(fl)


# ---- weather --------------------------------------------------------------------------------------------------


@query
def weather_condition(spark, d):
    out = starschema.hourly_weather(spark, d).select("weather_code", fw.weather_condition("weather_code").alias("condition"))
    return out.groupBy("weather_code", "condition").agg(F.count(F.lit(1)).alias("n"))


@query
def condition_severity(spark, d):
    cond = fw.weather_condition("weather_code")
    out = starschema.hourly_weather(spark, d).select(cond.alias("condition"), fw.condition_severity(cond).alias("severity"))
    return out.groupBy("condition", "severity").agg(F.count(F.lit(1)).alias("n"))


@query
def severity_label(spark, d):
    sev = fw.code_severity("weather_code")
    out = starschema.hourly_weather(spark, d).select(sev.alias("severity"), fw.severity_label(sev).alias("label"))
    return out.groupBy("severity", "label").agg(F.count(F.lit(1)).alias("n"))


@query
def weather_flags(spark, d):
    daily = starschema.daily_weather(starschema.hourly_weather(spark, d))
    return ow.process_weather(daily).select(
        "date", "airport", "condition", "severity", "has_precipitation", "has_snow", "is_adverse", "temp_range",
        "precip_total", "rain", "snowfall",
    )


@query
def hourly_to_daily(spark, d):
    return ow.hourly_to_daily(starschema.hourly_weather(spark, d))


@query
def merge_hourly_into_daily(spark, d):
    hourly = starschema.hourly_weather(spark, d)
    daily = ow.process_weather(starschema.daily_weather(hourly))
    stale = daily.withColumn("storm_hours", F.lit(-1))
    rollup = ow.hourly_to_daily(hourly).filter(F.dayofmonth("date") != 7)
    return ow.merge_hourly_into_daily(stale, rollup).select(
        "date", "airport", "severity", *config.HOURLY_ROLLUP_COLUMNS
    )


@query
def join_weather_two_sided(spark, d):
    joined = ow.join_weather_two_sided(b.panel(spark, d), b.calendar_weather(spark, d))
    return joined.select("route", "date", *[f"apt{n}_{c}" for n in (1, 2) for c in config.WEATHER_COLUMNS])


@query
def weather_pair_features(spark, d):
    return b.weather_panel(spark, d).select(
        "route", "date", "weather_severity_max", "weather_severity_combined", "has_adverse_weather", "total_precip",
        "total_snowfall", "max_wind", *config.HOURLY_ROLLUP_COLUMNS,
    )


@query
def weather_match_rate(spark, d):
    return ow.match_rate(b.weather_panel(spark, d))


@query
def weather_json_daily(spark, d):
    """Daily readings packed into one payload per airport, landed as JSON lines and parsed back."""
    daily = starschema.daily_weather(starschema.hourly_weather(spark, d))
    path = scratch_path(spark, "payload")
    sw.pack_payload(daily, "daily", sw.DAILY_FIELDS, "date", "yyyy-MM-dd").write.json(path)
    return sw.parse_daily_payload(spark.read.schema("airport string, payload string").json(path))


@query
def weather_json_hourly(spark, d):
    """Hourly readings (the windiest of each hour) packed into payloads and parsed back."""
    hour = F.date_trunc("hour", "datetime").cast("timestamp_ntz").alias("datetime")
    hourly = starschema.hourly_weather(spark, d).groupBy(hour, "airport").agg(
        *[F.max(c).alias(c) for c in sw.HOURLY_FIELDS]
    )
    path = scratch_path(spark, "payload")
    sw.pack_payload(hourly, "hourly", sw.HOURLY_FIELDS, "datetime", "yyyy-MM-dd'T'HH:mm").write.json(path)
    rows = sw.parse_hourly_payload(spark.read.schema("airport string, payload string").json(path))
    return rows.select(F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("datetime"), "airport", *sw.HOURLY_FIELDS)


@query
def missing_keys_resume(spark, d):
    """Days of each origin without weather: no reading stands for the last days of long months."""
    fl = starschema.flights(spark, d, carrier=False, distance=False, dest=False)
    expected = fl.select(F.col("ORIGIN").alias("airport"), F.col("FL_DATE").alias("date"))
    return sw.missing_keys(expected, b.calendar_weather(spark, d), ["airport", "date"])


@query
def land_weather(spark, d):
    """Daily weather landed airport by airport in two runs: the first ends after one batch, the second goes on from there."""
    daily = stage(starschema.daily_weather(starschema.hourly_weather(spark, d)).select("airport", "date", "wind_speed_max", "temp_max"), "daily")
    path = scratch_path(spark, "landing")
    fetch = lambda keys: daily.join(keys, "airport", "left_semi")
    land(daily, fetch, path, batch_keys=2, max_batches=1)
    land(daily, fetch, path, batch_keys=2)
    return read_landed(spark, path, "airport string, date date, wind_speed_max double, temp_max double")


@query
def missing_airports(spark, d):
    """Days of either end of a route without weather."""
    ends = b.delays(spark, d).select(F.explode(F.array("ORIGIN", "DEST")).alias("airport"), F.col("FL_DATE").alias("date"))
    return sw.missing_keys(ends, b.calendar_weather(spark, d), ["airport", "date"])


@query
def dedup_keep_first(spark, d):
    """Half a month already landed wins over a re-fetch with changed values."""
    daily = starschema.daily_weather(starschema.hourly_weather(spark, d)).select("airport", "date", "wind_speed_max", "temp_max")
    existing = daily.filter(F.dayofmonth("date") <= 15)
    fetched = daily.filter(F.dayofmonth("date") >= 10).withColumn("wind_speed_max", F.col("wind_speed_max") + 1000)
    return sw.keep_first(existing, fetched)


@query
def severe_share_by_month(spark, d):
    return ow.severe_share(b.calendar_weather(spark, d), "month")


@query
def severe_share_by_airport(spark, d):
    return ow.severe_share(b.calendar_weather(spark, d), "airport")


@query
def severe_share_seasons(spark, d):
    return ow.severe_share_summary(b.calendar_weather(spark, d))


@query
def price_quantiles(spark, d):
    """Quantiles over all line items, per return flag: groups far larger than a task should hold."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    return exact_quantiles(lines, ["l_returnflag"], "l_extendedprice", [0.05, 0.25, 0.5, 0.75, 0.999])


@query
def value_counts_pct(spark, d):
    cond = starschema.hourly_weather(spark, d).select(fw.weather_condition("weather_code").alias("condition"))
    return oi.value_counts(cond, "condition")


# ---- calendar -------------------------------------------------------------------------------------------------


@query
def calendar_features(spark, d):
    days = b.flight_days(spark, d)
    return of.temporal_features(days)


@query
def school_break(spark, d):
    days = b.flight_days(spark, d)
    return days.select("date", cal.school_break().alias("is_school_break"))


def _holidays(spark, d):
    return of.holiday_features(b.flight_days(spark, d), cal.federal_holidays(spark, *b.HOLIDAY_YEARS))


@query
def holiday_asof_next(spark, d):
    return _holidays(spark, d).select("date", "days_to_holiday")


@query
def holiday_asof_prev(spark, d):
    return _holidays(spark, d).select("date", "days_from_holiday")


@query
def holiday_semi_flag(spark, d):
    return _holidays(spark, d).select("date", "is_federal_holiday")


@query
def holiday_week(spark, d):
    return _holidays(spark, d).select("date", "is_holiday_week")


@query
def period_flags(spark, d):
    days = b.flight_days(spark, d)
    return of.era_features(days, b.CUT)


@query
def era_label(spark, d):
    days = b.flight_days(spark, d)
    return days.select("date", cal.era_label(b.CUT).alias("era"), cal.era_label(b.CUT, with_recovery=True).alias("period"))


@query
def segment_columns(spark, d):
    days = b.flight_days(spark, d)
    return days.select("date", cal.day_type().alias("day_type"), cal.season().alias("season"))


# ---- features -------------------------------------------------------------------------------------------------


@query
def lags(spark, d):
    out = of.lag_features(b.panel(spark, d))
    return out.select("route", "date", *[f"lag_{k}_arr_delay" for k in config.LAGS])


@query
def rolling_mean(spark, d):
    out = of.lag_features(b.panel(spark, d))
    return out.select("route", "date", "rolling_mean_7_arr_delay", "rolling_mean_14_arr_delay")


@query
def rolling_std(spark, d):
    out = of.lag_features(b.panel(spark, d))
    return out.select("route", "date", "rolling_std_7_arr_delay", "rolling_std_14_arr_delay")


@query
def ewm(spark, d):
    return of.lag_features(b.panel(spark, d)).select("route", "date", "ewm_7_arr_delay")


@query
def route_code(spark, d):
    return of.route_code(b.staged_panel(spark, d)).groupBy("route", "route_encoded").agg(F.count(F.lit(1)).alias("n"))


@query
def train_route_stats(spark, d):
    """Training-only statistics of each route, as seen on its rows."""
    out = of.train_route_stats(b.panel(spark, d), b.CUT.train_end)
    return out.groupBy("route", *config.ROUTE_FEATURES[1:]).agg(F.count(F.lit(1)).alias("n"))


@query
def train_stats_join(spark, d):
    out = of.train_route_stats(b.panel(spark, d), b.CUT.train_end)
    return out.select("route", "date", "flight_count", *config.ROUTE_FEATURES[1:])


@query
def impute_weather(spark, d):
    out = of.impute_weather(b.weather_panel(spark, d), b.CUT.train_end)
    return out.select("route", "date", "apt1_severity", "apt1_temp_avg", "apt2_temp_avg", "max_wind", "weather_severity_max")


@query
def weather_derived(spark, d):
    out = of.weather_derived(of.impute_weather(b.weather_panel(spark, d), b.CUT.train_end))
    return out.select("route", "date", "severe_weather_level", "both_clear", "weather_diff")


@query
def weather_lags(spark, d):
    out = of.weather_lags(of.impute_weather(b.weather_panel(spark, d), b.CUT.train_end))
    return out.select("route", "date", *[f"weather_severity_lag_{k}" for k in config.WEATHER_LAGS])


@query
def impute_lags(spark, d):
    out = of.impute_lags(of.lag_features(b.panel(spark, d)), b.CUT.train_end)
    return out.select("route", "date", *config.LAG_FEATURES)


@query
def build_features(spark, d):
    """The whole feature table: 63 model features and the target."""
    return b.features(spark, d).select("route", "date", config.TARGET, *config.TABULAR_FEATURES)


@query
def ablation_features(spark, d):
    """The feature table without weather."""
    return b.features(spark, d).select("route", "date", *of.ablated(config.TABULAR_FEATURES))


@query
def split_by_time(spark, d):
    out = oc.split_by_time(of.lag_features(b.panel(spark, d)), b.CUT, ["lag_28_arr_delay", config.TARGET])
    return out.groupBy("route", "split").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


@query
def drop_incomplete(spark, d):
    out = oc.drop_incomplete(of.lag_features(b.panel(spark, d)), config.LAG_FEATURES)
    return out.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"))


# ---- baselines ------------------------------------------------------------------------------------------------


def _history(spark, d):
    return b.staged_panel(spark, d).select("route", "date", config.TARGET)


@query
def naive_fit(spark, d):
    """Training medians per route and, under a null route, over all rows."""
    train = _history(spark, d).filter(F.col("date") < cal.day(b.CUT.train_end))
    return ob.fit_medians(train)


@query
def naive_forecast(spark, d):
    return ob.predict(_history(spark, d), {"pred": ob.naive()}, b.CUT.train_end)


@query
def seasonal_naive(spark, d):
    return ob.predict(_history(spark, d), {"pred": ob.seasonal_naive()}, b.CUT.train_end)


@query
def moving_average(spark, d):
    models = {f"ma_{k}": ob.moving_average(window=k) for k in (7, 14, 28)}
    return ob.predict(_history(spark, d), models, b.CUT.train_end)


@query
def map_lookup_fill(spark, d):
    """The weekly forecast with the training median where there is none, and whether it was needed."""
    history = _history(spark, d)
    own = ob.predict(history, {"own": ob.seasonal_naive()}).select("route", "date", F.col("own").isNull().cast("int").alias("filled"))
    out = ob.predict(history, {"pred": ob.seasonal_naive()}, b.CUT.train_end)
    return out.select("route", "date", "pred").join(own, ["route", "date"])


@query
def naive_in_split(spark, d):
    """Fold predictions that look back only inside the test slice, with fallback; one slice overlaps two others."""
    return fo.fold_baselines(b.staged_panel(spark, d), b.OVERLAPPING)


@query
def naive_no_fallback(spark, d):
    models = {"naive": ob.naive(), "ma": ob.moving_average(window=7)}
    return ob.predict_in_slice(b.panel(spark, d), models, b.CUT.test_start)


@query
def baseline_from_features(spark, d):
    return ob.from_features(of.lag_features(b.panel(spark, d)), b.CUT.test_start)


# ---- evaluation -----------------------------------------------------------------------------------------------


@query
def error_columns(spark, d):
    return b.errors(spark, d).select("route", "date", "model", "error", "abs_error", "pct_error")


@query
def metrics_basic(spark, d):
    return oe.basic_metrics(b.predictions(spark, d), ["model"])


@query
def metrics_delay(spark, d):
    return oe.delay_metrics(b.staged_predictions(spark, d), ["model"])


@query
def metrics_overall(spark, d):
    """One row over all models: the widest group there is."""
    return oe.delay_metrics(b.staged_predictions(spark, d))


@query
def metrics_by_segment(spark, d):
    return oe.basic_metrics(b.errors(spark, d), ["model", "time_period", "day_type"])


@query
def metrics_by_all_segments(spark, d):
    return oe.metrics_by_segments(b.errors(spark, d))


@query
def forecast_metrics_by_route(spark, d):
    """Published metrics per model and busiest route, and per model over all routes, where the late model has a value."""
    merged, shown = stage(_two_models(spark, d), "merged"), stage(op.top_routes(b.panel(spark, d), 5, weight="flight_count"), "shown")
    return publish.forecast_metrics(merged, ["naive", "ma_7", "smooth", "weekly"], shown, ["smooth"])


@query
def metrics_by_route(spark, d):
    return oe.basic_metrics(b.errors(spark, d), ["model", "route"])


@query
def metrics_by_time_period(spark, d):
    """By era: the naive forecast over the whole history."""
    preds = ob.predict(b.panel(spark, d).select("route", "date", config.TARGET), {"pred": ob.naive()})
    return oe.basic_metrics(oe.error_columns(preds.withColumnRenamed(config.TARGET, "actual"), b.CUT), ["time_period"])


@query
def metrics_by_day_type(spark, d):
    return oe.basic_metrics(b.errors(spark, d), ["model", "day_type"])


@query
def metrics_by_season(spark, d):
    return oe.basic_metrics(b.errors(spark, d), ["model", "season"])


@query
def assign_folds(spark, d):
    rows = fo.assign_folds(b.panel(spark, d).select("route", "date"), b.CUT.folds)
    return rows.groupBy("fold", "role", "route").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


@query
def walk_forward_eval(spark, d):
    """Delay metrics of the baselines on every fold."""
    return walk_forward(b.staged_panel(spark, d), b.CUT.folds)


def _fold_metrics(spark, d):
    return walk_forward(b.staged_panel(spark, d), b.CUT.folds)


@query
def fold_summary(spark, d):
    out = oe.fold_summary(_fold_metrics(spark, d))
    return out.select("model", "metric", "mean", "std", *[F.col("folds")[i].alias(f"fold_{i + 1}") for i in range(4)])


@query
def worst_forecasts(spark, d):
    naive = b.errors(spark, d).filter("model = 'naive'")
    return oe.worst_forecasts(naive, 10)


@query
def residuals_over_time(spark, d):
    return oe.residuals_over_time(b.errors(spark, d).filter("model = 'ma_7'"))


@query
def segment_box_stats(spark, d):
    return oe.segment_box_stats(stage(b.errors(spark, d), "errors"), "season")


@query
def segment_box_stats_by_model(spark, d):
    return oe.segment_box_stats(stage(b.errors(spark, d), "errors"), "model")


@query
def mae_route_season_pivot(spark, d):
    return oe.mae_route_season(b.errors(spark, d).filter("model = 'ma_7'"))


@query
def seasonal_stats(spark, d):
    return oe.seasonal_stats(b.errors(spark, d).filter("model = 'ma_7'"))


FAMILIES = {"smooth": ["ma_7", "ma_14", "ma_28"], "last": ["naive", "seasonal_7"]}


@query
def family_gap(spark, d):
    return oe.family_gap(b.errors(spark, d), FAMILIES)


@query
def family_gap_by_season(spark, d):
    return oe.family_gap(b.errors(spark, d), FAMILIES, by=("season",))


@query
def paired_t_test(spark, d):
    return oe.paired_t_test(b.predictions(spark, d), ["ma_7", "ma_14", "ma_28", "naive", "seasonal_7"])


@query
def route_metric_extremes(spark, d):
    by_route = oe.delay_metrics(b.predictions(spark, d), ["model", "route"])
    return oe.route_metric_extremes(by_route, "mae")


@query
def fit_improvement(spark, d):
    metrics = stage(oe.delay_metrics(b.staged_predictions(spark, d), ["model"]), "metrics")
    return oe.improvement(metrics)


@query
def loss_argmin(spark, d):
    """Lowest fold error of each baseline over the folds."""
    trials = stage(_fold_metrics(spark, d), "trials")
    return oe.loss_argmin(trials, ("model",), "fold", "mae")


@query
def leaderboard(spark, d):
    return oe.leaderboard(oe.delay_metrics(b.staged_predictions(spark, d), ["model"]), ("naive", "seasonal_7"))


@query
def canonical_model_order(spark, d):
    metrics = oe.basic_metrics(b.predictions(spark, d), ["model"])
    return oe.canonical_order(metrics.select("model", "mae"), ["ma_7", "ma_14", "naive"])


# ---- prediction tables ----------------------------------------------------------------------------------------


def _two_models(spark, d):
    panel = b.staged_panel(spark, d)
    wide = stage(b.wide_predictions(panel), "wide")
    late = wide.filter(F.col("date") >= cal.day("2000-08-01"))
    models = {
        "smooth": late.select("route", "date", F.col("ma_28").alias("pred")),
        "weekly": wide.select("route", "date", F.col("seasonal_7").alias("pred")),
    }
    return pr.merge_predictions(wide.select("route", "date", "actual", "naive", "ma_7"), models)


@query
def merge_predictions(spark, d):
    return _two_models(spark, d)


@query
def align_predictions(spark, d):
    return pr.align_predictions(_two_models(spark, d), ["smooth"]).select("route", "date", "actual", "smooth")


@query
def history_plus_forecast(spark, d):
    panel = b.staged_panel(spark, d)
    forecast = b.wide_predictions(panel).select("route", "date", "actual", F.col("ma_7").alias("pred"))
    return pr.history_plus_forecast(panel, forecast, b.CUT.test_start)


def _series(spark, d):
    panel = b.staged_panel(spark, d)
    forecast = b.wide_predictions(panel).select("route", "date", "actual", F.col("ma_7").alias("pred"))
    return stage(pr.history_plus_forecast(panel, forecast, b.CUT.test_start), "series")


@query
def brush_range(spark, d):
    return oc.brush_range(_series(spark, d), b.CUT.test_start)


@query
def brush_y_extent(spark, d):
    return oc.y_extent(oc.brush_range(_series(spark, d), b.CUT.test_start))


@query
def city_pairs(spark, d):
    return pr.city_pairs(b.delays(spark, d).select("route").distinct())


@query
def directional_routes(spark, d):
    return pr.directional_routes(pr.city_pairs(b.delays(spark, d).select("route").distinct()))


@query
def city_pair_hit_rate(spark, d):
    panel = b.staged_panel(spark, d)
    preds = ob.to_long(b.wide_predictions(panel), b.MODELS).filter("model = 'ma_28'")
    return pr.city_pair_hit_rate(panel.select("route").distinct(), oe.delay_metrics(preds, ["route"]))


# ---- insights -------------------------------------------------------------------------------------------------


@query
def weather_impact_by_severity(spark, d):
    return oi.weather_impact(of.impute_weather(b.weather_panel(spark, d), b.CUT.train_end))


@query
def weighted_corr(spark, d):
    return oi.weather_correlations(b.weather_panel(spark, d))


@query
def corr_by_abs(spark, d):
    ranked = oi.weather_correlations(b.weather_panel(spark, d))
    order = W.partitionBy(F.lit(0)).orderBy(F.desc(F.abs("correlation")), "variable")
    return ranked.select("variable", F.row_number().over(order).alias("rank"))


@query
def top_carriers(spark, d):
    return oi.top_carriers(b.carriers(spark, d), excluded=b.EXCLUDED_CARRIERS)


@query
def carrier_performance(spark, d):
    return oi.carrier_performance(b.carriers(spark, d), excluded=b.EXCLUDED_CARRIERS)


@query
def carrier_cancel_join(spark, d):
    """Delay statistics over completed flights next to the cancel rate over all flights."""
    return oi.carrier_performance(b.carriers(spark, d), excluded=b.EXCLUDED_CARRIERS).select("code", "avg_delay", "n_flights", "cancel_rate")


@query
def legend_label(spark, d):
    """Carrier names with corporate suffixes, as legends show them."""
    names = b.carriers(spark, d).groupBy("REPORTING_AIRLINE").agg(F.count(F.lit(1)).alias("n"))
    full = F.concat(F.col("REPORTING_AIRLINE"), F.lit("  Air Co, Inc."))
    return names.select("REPORTING_AIRLINE", full.alias("name")).select(
        "REPORTING_AIRLINE", tx.legend_label("name").alias("label"), tx.carrier_name("REPORTING_AIRLINE").alias("carrier")
    )


@query
def sort_carriers(spark, d):
    return oi.sort_carriers(oi.carrier_performance(b.carriers(spark, d), excluded=b.EXCLUDED_CARRIERS), "avg_delay").select("code", "rank", "avg_delay")


@query
def mean_by_key(spark, d):
    keyed = b.weather_panel(spark, d).withColumns({
        "day_of_week": F.weekday("date"), "month": F.month("date"),
        "severity": F.col("weather_severity_max").cast("int"),
        "period": cal.era_label(b.CUT, with_recovery=True),
    })
    return oi.mean_by_keys(keyed, ["date", "day_of_week", "month", "route", "severity", "period"])


@query
def mean_by_holiday(spark, d):
    days = of.holiday_features(b.panel(spark, d), cal.federal_holidays(spark, *b.HOLIDAY_YEARS))
    return oi.mean_by_keys(days, ["is_federal_holiday", "is_school_break"])


@query
def severity_spine_mean(spark, d):
    return oi.severity_spine_mean(b.weather_panel(spark, d))


@query
def era_means(spark, d):
    return oi.era_means(b.panel(spark, d), b.CUT)


@query
def route_summary_stats(spark, d):
    return oi.route_summary(b.panel(spark, d))


@query
def snow_days(spark, d):
    return oc.snow_days(b.weather_panel(spark, d))


@query
def daily_mean_rolling30(spark, d):
    return op.rolling_daily_mean(b.panel(spark, d))


@query
def corr_matrix(spark, d):
    return oi.correlation_matrix(b.weather_panel(spark, d))


@query
def target_correlations(spark, d):
    return oi.target_correlations(b.weather_panel(spark, d))


@query
def lag_correlations(spark, d):
    out = of.lag_features(b.panel(spark, d))
    return oi.correlation_matrix(out, [config.TARGET, *[f"lag_{k}_arr_delay" for k in config.LAGS]])


@query
def histogram(spark, d):
    return oi.histogram(b.staged_panel(spark, d), config.TARGET)


@query
def autocorrelation(spark, d):
    return oi.autocorrelation(op.daily_series(b.panel(spark, d)))


@query
def autocorrelation_by_route(spark, d):
    return oi.autocorrelation(b.panel(spark, d), key="route")


@query
def partial_autocorrelation(spark, d):
    return oi.partial_autocorrelation(oi.autocorrelation(op.daily_series(b.panel(spark, d))))


IMPORTANCE_COLUMNS = [*config.TABULAR_FEATURES, "flight_count"]


def _importance(spark, d):
    recent = F.col("date") >= cal.day(b.CUT.test_start)
    table = oi.correlation_importance(b.features(spark, d), IMPORTANCE_COLUMNS, splits={"train": ~recent, "test": recent})
    return stage(table, "importance")


@query
def importance_share(spark, d):
    return oi.importance_share(_importance(spark, d))


@query
def feature_rank(spark, d):
    return oi.feature_rank(_importance(spark, d))


@query
def importance_category_join(spark, d):
    return oi.with_category(_importance(spark, d))


@query
def importance_by_category(spark, d):
    return oi.importance_by_category(_importance(spark, d))


# ---- scaling and sequences ------------------------------------------------------------------------------------

def _sequence_rows(spark, d):
    """The 26 sequence features, staged."""
    return stage(b.features(spark, d).select("route", "date", *config.SEQUENCE_FEATURES), "sequence-rows")


def _steps(windows):
    """Every step of every matrix, as rows."""
    steps = windows.select("route", "date", "target", F.posexplode("x").alias("step", "f"))
    cells = [F.col("f")[i].alias(f"x_{c}") for i, c in enumerate(config.SEQUENCE_FEATURES)]
    return steps.select("route", "date", "step", "target", *cells)


@query
def standard_scaler(spark, d):
    """Training statistics of all sequence features, z-scores with them, and the way back."""
    rows = _sequence_rows(spark, d)
    columns = config.SEQUENCE_FEATURES
    stats = stage(fo.scaler_stats(rows.filter(F.col("date") < cal.day(b.CUT.train_end)), columns), "scaler")
    scaled = fo.scale(rows, stats, columns).withColumn("back", F.col(config.TARGET))
    out = fo.inverse_scale(scaled, stats, config.TARGET, ["back"])
    return out.select("route", "date", *columns, "back")


@query
def sequence_windows(spark, d):
    return _steps(fo.sequence_windows(_sequence_rows(spark, d), config.SEQUENCE_FEATURES, start=b.CUT.test_start, end=b.CUT.test_end))


@query
def sequence_windows_in_split(spark, d):
    return _steps(fo.sequence_windows(
        _sequence_rows(spark, d), config.SEQUENCE_FEATURES, start=b.CUT.test_start, end=b.CUT.test_end, in_split=True
    ))


# ---- files in and out -----------------------------------------------------------------------------------------


def _flight_files(spark, d):
    """The flights as CSV files with two headers: one carrier column name before 1998, the other one after."""
    path = scratch_path(spark, "flights-csv")
    fl = stage(b.flights(spark, d).drop("route").withColumn("TAIL_NUM", F.lit("N1")), "flights")
    early = F.col("FL_DATE") < cal.day("1998-01-01")
    fl.filter(early).write.option("header", True).csv(f"{path}/early")
    fl.filter(~early).withColumnRenamed("REPORTING_AIRLINE", "OP_UNIQUE_CARRIER").write.option("header", True).csv(f"{path}/late")
    return f"{path}/*/*.csv"


@query
def scan_flights_csv(spark, d):
    """Flight files of two layouts read by name, cleaned and aggregated."""
    raw = sf.scan_flights_csv(spark, _flight_files(spark, d))
    return oc.clean_flights(raw).groupBy("route", "REPORTING_AIRLINE").agg(
        F.count(F.lit(1)).alias("n"), F.sum("CANCELLED").alias("cancelled"), F.sum("ARR_DELAY").alias("arr_delay")
    )


@query
def scan_all_columns(spark, d):
    """All columns as they stand in the files, summed per layout, day and destination."""
    raw = sf.scan_all_columns(spark, _flight_files(spark, d))
    return raw.groupBy("TAIL_NUM", F.col("OP_UNIQUE_CARRIER").isNull().cast("int").alias("early"), "FL_DATE", "DEST").agg(
        F.count(F.lit(1)).alias("n"), F.count("REPORTING_AIRLINE").alias("n_reporting"), F.count("ARR_DELAY").alias("n_arrived"),
        F.sum(F.col("DEP_DELAY").cast("double")).alias("dep_delay"), F.sum(F.col("DISTANCE").cast("double")).alias("distance"),
    )


@query
def union_files(spark, d):
    """Bag union by name: a column one side lacks is null there."""
    fl = b.flights(spark, d)
    early = F.col("FL_DATE") < cal.day("1998-01-01")
    both = fl.filter(early).drop("DISTANCE").unionByName(fl.filter(~early), allowMissingColumns=True)
    return both.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.count("DISTANCE").alias("n_distance"))


@query
def scan_weather(spark, d):
    """Daily weather written as CSV and read with its schema."""
    daily = starschema.daily_weather(starschema.hourly_weather(spark, d)).select(*sw.DAILY_SCHEMA.fieldNames())
    path = scratch_path(spark, "weather-csv")
    daily.write.option("header", True).csv(path)
    return sw.scan_weather(spark, path)


@query
def scan_features(spark, d):
    """Lag features written as a table and read back: only the used columns are scanned."""
    path = scratch_path(spark, "features")
    st.write_panel(of.lag_features(b.panel(spark, d)), path)
    return st.read_panel(spark, path).select("route", "date", "lag_7_arr_delay", "ewm_7_arr_delay")


@query
def sink_panel(spark, d):
    """The panel written by route, as Parquet and as CSV, and read back."""
    panel = b.panel(spark, d).select("route", "date", "flight_count", "avg_arr_delay")
    path, text = scratch_path(spark, "panel-out"), scratch_path(spark, "panel-csv")
    st.write_panel(panel, path)
    st.write_panel(panel, text, "csv")
    n = st.read_panel(spark, text, panel.schema, "csv").groupBy("route").agg(F.count(F.lit(1)).alias("n_csv"))
    out = st.read_panel(spark, path).groupBy("route").agg(
        F.count(F.lit(1)).alias("n"), F.sum("flight_count").alias("flights"), F.avg("avg_arr_delay").alias("delay")
    )
    return out.join(n, "route")


def _forecast_files(spark, d):
    panel = b.staged_panel(spark, d)
    wide = stage(b.wide_predictions(panel), "wide")
    shown = stage(op.top_routes(panel, 5, weight="flight_count"), "shown")
    path = scratch_path(spark, "forecast")
    metrics = publish.forecast_metrics(wide, b.MODELS, shown)
    folds = publish.published_metrics(walk_forward(panel, b.CUT.folds))
    publish.write_forecast(panel, wide, shown, b.MODELS, b.CUT, path, metrics, folds)
    return path


@query
def sink_nested_forecast(spark, d):
    """Forecast documents of the busiest routes, written and read back: every day of history and forecast."""
    docs = publish.read_forecast(spark, _forecast_files(spark, d), b.MODELS)
    ahead = docs.select("route", F.inline("predictions")).withColumn("part", F.lit("forecast"))
    return ahead.unionByName(docs.select("route", F.inline("historical")).withColumn("part", F.lit("history")), allowMissingColumns=True)


@query
def sink_forecast_sections(spark, d):
    """The metrics and walk-forward sections of the forecast, read back."""
    path = _forecast_files(spark, d)
    values = "mae double, within_15 double, rmse double, mape double, median_ae double, threshold_acc double, r2 double"
    metrics = publish.read_section(spark, path, "metrics", f"model string, route string, {values}")
    folds = publish.read_section(spark, path, "walk_forward", f"model string, fold int, {values}")
    return metrics.withColumnRenamed("route", "key").unionByName(folds.withColumn("key", F.col("fold").cast("string")).drop("fold"))


@query
def forecast_metadata(spark, d):
    return publish.metadata(b.panel(spark, d), b.CUT)


@query
def sink_report(spark, d):
    """The error report of the moving average, written and read back."""
    errors = stage(b.errors(spark, d).filter("model = 'ma_7'"), "errors")
    path = scratch_path(spark, "report")
    report = publish.error_report(errors)
    write_version({"report": report}, path)
    return publish.read_section(spark, path, "report", report.schema)


@query
def sink_analysis(spark, d):
    """The analysis documents written as JSON lines and read back: every number of every section."""
    feats = stage(b.features(spark, d).select("date", *config.TABULAR_FEATURES, config.TARGET, "flight_count"), "features")
    importance = stage(oi.correlation_importance(feats, IMPORTANCE_COLUMNS), "importance")
    path = scratch_path(spark, "analysis")
    write_version({"analysis": publish.analysis_documents(feats, b.carriers(spark, d), importance, excluded=b.EXCLUDED_CARRIERS)}, path)
    docs = publish.read_section(spark, path, "analysis", "name string, section string, body string")
    entries = docs.select("name", "section", F.explode(F.from_json("body", "array<map<string, string>>")).alias("e"))
    label = F.coalesce(F.col("e")["severity"], F.col("e")["variable"], F.col("e")["code"], F.col("e")["feature"])
    numbers = ["avg_delay", "n_flights", "high_delay_pct", "correlation", "on_time_pct", "cancel_rate", "severe_delay_pct", "share", "rank", "n_features"]
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col("e")[n].cast("double").alias("value")) for n in numbers])
    return entries.select("name", "section", label.alias("label"), F.inline(cells)).filter("value is not null")


# ---- models ---------------------------------------------------------------------------------------------------

#: Trials of the registered search, as many as ``sample_settings`` makes by default and as the reference's search.
TRIALS = 50
#: Settings under which the first split is exact arithmetic on sums: no sampling, both penalties, a least weight.
EXACT = {"n_estimators": 1, "max_depth": 1, "learning_rate": 0.5, "subsample": 1.0, "colsample_bytree": 1.0, "reg_alpha": 5.0, "reg_lambda": 2.0, "min_child_weight": 20}
#: Features of few values, whose cuts are all their values.
FEW = [f for f in config.TABULAR_FEATURES if f in config.CALENDAR_FEATURES + config.ERA_FEATURES]


def _split_features(spark, d):
    rows = oc.split_by_time(b.features(spark, d), b.CUT, [*config.TABULAR_FEATURES, config.TARGET])
    return stage(rows.select("route", "date", "split", config.TARGET, *config.TABULAR_FEATURES), "split")


def _beats_last_value(scored, keys):
    """Per key the scored rows and whether their mean squared error, which the trees minimise, is below that of yesterday's
    value."""
    error = lambda c: F.avg((F.col(c) - F.col("actual")) ** 2)
    return scored.groupBy(*keys).agg(F.count("pred").alias("n_scored"), (error("pred") < error("lag_1_arr_delay")).cast("int").alias("beats_naive"))


@query
def fit_gbt(spark, d):
    """A boosted model on all 63 features: per feature the rows it was fitted on, their mean, the sum of all importances, the
    best first cut under fixed penalties, and whether the model's validation error is below that of the mean."""
    rows = _split_features(spark, d)
    model = fc.fit_gbt(rows, config.TABULAR_FEATURES)
    table = fc.importance_table(spark, model, config.TABULAR_FEATURES, "gbt")
    counts = rows.agg(
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "val").alias("n_val"),
        F.avg(F.when(F.col("split") == "val", (F.col(config.TARGET) - model.base) ** 2)).alias("of_mean"),
    ).first()
    total, reached = float(model.importances.sum()), min(square for square, _ in model.history)
    first = bo.first_cuts(rows, FEW, config.TARGET, F.col("split") == "train", fc.gbt_settings(EXACT))
    root = spark.createDataFrame([(f, float(c.gain), int(c.rows)) for f, c in first.items()], "feature string, root_gain double, root_rows long")
    return table.join(root, "feature", "left").select(
        "model", "feature", F.lit(counts.n_train).alias("n_train"), F.lit(counts.n_val).alias("n_val"), F.lit(model.base).alias("base"),
        F.lit(round(total, 6)).alias("total"), "root_gain", "root_rows", F.lit(int(reached < counts.of_mean)).alias("beats_mean"),
    )


@query
def predict_tabular(spark, d):
    """Every test row with its actual value, whether the full model scored it, and the prediction of a model of one split."""
    rows = _split_features(spark, d)
    test = rows.filter("split = 'test'")
    model = fc.fit_gbt(rows, config.TABULAR_FEATURES)
    single = fc.fit_gbt(rows.withColumn("split", F.when(F.col("split") == "train", "train")), FEW, EXACT)
    scored = fc.predict_tabular(model, test, config.TABULAR_FEATURES)
    by_one = fc.predict_tabular(single, test, FEW).select("route", "date", F.col("pred").alias("first_split"))
    return scored.join(by_one, ["route", "date"]).select("route", "date", "actual", F.col("pred").isNotNull().cast("int").alias("scored"), "first_split")


@query
def walk_forward_gbt(spark, d):
    """Boosted trees on all features on every fold: rows scored, and the error against yesterday's value."""
    rows = stage(b.features(spark, d).select("route", "date", config.TARGET, *config.TABULAR_FEATURES), "features")
    preds = fc.walk_forward_gbt(rows, config.TABULAR_FEATURES, b.CUT.folds)
    return _beats_last_value(preds.join(rows.select("route", "date", "lag_1_arr_delay"), ["route", "date"]), ["model", "fold"])


@query
def tune_gbt(spark, d):
    """The guided search over the documented space: all 50 trials by their validation error."""
    return fc.tune_gbt(_split_features(spark, d), config.TABULAR_FEATURES, TRIALS)


@query
def ablation(spark, d):
    """Boosted trees with all features and without the 28 of the weather."""
    rows = _split_features(spark, d)
    preds = fc.ablation_predictions(rows, config.TABULAR_FEATURES, config.WEATHER_FEATURES)
    return _beats_last_value(preds.join(rows.select("route", "date", "lag_1_arr_delay"), ["route", "date"]), ["model"])


@query
def fit_seasonal_regression(spark, d):
    """One seasonal regression per route: rows it scores, and the largest gradient left by its weights over the training rows."""
    panel = b.staged_panel(spark, d)
    train = panel.filter(F.col("date") < cal.day(b.CUT.val_end))
    test = panel.filter(F.col("date") >= cal.day(b.CUT.test_start))
    holidays = cal.federal_holidays(spark, *b.HOLIDAY_YEARS)
    preds = fc.seasonal_regression(train, test, holidays)
    left = fc.seasonal_gradient(train, holidays)
    scored = preds.groupBy("route").agg(F.count("pred").alias("n_scored"))
    return scored.join(left, "route").select("route", "n_scored", "n_train", F.round("gradient", 3).alias("gradient"))


@query
def score_sequences(spark, d):
    """A linear model over scaled windows: the mean of the last week, scaled back."""
    panel, cols = _sequence_rows(spark, d), config.SEQUENCE_FEATURES
    stats = stage(fo.scaler_stats(panel.filter(F.col("date") < cal.day(b.CUT.train_end)), cols), "scaler")
    windows = fo.sequence_windows(fo.scale(panel, stats, cols), cols, start=b.CUT.test_start, end=b.CUT.test_end)
    weights = [[1 / 7 if step >= 21 and c == config.TARGET else 0.0 for c in cols] for step in range(28)]
    scored = fc.score_sequences(windows, fc.linear_scorer(weights), 28, len(cols))
    return fo.inverse_scale(scored, stats, config.TARGET, ["target", "pred"])


@query
def score_recurrent(spark, d):
    """A recurrent network over raw windows. Its gates are held open, so it adds up tanh(x / 100) over the 28 days."""
    blocks = stage(fo.sequence_blocks(b.staged_panel(spark, d), [config.TARGET], start=b.CUT.test_start, end=b.CUT.test_end), "blocks")
    open_gates = rn.Network({"lstm0_input": [[0.0], [0.0], [0.01], [0.0]], "lstm0_hidden": np.zeros((4, 1)), "lstm0_bias": [[60.0, 60.0, 0.0, 60.0]]})
    weights = stage(open_gates.to_table(spark), "weights")
    return rn.score_blocks(blocks, rn.Network.from_table(weights))
