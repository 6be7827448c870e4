"""Forecast metrics by segment, summaries over folds, comparisons between models.

Input is the long prediction table (route, date, model, actual, pred).
"""

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.config import DELAY_THRESHOLD
from panelcast.functions import calendar as cal
from panelcast.functions import metrics as m
from panelcast.functions.stats import exact_median, exact_quantiles, stack_long, t_two_sided

# Display order of models and whether a larger metric is better.
MODEL_ORDER = ["xgboost", "lightgbm", "tcn", "lstm", "naive", "ma"]
HIGHER_IS_BETTER = ["within_15", "threshold_acc", "r2"]
SUMMARY_METRICS = ["mae", "rmse", "r2", "within_15", "median_ae"]


def basic_metrics(preds: DataFrame, by=()) -> DataFrame:
    """rmse, mae, mape, r2 and n per segment. Sums only, so any segment may be huge."""
    return m.paired(preds).groupBy(*by).agg(*m.basic())


def delay_metrics(preds: DataFrame, by=(), threshold=DELAY_THRESHOLD) -> DataFrame:
    """The seven delay metrics per segment.

    Where the segment names a route its group is bounded by the calendar and the median joins the other aggregates;
    for wider segments the median is selected exactly without gathering the segment in one task.
    """
    by = list(by)
    rows = m.paired(preds)
    order = ["mae", "within_15", "rmse", "mape", "median_ae", "threshold_acc", "r2"]
    if "route" in by:
        return rows.groupBy(*by).agg(*m.delay(threshold), m.median_abs_error().alias("median_ae")).select(*by, *order)
    sums = rows.groupBy(*by).agg(*m.delay(threshold))
    medians = exact_median(
        rows.withColumn("abs_error", F.abs(F.col("pred") - F.col("actual"))), by, "abs_error", "median_ae"
    )
    if by:
        keys = [F.col(f"s.{k}").eqNullSafe(F.col(f"q.{k}")) for k in by]
        joined = sums.alias("s").join(medians.alias("q"), keys, "left")
        return joined.select(*[F.col(f"s.{c}").alias(c) for c in sums.columns], "q.median_ae").select(*by, *order)
    return sums.withColumn("median_ae", medians.scalar()).select(*order)


def error_columns(preds: DataFrame, cut) -> DataFrame:
    """Error, absolute and percentage error (null near zero), era, day type and season."""
    e = F.col("pred") - F.col("actual")
    return preds.withColumns({
        "error": e,
        "abs_error": F.abs(e),
        "pct_error": F.when(F.abs("actual") >= 1, e / F.col("actual") * 100),
        "time_period": cal.era_label(cut),
        "day_type": cal.day_type(),
        "season": cal.season(),
    })


def metrics_by_segments(errors: DataFrame, segments=("route", "time_period", "day_type", "season"), by=("model",)):
    """Basic metrics overall and by each segment in one pass: (by, section, key, metrics)."""
    sets = [tuple(by)] + [(*by, s) for s in segments]
    rows = m.paired(errors)
    columns = [F.col(c) for c in (*by, *segments)]
    which = F.coalesce(
        *[F.when(F.grouping(s) == 0, F.struct(F.lit(s).alias("section"), F.col(s).alias("key"))) for s in segments],
        F.struct(F.lit("overall").alias("section"), F.lit("all").alias("key")),
    ).alias("at")
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(which, *m.basic())
    return out.select(*by, "at.section", "at.key", "rmse", "mae", "mape", "r2", "n_samples")


def fold_summary(fold_metrics: DataFrame, metrics=SUMMARY_METRICS) -> DataFrame:
    """(model, metric): mean and population deviation over folds and the fold values in order; empty folds skipped."""
    long = stack_long(fold_metrics, ["model", "fold"], metrics, "metric", "v").filter(F.col("v").isNotNull())
    return long.groupBy("model", "metric").agg(
        F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("std"),
        F.transform(F.array_sort(F.collect_list(F.struct("fold", "v"))), lambda x: x.v).alias("folds"),
    )


def worst_forecasts(errors: DataFrame, n=10) -> DataFrame:
    top = errors.orderBy(F.desc("abs_error"), "route", "date").limit(n)
    return top.select("date", "route", "actual", "pred", "error")


def residuals_over_time(errors: DataFrame, days=30) -> DataFrame:
    """Daily mean error and its trailing mean; one row per calendar day."""
    daily = errors.groupBy("date").agg(F.avg("error").alias("error"))
    w = W.partitionBy(F.lit(0)).orderBy("date").rowsBetween(-(days - 1), 0)
    return daily.withColumn("rolling", F.avg("error").over(w))


def segment_box_stats(errors: DataFrame, segment: str) -> DataFrame:
    """Per segment: error quartiles and median absolute error, smallest median first. Segments may be huge."""
    both = stack_long(errors, [segment], ["error", "abs_error"], "_of", "_v")
    box = exact_quantiles(both, [segment, "_of"], "_v", [0.25, 0.5, 0.75])
    at = lambda of, p: F.max(F.when((F.col("_of") == of) & (F.col("prob") == p), F.col("quantile")))
    return box.groupBy(segment).agg(
        at("abs_error", 0.5).alias("median_abs_error"), at("error", 0.25).alias("q1"),
        at("error", 0.5).alias("median_error"), at("error", 0.75).alias("q3"),
    ).orderBy("median_abs_error", segment)


def mae_route_season(errors: DataFrame, order=True) -> DataFrame:
    """Mean absolute error, route by season, easiest route first."""
    labels = list(cal.SEASONS.values())
    wide = errors.groupBy("route").pivot("season", labels).agg(F.avg("abs_error"))
    names = [label.split("(")[1][:-1].lower() for label in labels]
    wide = wide.select("route", *[F.col(f"`{label}`").alias(n) for label, n in zip(labels, names)])
    filled = [F.when(F.col(n).isNotNull(), 1).otherwise(0) for n in names]
    total = sum((F.coalesce(F.col(n), F.lit(0.0)) for n in names), F.lit(0.0))
    row_mean = F.try_divide(total, sum(filled, F.lit(0)))
    return wide.withColumn("row_mean", row_mean).orderBy("row_mean", "route") if order else wide


def seasonal_stats(errors: DataFrame) -> DataFrame:
    """Best and worst season by the unweighted mean of route errors, their spread, and the worst route of the worst
    season; ties go to the earlier season and smaller route."""
    cell = errors.groupBy("route", F.quarter("date").alias("q"), "season").agg(F.avg("abs_error").alias("mae"))
    per_season = cell.groupBy("q", "season").agg(
        F.avg("mae").alias("avg"),
        F.min(F.struct((-F.col("mae")).alias("n"), F.col("route").alias("route"))).alias("worst"),
    )
    out = per_season.agg(
        F.min(F.struct("avg", "q", "season")).alias("best"),
        F.min(F.struct((-F.col("avg")).alias("n"), F.col("q"), F.col("season"), F.col("worst"))).alias("worst"),
    )
    return out.select(
        F.col("best.season").alias("best_season"),
        F.col("best.avg").alias("best_season_mae"),
        F.col("worst.season").alias("worst_season"),
        (-F.col("worst.n")).alias("worst_season_mae"),
        F.col("worst.worst.route").alias("worst_route"),
        (-F.col("worst.worst.n")).alias("worst_route_mae"),
        (-F.col("worst.n") - F.col("best.avg")).alias("spread"),
    )


def family_gap(errors: DataFrame, families: dict, by=("route",)) -> DataFrame:
    """Mean MAE of two groups of models per key and their difference; keys that lack either are dropped."""
    (a, members_a), (b, members_b) = families.items()
    per_model = errors.groupBy(*by, "model").agg(F.avg("abs_error").alias("mae"))
    out = per_model.groupBy(*by).agg(
        F.avg(F.when(F.col("model").isin(members_a), F.col("mae"))).alias(f"{a}_mae"),
        F.avg(F.when(F.col("model").isin(members_b), F.col("mae"))).alias(f"{b}_mae"),
    ).dropna(subset=[f"{a}_mae", f"{b}_mae"])
    return out.withColumn("gap", F.col(f"{b}_mae") - F.col(f"{a}_mae")).orderBy(f"{a}_mae", *by)


def paired_t_test(preds: DataFrame, models, alpha=0.05) -> DataFrame:
    """Paired t-test on absolute errors for every pair of the listed models.

    Each (route, date) row holds the errors of all models side by side, so a pair is a difference of two columns and
    one aggregate serves all pairs. Only the result rows reach the p-value function.
    """
    wide = m.paired(preds).groupBy("route", "date").agg(*[
        F.max(F.when(F.col("model") == x, F.abs(F.col("pred") - F.col("actual")))).alias(x) for x in models
    ])
    pairs = list(combinations(models, 2))
    aggs = []
    for i, (x, y) in enumerate(pairs):
        d = F.col(x) - F.col(y)
        aggs += [F.avg(d).alias(f"d{i}"), F.stddev_samp(d).alias(f"s{i}"), F.count(d).alias(f"n{i}")]
    rows = F.array(*[
        F.struct(
            F.lit(x).alias("model_1"), F.lit(y).alias("model_2"), F.col(f"d{i}").alias("mae_diff"),
            F.try_divide(F.col(f"d{i}"), F.col(f"s{i}") / F.sqrt(F.col(f"n{i}"))).alias("t_stat"),
            F.col(f"n{i}").alias("n"),
        )
        for i, (x, y) in enumerate(pairs)
    ])
    out = wide.agg(*aggs).select(F.inline(rows))
    out = out.withColumn("p_value", t_two_sided(F.col("t_stat"), F.col("n") - 1))
    return out.withColumn("significant", (F.col("p_value") < alpha).cast("int"))


def route_metric_extremes(route_metrics: DataFrame, metric: str, by=("model",)) -> DataFrame:
    """Best and worst route by a metric and the mean over routes; the direction follows the metric."""
    sign = -1 if metric in HIGHER_IS_BETTER else 1
    v = F.col(metric)
    known = route_metrics.filter(v.isNotNull())
    out = known.groupBy(*by).agg(
        F.min(F.struct((v * sign).alias("k"), F.col("route"), v.alias("v"))).alias("best"),
        F.min(F.struct((v * -sign).alias("k"), F.col("route"), v.alias("v"))).alias("worst"),
        F.avg(v).alias("mean_value"),
    )
    return out.select(
        *by,
        F.col("best.route").alias("best_route"), F.col("best.v").alias("best_value"),
        F.col("worst.route").alias("worst_route"), F.col("worst.v").alias("worst_value"),
        "mean_value",
    )


def improvement(metrics: DataFrame, base="naive") -> DataFrame:
    """MAE reduction against the base model in percent and hit-rate change in points."""
    ref = metrics.filter(F.col("model") == base)
    mae, hit = ref.select("mae").scalar(), ref.select("within_15").scalar()
    return metrics.filter(F.col("model") != base).select(
        "model", "mae",
        ((mae - F.col("mae")) / mae * 100).alias("mae_reduction_pct"),
        (F.col("within_15") - hit).alias("hit_rate_change"),
    )


def loss_argmin(trials: DataFrame, group=("setting",), step="step", loss="loss") -> DataFrame:
    """Per setting: lowest loss and its first step; ``is_best`` marks the setting with the lowest loss of all."""
    best = trials.groupBy(*group).agg(F.min(F.struct(F.col(loss).alias("l"), F.col(step).alias("s"))).alias("b"))
    lowest = best.agg(F.min(F.struct("b.l", *group)).alias("w"))
    win = lowest.select("w").scalar()
    is_best = F.struct(F.col("b.l").alias("l"), *group) == win
    return best.select(*group, F.col("b.l").alias("best_loss"), F.col("b.s").alias("best_step"), is_best.cast("int").alias("is_best"))


def leaderboard(metrics: DataFrame, baselines=("naive", "ma"), base="naive", mae_gap=0.2, hit_gap=0.5) -> DataFrame:
    """Models with their MAE and hit-rate ranks. A non-baseline model is a clear best when it leads the next
    non-baseline by the gap; ``improvement_pct`` is the best MAE against the base. One row per model."""
    one = W.partitionBy(F.lit(0))
    ml = ~F.col("model").isin(list(baselines))
    ml_group = W.partitionBy(ml)
    by_mae, by_hit = [F.col("mae"), F.col("model")], [F.desc("within_15"), F.col("model")]
    next_mae = F.lead("mae").over(ml_group.orderBy(*by_mae))
    next_hit = F.lead("within_15").over(ml_group.orderBy(*by_hit))
    first_ml = lambda order: F.row_number().over(ml_group.orderBy(*order)) == 1
    base_mae = F.max(F.when(F.col("model") == base, F.col("mae"))).over(one)
    clear_mae = ml & first_ml(by_mae) & (F.coalesce(next_mae - F.col("mae"), F.lit(0.0)) >= mae_gap)
    clear_hit = ml & first_ml(by_hit) & (F.coalesce(F.col("within_15") - next_hit, F.lit(0.0)) >= hit_gap)
    return metrics.select(
        "model", "mae", "within_15",
        F.row_number().over(one.orderBy(*by_mae)).alias("mae_rank"),
        F.row_number().over(one.orderBy(*by_hit)).alias("hit_rank"),
        clear_mae.cast("int").alias("clear_best_mae"),
        clear_hit.cast("int").alias("clear_best_hit"),
        ((base_mae - F.min("mae").over(one)) / base_mae * 100).alias("improvement_pct"),
    ).orderBy("mae_rank")


def canonical_order(df: DataFrame, order=MODEL_ORDER, model="model") -> DataFrame:
    """Rows in display order of models, unknown ones last by name; adds the position."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(model))
    return df.withColumn("position", F.when(at > 0, at).otherwise(999).cast("int")).orderBy("position", model)
