"""Model fits as Spark jobs: boosted trees, per-route seasonal regression, sequence scoring."""

import math
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.config import TARGET
from panelcast.functions.calendar import day
from panelcast.operators.boosting import TRAIN, VAL, BoostedTrees, Fit, Settings, cut_points, fit_blocks, fit_trees, store_blocks
from panelcast.operators.clean import drop_incomplete, split_by_time
from panelcast.operators.evaluation import delay_metrics
from panelcast.operators.search import ParzenSearch, Range

# Default settings of the boosted model.
GBT_DEFAULTS = {
    "n_estimators": 500, "max_depth": 6, "learning_rate": 0.1, "subsample": 0.8, "colsample_bytree": 0.8, "min_child_weight": 3,
    "early_stopping_rounds": 50, "seed": 42,
}
# Search space of the boosted model.
GBT_SPACE = {
    "n_estimators": Range(200, 1000, step=50), "max_depth": Range(3, 10, step=1), "learning_rate": Range(0.01, 0.3, log=True),
    "subsample": Range(0.6, 1.0), "colsample_bytree": Range(0.6, 1.0), "min_child_weight": Range(1, 10, step=1),
    "reg_alpha": Range(1e-8, 10.0, log=True), "reg_lambda": Range(1e-8, 10.0, log=True),
}
#: Rounds after which a trial must be no worse than the median of the finished ones.
HURDLES = (25, 50, 100, 200, 400)


def gbt_settings(params=None) -> Settings:
    return Settings(**{**GBT_DEFAULTS, **(params or {})})


def fit_gbt(rows: DataFrame, features, params=None, target=TARGET) -> BoostedTrees:
    """Boosted trees on rows whose ``split`` is train, stopped early on those that are val. Pass a stored table."""
    split = F.col("split")
    return fit_trees(rows, features, target, split == "train", split == "val", [gbt_settings(params)])[0]


def predict_tabular(model: BoostedTrees, rows: DataFrame, features, keys=("route", "date"), target=TARGET) -> DataFrame:
    """(keys, actual, pred) of complete rows."""
    complete = drop_incomplete(rows, [*features, target])
    return complete.select(*keys, F.col(target).alias("actual"), model.column().alias("pred"))


def importance_table(spark, model: BoostedTrees, features, name) -> DataFrame:
    """(model, feature, importance): one row per feature of the fitted model."""
    rows = [(name, f, float(v)) for f, v in zip(features, model.importances)]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def walk_forward_gbt(features_df: DataFrame, features, folds, params=None, target=TARGET) -> DataFrame:
    """Test predictions (fold, route, date, actual, model, pred) of one boosted fit per fold. Pass a staged table.

    Folds are a short fixed list, fitted side by side; a fold without test rows is skipped. Bins come from a fold's own
    training rows.
    """
    features = list(features)

    def one(fold):
        rows = split_by_time(features_df, fold, [*features, target])
        tested = rows.filter((F.col("split") == "test") & (F.col("date") < day(fold.test_end)))
        if tested.isEmpty():
            return None
        model = fit_gbt(rows, features, params, target)
        return predict_tabular(model, tested, features, target=target).select(
            F.lit(fold.fold).alias("fold"), "route", "date", "actual", F.lit("gbt").alias("model"), "pred"
        )

    with ThreadPoolExecutor(4) as pool:
        found = [preds for preds in pool.map(one, folds) if preds is not None]
    return reduce(DataFrame.unionByName, found) if found else None


def tune_gbt(rows: DataFrame, features, n_trials=50, in_flight=10, space=None, params=None, seed=42, target=TARGET) -> DataFrame:
    """A guided search for the settings with the least absolute validation error: (rank, trial, mae, rounds, given_up, params).

    ``rows`` carry ``split``; pass a stored table. Rows are binned once. ``in_flight`` trials are fitted at the same time;
    each choice learns from all trials of the batches before it. A trial that falls behind the median of the finished ones
    at one of ``HURDLES`` is given up and counts with the error it had. The same seed gives the same trials.
    """
    features, space = list(features), space or GBT_SPACE
    split = F.col("split")
    cuts = cut_points(rows.filter(split == "train"), features)
    blocks = store_blocks(rows, features, cuts, target, [F.when(split == "train", TRAIN).when(split == "val", VAL).otherwise(0)])
    search, done, paths = ParzenSearch(space, seed), [], []
    while len(done) < n_trials:
        asked = search.ask(min(in_flight, n_trials - len(done)))
        reached = {k: sorted(min(p[:k]) for p in paths if len(p) >= k) for k in HURDLES}
        hurdles = tuple((k, best[len(best) // 2]) for k, best in reached.items() if len(best) >= 5)
        fits = [Fit(gbt_settings({**(params or {}), **one, "hurdles": hurdles})) for one in asked]
        for one, model in zip(asked, fit_blocks(blocks, features, cuts, fits), strict=True):
            squares = [h[0] for h in model.history]
            mae = model.history[squares.index(min(squares))][1] if squares else None
            search.tell(one, float("inf") if mae is None else mae)
            if not model.given_up:
                paths.append(squares)
            text = ", ".join(f"{k}={v:.6g}" for k, v in sorted(one.items()))
            done.append((len(done), mae, len(model.trees), model.given_up, text))
    order = sorted(done, key=lambda t: (t[1] is None, t[1], t[0]))
    return rows.sparkSession.createDataFrame([(i + 1, *t) for i, t in enumerate(order)], "rank int, trial int, mae double, rounds int, given_up boolean, params string")


def ablation_predictions(rows: DataFrame, features, removed, params=None, target=TARGET) -> DataFrame:
    """Test predictions (route, date, actual, pred, model) with all features and without the removed ones: two fits over the same bins."""
    features, split = list(features), F.col("split")
    kept = [f for f in features if f not in set(removed)]
    complete = drop_incomplete(rows, [*features, target])
    cuts = cut_points(complete.filter(split == "train"), features)
    blocks = store_blocks(complete, features, cuts, target, [F.when(split == "train", TRAIN).when(split == "val", VAL).otherwise(0)])
    fits = [Fit(gbt_settings(params)), Fit(gbt_settings(params), columns=tuple(i for i, f in enumerate(features) if f in kept))]
    test = complete.filter(split == "test")
    preds = [predict_tabular(m, test, features, target=target).withColumn("model", F.lit(name)) for name, m in zip(("all", "ablated"), fit_blocks(blocks, features, cuts, fits), strict=True)]
    return reduce(DataFrame.unionByName, preds)


def ablation(rows: DataFrame, features, removed, params=None, target=TARGET) -> DataFrame:
    """Delay metrics of the test rows with all features and without the removed ones."""
    return delay_metrics(ablation_predictions(rows, features, removed, params, target), ["model"])


#: Possible changes of trend, spread evenly over this share of a route's training days.
CHANGES, CHANGE_SHARE = 25, 0.8
#: Days of one unit of the trend.
DECADE = 3652.5


def holiday_names(holidays: DataFrame = None) -> list:
    """The names of a holiday table (date, name), a handful, in order; one for all if it has no names."""
    if holidays is None:
        return []
    return sorted(r[0] for r in holidays.select("name").distinct().collect()) if "name" in holidays.columns else ["holiday"]


def seasonal_basis(df: DataFrame, holidays: DataFrame = None, yearly=10, weekly=3, names=None) -> DataFrame:
    """Adds ``t``, decades since 1970, and ``b``, the terms of a day: constant, trend, yearly and weekly waves, one per holiday."""
    days = F.unix_date("date").cast("double")
    terms = [F.lit(1.0), days / DECADE]
    for period, order in ((365.25, yearly), (7.0, weekly)):
        for k in range(1, order + 1):
            angle = days * (2 * math.pi * k / period)
            terms += [F.sin(angle), F.cos(angle)]
    if holidays is not None:
        names = holiday_names(holidays) if names is None else names
        named = F.col("name") if "name" in holidays.columns else F.lit("holiday")
        of_day = holidays.select("date", named.alias("_name")).groupBy("date").agg(F.collect_set("_name").alias("_h"))  # a few names a day
        df = df.join(of_day, "date", "left")
        terms += [F.when(F.array_contains("_h", n), 1.0).otherwise(0.0) for n in names]
    return df.withColumns({"b": F.array(*terms), "t": days / DECADE}).drop("_h")


def trend_lasso(gram, moment, free, penalised, ridge, l1, sweeps=20_000, tolerance=1e-10):
    """Weights that minimise |y - X w|^2 / 2 + sum(ridge * w^2) / 2 over the free terms + l1 * sum(|w|) over the penalised ones.

    ``gram`` is X'X and ``moment`` X'y. The free terms follow from the others by one linear solve, which leaves a small
    lasso for coordinate descent; it stops once no weight moves by more than the tolerance.
    """
    import numpy as np

    inner = gram[np.ix_(free, free)] + np.diag(ridge)
    cross = gram[np.ix_(free, penalised)]
    solved = np.linalg.lstsq(inner, np.column_stack((moment[free], cross)), rcond=None)[0]
    g = gram[np.ix_(penalised, penalised)] - cross.T @ solved[:, 1:]
    c = moment[penalised] - cross.T @ solved[:, 0]
    w, left = np.zeros(len(penalised)), c.copy()  # left: c - g w
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(w)):
            if g[j, j] <= 1e-12:
                continue
            pull = left[j] + g[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - l1, 0.0) / g[j, j]
            if new != w[j]:
                left -= g[:, j] * (new - w[j])
                most, w[j] = max(most, abs(new - w[j])), new
        if most <= tolerance * max(1.0, np.abs(w).max(initial=0.0)):
            break
    return solved[:, 0] - solved[:, 1:] @ w, w


def seasonal_weights(train: DataFrame, holidays: DataFrame = None, yearly=10, weekly=3, ridge=1e-3, l1=10.0, target=TARGET) -> DataFrame:
    """(route, w, changes, slopes): one fit per route, whose rows are bounded by the calendar.

    ``w`` are the weights of the basis; at each of ``changes`` (in decades) the slope of the trend changes by the entry of
    ``slopes``, most of which the penalty ``l1`` keeps at 0. Constant and trend are not penalised, the other terms by ``ridge``.
    """
    def solve(pdf):
        import numpy as np
        import pandas as pd

        x, t = np.vstack(pdf["b"].to_numpy()), pdf["t"].to_numpy()
        first, last = t.min(), t.max()
        changes = first + (last - first) * CHANGE_SHARE * np.arange(1, CHANGES + 1) / (CHANGES + 1) if last > first else np.empty(0)
        n, x = x.shape[1], np.hstack((x, np.maximum(t[:, None] - changes, 0.0)))
        w, slopes = trend_lasso(x.T @ x, x.T @ pdf["y"].to_numpy(), np.arange(n), np.arange(n, x.shape[1]), np.where(np.arange(n) < 2, 0.0, ridge), l1)
        return pd.DataFrame({"route": [pdf["route"].iloc[0]], "w": [w.tolist()], "changes": [changes.tolist()], "slopes": [slopes.tolist()]})

    rows = train.select("route", "date", F.col(target).cast("double").alias("y")).dropna()
    rows = seasonal_basis(rows, holidays, yearly, weekly)
    return rows.select("route", "t", "y", "b").groupBy("route").applyInPandas(solve, "route string, w array<double>, changes array<double>, slopes array<double>")


def _product(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _hinges():
    return F.transform("changes", lambda at: F.greatest(F.col("t") - at, F.lit(0.0)))


def seasonal_regression(
    train: DataFrame, score: DataFrame, holidays: DataFrame = None, yearly=10, weekly=3, ridge=1e-3, l1=10.0, target=TARGET
) -> DataFrame:
    """Per-route additive model of a trend that can change, yearly and weekly seasonality and each holiday: (route, date, pred).

    The fit returns short weight vectors per route; the basis and the scoring are native columns. Unknown routes are
    predicted 0.
    """
    weights = seasonal_weights(train, holidays, yearly, weekly, ridge, l1, target)
    scored = seasonal_basis(score.select("route", "date"), holidays, yearly, weekly).join(weights, "route", "left")
    return scored.select("route", "date", F.coalesce(_product("b", "w") + _product(_hinges(), "slopes"), F.lit(0.0)).alias("pred"))


def seasonal_gradient(train: DataFrame, holidays: DataFrame = None, yearly=10, weekly=3, ridge=1e-3, l1=10.0, target=TARGET) -> DataFrame:
    """(route, n_train, gradient): how far a fit's weights are from the optimum, the largest slope left in any direction per row: 0 there.

    A change of trend that is kept at 0 may have a slope of up to ``l1``, which the penalty outweighs.
    """
    weights = seasonal_weights(train, holidays, yearly, weekly, ridge, l1, target)
    rows = seasonal_basis(train.select("route", "date", F.col(target).cast("double").alias("y")).dropna(), holidays, yearly, weekly)
    rows = rows.join(weights, "route").withColumn("hinges", _hinges())
    rows = rows.withColumn("residual", _product("b", "w") + _product("hinges", "slopes") - F.col("y"))
    both = F.arrays_zip(F.concat("b", "hinges").alias("x"), F.concat("w", "slopes").alias("w"))
    terms = rows.select("route", "residual", F.size("b").alias("free"), F.posexplode(both).alias("term", "p"))
    per_term = terms.groupBy("route", "free", "term").agg(F.sum(F.col("residual") * F.col("p.x")).alias("slope"), F.first("p.w").alias("w"), F.count(F.lit(1)).alias("n"))
    smooth = F.abs(F.col("slope") + F.when(F.col("term") >= 2, ridge).otherwise(0.0) * F.col("w"))
    kinked = F.when(F.col("w") == 0, F.greatest(F.abs("slope") - l1, F.lit(0.0))).otherwise(F.abs(F.col("slope") + l1 * F.signum("w")))
    off = F.when(F.col("term") < F.col("free"), smooth).otherwise(kinked)
    return per_term.groupBy("route").agg(F.max("n").alias("n_train"), F.max(off / F.col("n")).alias("gradient"))


def score_sequences(windows: DataFrame, make_predict, length: int, width: int, batch_size=1024) -> DataFrame:
    """(route, date, target, pred) by a user model over sequence windows.

    ``make_predict`` returns a function from an array of shape (batch, length, width) to one prediction per row; it
    runs once per Python worker, where a model is loaded.
    """
    from pyspark.ml.functions import predict_batch_udf

    udf = predict_batch_udf(
        make_predict, return_type=T.DoubleType(), batch_size=batch_size, input_tensor_shapes=[[length, width]]
    )
    return windows.select("route", "date", "target", udf(F.flatten("x")).alias("pred"))


def linear_scorer(weights):
    """A scorer that is a weighted sum of the window; ``weights`` has shape (length, width)."""
    table = [list(map(float, row)) for row in weights]

    def make():
        import numpy as np

        w = np.asarray(table)

        def predict(batch):
            return np.einsum("nlf,lf->n", np.asarray(batch, dtype="float64").reshape(-1, *w.shape), w)

        return predict

    return make
