"""Metrics, statistics, reports and model jobs."""

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.config import STUDY
from panelcast.functions.stats import exact_median, exact_quantiles, t_two_sided, weighted_corr
from panelcast.operators import evaluation as oe
from panelcast.operators import forecasting as fc
from panelcast.operators.search import ParzenSearch, Range, random_settings
from panelcast.operators import insights as oi
from panelcast.operators import predictions as pr
from panelcast.plans import publish

PRED = "route string, date date, model string, actual double, pred double"
D = date(2020, 1, 1)


def preds(frame, pairs, model="m", route="A-B"):
    return frame([(route, D + timedelta(i), model, a, p) for i, (a, p) in enumerate(pairs)], PRED)


def test_delay_metrics_by_hand(frame):
    row = oe.delay_metrics(preds(frame, [(10.0, 20.0), (20.0, 10.0), (40.0, 40.0), (None, 1.0), (1.0, None)])).first()
    assert row.mae == pytest.approx(20 / 3) and row.rmse == pytest.approx(math.sqrt(200 / 3))
    assert row.within_15 == 100.0 and row.median_ae == 10.0 and row.threshold_acc == pytest.approx(100 / 3)
    assert row.mape == pytest.approx((1 + 0.5 + 0) / 3 * 100)
    y = np.array([10.0, 20, 40])
    assert row.r2 == pytest.approx(1 - 200 / ((y - y.mean()) ** 2).sum())


def test_median_is_the_same_by_route_and_overall(frame):
    df = preds(frame, [(0.0, float(i * i % 17)) for i in range(50)])
    assert oe.delay_metrics(df).first().median_ae == oe.delay_metrics(df, ["route"]).first().median_ae


def test_mape_is_null_when_actuals_are_near_zero(frame):
    assert oe.basic_metrics(preds(frame, [(0.5, 1.0), (1.0, 2.0), (5.0, 6.0)])).first().mape is None
    half = oe.basic_metrics(preds(frame, [(0.5, 1.0), (5.0, 6.0)])).first()
    assert half.mape == pytest.approx(20.0)


def test_constant_target_has_zero_r2(frame):
    assert oe.basic_metrics(preds(frame, [(3.1, 1.0), (3.1, 2.0), (3.1, 3.0)])).first().r2 == 0.0


def test_no_rows_give_null_metrics(frame):
    row = oe.delay_metrics(preds(frame, [(None, 1.0)])).first()
    assert row.mae is None and row.median_ae is None and row.r2 is None


@pytest.mark.parametrize("n", [1, 2, 7, 40001, 200000])
def test_exact_quantiles_match_numpy(spark, n):
    rng = np.random.default_rng(n)
    values = np.concatenate([np.round(rng.exponential(10, n), 2), np.full(n // 3, 4.0)])
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], len(values)), "v": values})
    pdf.loc[0, "k"] = None
    df = spark.createDataFrame(pdf, "k string, v double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r.k, r.prob): r.quantile for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    for key in pdf["k"].unique():
        one = pdf[pdf["k"].isna()] if key is None or key != key else pdf[pdf["k"] == key]
        for p in probs:
            assert got[None if key != key else key, p] == pytest.approx(np.quantile(one["v"], p), abs=1e-9)
    assert exact_median(df, [], "v").first()[0] == pytest.approx(np.median(values))


def test_fold_summary_population_std_and_order(frame):
    rows = [("m", 2, 3.0), ("m", 1, 1.0), ("m", 3, None)]
    out = oe.fold_summary(frame(rows, "model string, fold int, mae double"), ["mae"]).first()
    assert (out["mean"], out["std"], out["folds"]) == (2.0, 1.0, [1.0, 3.0])


def test_paired_t_test_matches_definition(frame):
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 5, 60), rng.normal(0, 6, 60)
    df = preds(frame, [(0.0, float(x)) for x in a], "x").unionByName(preds(frame, [(0.0, float(x)) for x in b], "y"))
    row = oe.paired_t_test(df, ["x", "y"]).first()
    d = np.abs(a) - np.abs(b)
    assert row.mae_diff == pytest.approx(d.mean()) and row.t_stat == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(60)))


def test_t_tail_known_values(frame):
    # fixed values: standard two-sided critical points
    rows = [(12.706, 1.0, 0.05), (2.228, 10.0, 0.05), (2.750, 30.0, 0.01), (0.0, 5.0, 1.0), (1.96, 1e6, 0.05)]
    got = frame(rows, "t double, n double, p double").select("p", t_two_sided(F.col("t"), F.col("n")).alias("q")).collect()
    for r in got:
        assert r.q == pytest.approx(r.p, abs=2e-4)


def test_seasonal_stats_and_family_gap(frame):
    rows = []
    for route, month, model, err in (("A-B", 1, "g", 1.0), ("A-B", 7, "g", 3.0), ("C-D", 7, "g", 5.0), ("A-B", 1, "n", 2.0), ("A-B", 7, "n", 7.0)):
        rows.append((route, date(2020, month, 1), model, 0.0, err))
    errors = oe.error_columns(frame(rows, PRED), STUDY)
    s = oe.seasonal_stats(errors.filter("model = 'g'")).first()
    assert (s.best_season, s.worst_season, s.worst_season_mae, s.worst_route, s.spread) == ("Q1 (Winter)", "Q3 (Summer)", 4.0, "C-D", 3.0)
    gap = oe.family_gap(errors, {"tree": ["g"], "net": ["n"]}).collect()
    assert [(r.route, r.tree_mae, r.net_mae, r.gap) for r in gap] == [("A-B", 2.0, 4.5, 2.5)]
    wide = oe.mae_route_season(errors.filter("model = 'g'")).collect()
    assert [(r.route, r.winter, r.summer, r.row_mean) for r in wide] == [("A-B", 1.0, 3.0, 2.0), ("C-D", None, 5.0, 5.0)]


def test_error_columns_near_zero_and_eras(frame):
    rows = [("A-B", date(2019, 5, 4), "m", 0.5, 1.0), ("A-B", date(2020, 5, 4), "m", -2.0, 1.0)]
    got = {r.date.year: r for r in oe.error_columns(frame(rows, PRED), STUDY).collect()}
    assert got[2019].pct_error is None and got[2019].time_period == "Pre-COVID" and got[2019].day_type == "Weekend"
    assert got[2020].pct_error == -150.0 and got[2020].time_period == "COVID"


def test_leaderboard_needs_a_gap(frame):
    rows = [("xgboost", 11.0, 70.0), ("lstm", 11.1, 60.0), ("naive", 15.0, 50.0)]
    got = {r.model: r for r in oe.leaderboard(frame(rows, "model string, mae double, within_15 double")).collect()}
    assert (got["xgboost"].clear_best_mae, got["xgboost"].clear_best_hit) == (0, 1)
    assert got["naive"].mae_rank == 3 and got["lstm"].improvement_pct == pytest.approx(4 / 15 * 100)
    order = oe.canonical_order(frame([("zz",), ("naive",), ("xgboost",)], "model string"))
    assert [r.model for r in order.collect()] == ["xgboost", "naive", "zz"]


def test_route_extremes_follow_direction(frame):
    df = frame([("A", 1.0, 90.0), ("B", 2.0, 80.0)], "route string, mae double, within_15 double")
    low, high = oe.route_metric_extremes(df, "mae", ()).first(), oe.route_metric_extremes(df, "within_15", ()).first()
    assert (low.best_route, low.worst_route, high.best_route, high.worst_value) == ("A", "B", "A", 80.0)


def test_weighted_corr_matches_numpy(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": rng.normal(size=200), "w": rng.integers(0, 5, 200).astype(float)})
    pdf["y"] = 2 * pdf["x"] + rng.normal(size=200)
    c = np.cov(pdf["x"], pdf["y"], aweights=pdf["w"])
    for shift in (0.0, 1e8):  # far from zero raw moments would cancel
        got = weighted_corr(spark.createDataFrame(pdf + [shift, 0, shift]), {"x": "r"}, "y", "w").first().correlation
        assert got == pytest.approx(c[0, 1] / math.sqrt(c[0, 0] * c[1, 1]), abs=1e-6)


def test_weather_impact_zero_weight(frame):
    df = frame([(0, 5.0, 0), (3, 20.0, 2), (3, 5.0, 6)], "weather_severity_max int, avg_arr_delay double, flight_count long")
    got = {r.severity: r for r in oi.weather_impact(df).collect()}
    assert (got[0].avg_delay, got[0].high_delay_pct) == (0.0, 0.0)
    assert got[3].avg_delay == 8.75 and got[3].high_delay_pct == 0.25 and got[3].label == "Rain"


def test_autocorrelations_match_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.zeros(300)
    for i in range(1, 300):
        x[i] = 0.6 * x[i - 1] + rng.normal()
    keep = [i for i in range(300) if i % 37 != 5]
    df = spark.createDataFrame([(D + timedelta(i), float(x[i])) for i in keep], "date date, avg_arr_delay double")
    acf = oi.autocorrelation(df, lags=12)
    got = {r.lag: r.acf for r in acf.collect()}
    y = np.array([x[i] if i % 37 != 5 else 0.0 for i in range(300)])
    c = y - y.mean()
    r = [float(c[: len(c) - k] @ c[k:] / (c @ c)) for k in range(13)]
    assert [got[k] for k in range(13)] == pytest.approx(r)
    pacf = {p.lag: p.pacf for p in oi.partial_autocorrelation(acf).collect()}
    for k in range(1, 13):
        system = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        assert pacf[k] == pytest.approx(np.linalg.solve(system, r[1 : k + 1])[-1])


def test_histogram_closes_last_bin(frame):
    df = frame([(float(v),) for v in (0, 1, 5, 10)] + [(None,)], "x double")
    got = oi.histogram(df, "x", 10).orderBy("bin").collect()
    assert [r["count"] for r in got] == [1, 1, 0, 0, 0, 1, 0, 0, 0, 1]
    flat = oi.histogram(frame([(2.0,), (2.0,)], "x double"), "x", 4)
    assert sum(r["count"] for r in flat.collect()) == 2


def test_carrier_performance_counts_cancelled_only_in_rate(frame):
    rows = [("AA", 10.0, 0), ("AA", 40.0, 0), ("AA", None, 1), ("BB", None, 1), ("CC", 5.0, 0)]
    df = frame([(D, c, a, x) for c, a, x in rows], "FL_DATE date, REPORTING_AIRLINE string, ARR_DELAY double, CANCELLED int")
    got = {r.code: r for r in oi.carrier_performance(df, 2).collect()}
    assert set(got) == {"AA"}
    assert (got["AA"].n_flights, got["AA"].on_time_pct, got["AA"].severe_delay_pct) == (2, 0.5, 0.5)
    assert got["AA"].cancel_rate == pytest.approx(1 / 3)


def test_importance_categories(frame):
    df = frame([("m", "lag_1_arr_delay", 3.0), ("m", "max_wind", 1.0), ("m", "unknown", 0.0)], "model string, feature string, importance double")
    got = {r.category: r for r in oi.importance_by_category(df).collect()}
    assert got["lag"].total == 0.75 and got["lag"].category_rank == 1 and got["other"].top_feature == "unknown"
    assert [r.rank for r in oi.feature_rank(df, 2).orderBy("rank").collect()] == [1, 2]


def test_city_pairs_and_hit_rate(frame):
    routes = frame([("LAX-SFO",), ("SFO-LAX",), ("A-B",)], "route string")
    pairs = pr.directional_routes(pr.city_pairs(routes)).collect()
    assert {(r.city_pair, r.inbound) for r in pairs} == {("LAX-SFO", "SFO-LAX"), ("A-B", "B-A")}
    rated = pr.city_pair_hit_rate(routes, frame([("LAX-SFO", 80.0), ("SFO-LAX", 60.0)], "route string, within_15 double"))
    assert [(r.city_pair, r.hit_rate) for r in rated.collect()] == [("LAX-SFO", 70.0), ("A-B", 0.0)]


def test_merge_and_align(frame):
    base = frame([("A", D, 1.0), ("A", D + timedelta(1), 2.0)], "route string, date date, actual double")
    merged = pr.merge_predictions(base, {"x": frame([("A", D, 9.0)], "route string, date date, pred double")})
    assert {(r.date, r.x) for r in merged.collect()} == {(D, 9.0), (D + timedelta(1), None)}
    assert pr.align_predictions(merged, ["x"]).count() == 1


def test_report_and_documents(spark, frame, tmp_path):
    errors = oe.error_columns(preds(frame, [(10.0, 20.0), (30.0, 10.0)]), STUDY)
    report = publish.error_report(errors, 1)
    assert {r.section for r in report.collect()} == {"overall", "route", "day_type", "season", "worst"}
    lines = [r.line for r in publish.report_text(report).orderBy("position").collect()]
    assert lines[0].startswith("overall all mae 15.00")
    panel = frame([("A-B", D - timedelta(9), 1.25), ("A-B", date(2024, 8, 1), 2.0)], "route string, date date, avg_arr_delay double")
    merged = frame([("A-B", date(2024, 8, 1), 2.04, 3.05)], "route string, date date, actual double, ma double")
    shown = frame([("A-B",)], "route string")
    publish.write_forecast(panel, merged, shown, ["ma"], STUDY, f"{tmp_path}/f")
    doc = publish.read_forecast(spark, f"{tmp_path}/f", ["ma"]).first()
    assert doc.predictions[0].actual == 2.0 and len(doc.historical) == 1 and doc.historical[0].actual == 1.2


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    out = []
    for i in range(600):
        x, z = rng.normal(), rng.normal()
        out.append(("A-B", D + timedelta(i), "train" if i < 400 else "val" if i < 500 else "test", x, z, 5 * x + 0.1 * rng.normal()))
    return spark.createDataFrame(out, "route string, date date, split string, x double, z double, avg_arr_delay double")


def test_gbt_learns_and_ranks_features(spark, rows):
    quick = {"n_estimators": 20, "max_depth": 3, "learning_rate": 0.3, "colsample_bytree": 1.0}
    model = fc.fit_gbt(rows, ["x", "z"], quick)
    scored = fc.predict_tabular(model, rows.filter("split = 'test'"), ["x", "z"])
    assert scored.count() == 100 and oe.basic_metrics(scored).first().r2 > 0.8
    top = fc.importance_table(spark, model, ["x", "z"], "gbt").orderBy(F.desc("importance")).first()
    assert top.feature == "x"
    table = {r.model: r.mae for r in fc.ablation(rows, ["x", "z"], ["x"], quick).collect()}
    assert table["ablated"] > 2 * table["all"]


def test_search_beats_random_and_is_seeded():
    space = {"x": Range(-5.0, 5.0), "k": Range(1, 30, step=1), "r": Range(1e-6, 10.0, log=True)}
    loss = lambda s: (s["x"] - 2) ** 2 + 0.3 * abs(s["k"] - 22) + math.log10(s["r"] / 1e-3) ** 2

    def guided(seed):
        search = ParzenSearch(space, seed)
        while len(search.told) < 50:
            for one in search.ask(5):
                search.tell(one, loss(one))
        return [(value, tuple(one.items())) for value, one in search.told]

    assert guided(1) == guided(1) != guided(2)
    best = [min(v for v, _ in guided(seed)) for seed in range(12)]
    by_luck = [min(loss(one) for one in random_settings(space, 50, seed)) for seed in range(12)]
    assert np.mean(best) < 0.6 * np.mean(by_luck) and sum(b < r for b, r in zip(best, by_luck)) >= 9
    for _, one in guided(3):
        one = dict(one)
        assert -5 <= one["x"] <= 5 and one["k"] in range(1, 31) and 1e-6 <= one["r"] <= 10


def test_trials_asked_for_together_differ_and_places_come_back():
    search = ParzenSearch({"x": Range(0.0, 1.0)}, startup=3)
    for one in search.ask(12):
        search.tell(one, one["x"])
    assert len({one["x"] for one in search.ask(8)}) == 8
    for r in fc.GBT_SPACE.values():
        for u in (0.0, 0.2, 0.51, 0.99):
            assert r.value(r.place(r.value(u))) == pytest.approx(r.value(u))
            assert r.low <= r.value(u) <= r.high


def test_tuning_returns_errors_in_order(rows):
    space = {"max_depth": Range(1, 4, step=1), "learning_rate": Range(0.01, 0.5, log=True), "reg_lambda": Range(1e-3, 10.0, log=True)}
    few = {"n_estimators": 30, "early_stopping_rounds": 8}
    got, again = ([tuple(r) for r in fc.tune_gbt(rows, ["x", "z"], 16, 4, space, few).orderBy("rank").collect()] for _ in range(2))
    assert got == again and sorted(r[1] for r in got) == list(range(16))
    assert [r[2] for r in got] == sorted(r[2] for r in got)
    trial = next(r for r in got if not r[4])
    params = {k: float(v) for k, v in (x.split("=") for x in trial[5].split(", "))}
    model = fc.fit_gbt(rows, ["x", "z"], {**few, **params, "max_depth": int(params["max_depth"])})
    val = fc.predict_tabular(model, rows.filter("split = 'val'"), ["x", "z"])
    assert val.agg(F.avg(F.abs(F.col("pred") - F.col("actual")))).first()[0] == pytest.approx(trial[2], rel=1e-3)


def test_seasonal_regression_recovers_weekly_cycle(spark, frame):
    value = lambda i: 10 + 0.01 * i + 4 * math.sin(2 * math.pi * i / 7)
    train = frame([("A-B", D + timedelta(i), value(i)) for i in range(800)], "route string, date date, avg_arr_delay double")
    score = frame([("A-B", D + timedelta(i), 0.0) for i in range(800, 830)] + [("X-Y", D, 0.0)], "route string, date date, avg_arr_delay double")
    got = {(r.route, (r.date - D).days): r.pred for r in fc.seasonal_regression(train, score, yearly=2).collect()}
    assert got["X-Y", 0] == 0.0
    assert max(abs(got["A-B", i] - value(i)) for i in range(800, 830)) < 0.6


def test_a_planted_change_of_trend_is_found(spark, frame):
    """The slope turns at day 400 of 1,000; changes are only kept near it, and the forecast follows the new slope."""
    value = lambda i: 5 + 0.02 * i - 0.05 * max(i - 400, 0) + math.sin(2 * math.pi * i / 7)
    df = frame([("A-B", D + timedelta(i), value(i)) for i in range(1000)], "route string, date date, avg_arr_delay double")
    fit = fc.seasonal_weights(df, yearly=0, l1=5.0).first()
    at = [(c * fc.DECADE - (D - date(1970, 1, 1)).days, s) for c, s in zip(fit.changes, fit.slopes)]
    near = sum(s for c, s in at if abs(c - 400) <= 70)
    assert len(at) == fc.CHANGES and near == pytest.approx(-0.05 * fc.DECADE, rel=0.1)
    assert sum(abs(s) for c, s in at if abs(c - 400) > 70) < 0.1 * abs(near)
    score = frame([("A-B", D + timedelta(i), 0.0) for i in range(1000, 1030)], "route string, date date, avg_arr_delay double")
    got = {(r.date - D).days: r.pred for r in fc.seasonal_regression(df, score, yearly=0, l1=5.0).collect()}
    assert max(abs(got[i] - value(i)) for i in got) < 0.5
    assert fc.seasonal_gradient(df, yearly=0, l1=5.0).first().gradient < 1e-6


def test_trend_lasso_matches_a_plain_solver():
    """Proximal gradient steps over all weights at once, without the elimination and the coordinates."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(200, 9)), rng.normal(size=200) * 3
    y += x[:, 2] * 4 - x[:, 7] * 2
    free, penalised, ridge, l1 = np.arange(5), np.arange(5, 9), np.array([0, 0, 0.5, 0.5, 2.0]), 60.0
    w, full = np.zeros(9), np.concatenate((ridge, np.zeros(4)))
    step = 1 / (np.linalg.norm(x.T @ x, 2) + 2)
    for _ in range(20_000):
        w = w - step * (x.T @ (x @ w - y) + full * w)
        w[5:] = np.sign(w[5:]) * np.maximum(np.abs(w[5:]) - step * l1, 0)
    a, z = fc.trend_lasso(x.T @ x, x.T @ y, free, penalised, ridge, l1)
    assert np.concatenate((a, z)) == pytest.approx(w, abs=1e-7) and (z == 0).any() and (z != 0).any()


def test_each_holiday_has_its_own_effect(spark, frame):
    feast, fast = D + timedelta(50), D + timedelta(200)
    holidays = spark.createDataFrame([(h + timedelta(364 * k), n) for k in range(3) for h, n in ((feast, "feast"), (fast, "fast"))], "date date, name string")
    days = {r.date: r.name for r in holidays.collect()}
    effect = {"feast": 6.0, "fast": -4.0, None: 0.0}
    rows = [("A-B", D + timedelta(i), 1 + effect[days.get(D + timedelta(i))]) for i in range(900)]
    schema = "route string, date date, avg_arr_delay double"
    train, score = frame([r for r in rows if r[1] < D + timedelta(500)], schema), frame(rows[500:], schema)
    got = {r.date: r.pred for r in fc.seasonal_regression(train, score, holidays, yearly=0, weekly=0).collect()}
    for d, name in days.items():
        if d in got:
            assert got[d] == pytest.approx(1 + effect[name], abs=0.05)


def test_score_sequences_is_a_dot_product(frame):
    df = frame([("A", D, 1.0, [[1.0, 2.0], [3.0, 4.0]])], "route string, date date, target double, x array<array<double>>")
    got = fc.score_sequences(df, fc.linear_scorer([[1, 0], [0, 10]]), 2, 2).first()
    assert got.pred == 41.0


def test_correlation_of_a_constant_is_null(spark):
    df = spark.range(1000).select(F.lit(0.1).alias("x"), F.rand(1).alias("y"), F.col("id").cast("double").alias("z")).repartition(7)
    got = {(r.a, r.b): r["corr"] for r in oi.correlation_matrix(df, ["x", "y", "z"]).collect()}
    assert got["x", "y"] is None and got["x", "x"] is None and got["z", "z"] == pytest.approx(1.0) and abs(got["y", "z"]) < 0.2


def test_pairwise_correlations_with_holes_in_many_tasks(spark):
    """Against pandas, which also takes the rows where both are present; one short row per task and pair is shuffled."""
    rng = np.random.default_rng(8)
    wide = pd.DataFrame(rng.normal(size=(500, 4)), columns=list("abcd"))
    wide["b"] += wide["a"]
    wide["c"] = 1e9 + wide["c"] * 1e-3 + wide["a"] * 1e-3
    wide = wide.mask(rng.random(wide.shape) < 0.3)
    wide["e"] = 7.0
    df = spark.createDataFrame(wide.astype(object).where(wide.notna(), None).values.tolist(), ", ".join(f"{c} double" for c in "abcde")).repartition(9)
    got = {(r.a, r.b): r["corr"] for r in oi.correlation_matrix(df, list("abcde")).collect()}
    want = wide.assign(c=wide["c"] - 1e9).corr()  # the same numbers, near 0
    assert len(got) == 25
    for x in "abcd":
        for y in "abcd":
            assert got[x, y] == pytest.approx(want.loc[x, y], abs=1e-9)
        assert got[x, "e"] is None
    parts = oi.pair_moments(df.select(F.array(*"abcde").alias("x")), [(0, 1), (2, 2)])
    assert parts.count() <= 2 * 9
    empty = {(r.a, r.b): r["corr"] for r in oi.correlation_matrix(df.limit(0), ["a", "b"]).collect()}
    assert set(empty.values()) == {None} and len(empty) == 4
