"""Feature, baseline, fold and sequence operators against pandas."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast import config
from panelcast.config import STUDY, Fold, shift_years
from panelcast.functions import calendar as cal
from panelcast.operators import baselines as ob
from panelcast.operators import features as of
from panelcast.operators import folds as fo

START = date(1999, 1, 1)


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(7)
    rows = []
    for route, n in (("A-B", 400), ("B-A", 400), ("C-D", 1)):
        for i in range(n):
            rows.append((route, START + timedelta(i), float(np.round(rng.normal(5, 20), 3)), int(rng.integers(1, 9))))
    return pd.DataFrame(rows, columns=["route", "date", "avg_arr_delay", "flight_count"])


@pytest.fixture(scope="module")
def panel(spark, series):
    return spark.createDataFrame(series, "route string, date date, avg_arr_delay double, flight_count long").cache()


def pandas_of(df):
    return df.toPandas().sort_values(["route", "date"]).reset_index(drop=True)


def close(a, b):
    np.testing.assert_allclose(a.astype(float), b.astype(float), rtol=1e-9, atol=1e-9, equal_nan=True)


def test_lag_features_match_pandas(panel, series):
    got = pandas_of(of.lag_features(panel))
    g = series.groupby("route")["avg_arr_delay"]
    for k in (1, 7, 14, 28):
        close(got[f"lag_{k}_arr_delay"], g.shift(k))
    for k in (7, 14):
        close(got[f"rolling_mean_{k}_arr_delay"], g.transform(lambda x: x.shift(1).rolling(k, min_periods=1).mean()))
        close(got[f"rolling_std_{k}_arr_delay"], g.transform(lambda x: x.shift(1).rolling(k, min_periods=1).std()))
    close(got["ewm_7_arr_delay"], g.transform(lambda x: x.shift(1).ewm(span=7, min_periods=1).mean()))


def test_lags_never_see_today(panel):
    day = START + timedelta(200)
    changed = panel.withColumn("avg_arr_delay", F.when(F.col("date") == day, 1e6).otherwise(F.col("avg_arr_delay")))
    pick = lambda df: pandas_of(of.lag_features(df).filter(F.col("date") <= day))[config.LAG_FEATURES]
    pd.testing.assert_frame_equal(pick(panel), pick(changed))


def test_train_stats_ignore_test_rows(panel):
    cut = "1999-09-01"
    changed = panel.withColumn("flight_count", F.when(F.col("date") >= cut, 999).otherwise(F.col("flight_count")))
    pick = lambda df: pandas_of(of.train_route_stats(df, cut))[config.ROUTE_FEATURES[1:]]
    pd.testing.assert_frame_equal(pick(panel), pick(changed))


def test_train_stats_match_pandas(panel, series):
    cut = "1999-09-01"
    got = pandas_of(of.train_route_stats(panel, cut)).groupby("route").first()
    train = series[series["date"] < date(1999, 9, 1)].groupby("route")
    close(got["route_mean_demand"], train["flight_count"].mean())
    close(got["route_std_demand"], train["flight_count"].std())
    close(got["route_median_demand"], train["flight_count"].median())
    close(got["route_delay_std"], train["avg_arr_delay"].std().fillna(0))


def test_impute_lags_uses_train_median_then_zero(panel, series):
    got = pandas_of(of.impute_lags(of.lag_features(panel), "1999-09-01"))
    want = series.groupby("route")["avg_arr_delay"].shift(7)
    train = want[series["date"] < date(1999, 9, 1)].groupby(series["route"]).median()
    close(got["lag_7_arr_delay"], want.fillna(series["route"].map(train)).fillna(0))
    zero = pandas_of(of.impute_lags(of.lag_features(panel), "1999-09-01", std_fill="zero"))
    assert zero.groupby("route")["rolling_std_7_arr_delay"].first().eq(0).all()


def test_ewm_of_constant_is_constant(spark):
    df = spark.createDataFrame([("A", START + timedelta(i), 3.0) for i in range(300)], "route string, date date, x double")
    values = {round(r.e, 12) for r in of.with_ewm(df, "x", "e").collect() if r.e is not None}
    assert values == {3.0}


@pytest.mark.parametrize("span", [1, 2, 7, 30, 90])
def test_ewm_matches_pandas_over_long_spans(spark, span):
    pdf = pd.DataFrame({"route": "A", "date": [START + timedelta(i) for i in range(600)], "x": [500.0 - i for i in range(600)]})
    pdf.loc[[3, 64, 65, 300], "x"] = None
    df = spark.createDataFrame(pdf, "route string, date date, x double").withColumn("x", F.nullif("x", F.lit(float("nan"))))
    got = [r.e for r in of.with_ewm(df, "x", "e", span).orderBy("date").collect()]
    want = pdf["x"].ewm(span=span).mean().shift(1)
    assert got[0] is None and np.allclose(np.array(got[1:], float), want[1:].to_numpy(), rtol=1e-9)


def test_route_code_is_alphabetic(panel):
    got = {(r.route, r.route_encoded) for r in of.route_code(panel).select("route", "route_encoded").distinct().collect()}
    assert got == {("A-B", 0), ("B-A", 1), ("C-D", 2)}


def test_impute_weather_fills(spark):
    zero = ["apt1_severity", "weather_severity_max", "max_wind"]
    rows = [("A-B", START, None, None, None, 10.0, None), ("A-B", START + timedelta(1), 1, 2, 3.0, 20.0, None),
            ("A-B", date(2005, 1, 1), 1, 2, 3.0, None, None)]
    df = spark.createDataFrame(rows, "route string, date date, apt1_severity int, weather_severity_max int, max_wind double, apt1_temp_avg double, apt2_temp_avg double")
    got = {r.date: r for r in of.impute_weather(df, "2000-01-01").collect()}
    assert all(got[START][c] == 0 for c in zero)
    assert got[date(2005, 1, 1)].apt1_temp_avg == 15.0 and got[START].apt2_temp_avg == 50.0


def test_known_holidays(spark):
    days = {r.date for r in cal.federal_holidays(spark, 2020, 2022).collect()}
    for d in ("2020-01-20", "2020-07-03", "2020-07-04", "2021-06-18", "2021-06-19", "2021-12-31", "2022-06-20", "2022-11-24", "2022-12-26"):
        assert date.fromisoformat(d) in days, d
    assert date(2020, 6, 19) not in days
    plain = {r.date for r in cal.federal_holidays(spark, 2020, 2022, observed=False).collect()}
    assert date(2020, 7, 3) not in plain and len(plain) == 10 + 11 + 11


def test_holiday_edges(spark):
    days = spark.createDataFrame([(date(2021, 11, d),) for d in (24, 25, 26)] + [(date(2021, 8, 1),)], "date date")
    got = {r.date: r for r in of.holiday_features(days, cal.federal_holidays(spark, 2021, 2021)).collect()}
    before, on, after, far = (got[d] for d in (date(2021, 11, 24), date(2021, 11, 25), date(2021, 11, 26), date(2021, 8, 1)))
    assert (before.days_to_holiday, before.is_federal_holiday, before.is_holiday_week) == (1, 0, 1)
    assert (on.is_federal_holiday, on.days_to_holiday, on.days_from_holiday, on.is_holiday_week) == (1, 29, 14, 0)
    assert (after.days_from_holiday, after.is_holiday_week) == (1, 1)
    assert (far.days_to_holiday, far.days_from_holiday) == (30, 27)


def test_feature_lists_are_complete():
    assert len(config.TABULAR_FEATURES) == len(set(config.TABULAR_FEATURES)) == 63
    assert len(config.SEQUENCE_FEATURES) == 26 and len(config.WEATHER_FEATURES) == 28
    assert len(of.ablated(config.TABULAR_FEATURES)) == 35


def test_shifted_study():
    cut = shift_years(STUDY, -24)
    assert (cut.train_end, cut.era_start, cut.folds[0].test_start) == ("2000-01-01", "1996-03-01", "1999-01-01")


def test_baselines_match_pandas(panel, series):
    cut = "1999-09-01"
    models = {"naive": ob.naive(), "s7": ob.seasonal_naive(), "ma": ob.moving_average(window=14)}
    got = pandas_of(ob.predict(panel, models, cut))
    train = series[series["date"] < date(1999, 9, 1)]
    med, overall = train.groupby("route")["avg_arr_delay"].median(), train["avg_arr_delay"].median()
    g = series.groupby("route")["avg_arr_delay"]
    fill = lambda p: p.fillna(series["route"].map(med)).fillna(overall)
    close(got["naive"], fill(g.shift(1)))
    close(got["s7"], fill(g.shift(7)))
    close(got["ma"], fill(g.transform(lambda x: x.shift(1).rolling(14, min_periods=1).mean())))
    fitted = {r.route: r.median for r in ob.fit_medians(panel.filter(F.col("date") < cut)).collect()}
    assert fitted[None] == pytest.approx(overall) and fitted["A-B"] == pytest.approx(med["A-B"])


def test_unseen_route_falls_back_to_overall_median(spark):
    rows = [("A", START + timedelta(i), float(i)) for i in range(5)] + [("B", START + timedelta(9), 7.0)]
    df = spark.createDataFrame(rows, "route string, date date, avg_arr_delay double")
    got = {r.route: r.p for r in ob.predict(df, {"p": ob.naive()}, "1999-01-06").filter("route = 'B'").collect()}
    assert got == {"B": 2.0}


FOLDS = (Fold(1, "1999-03-01", "1999-04-01", "1999-04-01", "1999-06-01"), Fold(2, "1999-04-01", "1999-05-01", "1999-06-01", "1999-08-01"),
         Fold(3, "1999-04-01", "1999-05-01", "2005-06-01", "2005-08-01"))


def test_fold_roles_are_disjoint_and_half_open(panel):
    rows = fo.assign_folds(panel.filter("route = 'A-B'"), FOLDS)
    assert rows.groupBy("fold", "date").count().filter("count > 1").isEmpty()
    role = {(r.fold, str(r.date)): r.role for r in rows.select("fold", "date", "role").collect()}
    assert (role[1, "1999-02-28"], role[1, "1999-03-01"], role[1, "1999-04-01"]) == ("train", "val", "test")
    assert (1, "1999-06-01") not in role and (2, "1999-05-15") not in role


def test_fold_baselines_match_pandas(panel, series):
    got = fo.fold_baselines(panel, FOLDS).toPandas()
    assert set(got["fold"]) == {1, 2}
    for f in FOLDS[:2]:
        lo, hi = date.fromisoformat(f.test_start), date.fromisoformat(f.test_end)
        train = series[series["date"] < date.fromisoformat(f.train_end)].groupby("route")["avg_arr_delay"].median()
        test = series[(series["date"] >= lo) & (series["date"] < hi)]
        want = test.groupby("route")["avg_arr_delay"].shift(1).fillna(test["route"].map(train))
        one = got[(got["fold"] == f.fold) & (got["model"] == "naive")].sort_values(["route", "date"])
        close(one["pred"].to_numpy(), want.to_numpy())


def test_slice_without_fallback_drops_first_row(panel):
    got = ob.predict_in_slice(panel, {"naive": ob.naive()}, "1999-06-01", "1999-06-11")
    assert got.count() == 2 * 9 and got.agg(F.min("date")).first()[0] == date(1999, 6, 2)


def test_scaler_uses_population_deviation_and_guards_zero(panel, series):
    stats = fo.scaler_stats(panel.withColumn("one", F.lit(1.0)), ["avg_arr_delay", "one"])
    got = {r.feature: (r["mean"], r["std"]) for r in stats.collect()}
    assert got["avg_arr_delay"][1] == pytest.approx(series["avg_arr_delay"].std(ddof=0)) and got["one"] == (1.0, 1.0)
    scaled = fo.scale(panel, fo.scaler_stats(panel, ["avg_arr_delay"]), ["avg_arr_delay"])
    back = fo.inverse_scale(scaled, fo.scaler_stats(panel, ["avg_arr_delay"]), "avg_arr_delay", ["avg_arr_delay"])
    close(pandas_of(back)["avg_arr_delay"], series["avg_arr_delay"])


def test_sequence_windows_reach_before_start_or_not(panel, series):
    full = fo.sequence_windows(panel, ["avg_arr_delay"], start="1999-06-01", end="1999-07-11").toPandas()
    inside = fo.sequence_windows(panel, ["avg_arr_delay"], start="1999-06-01", end="1999-07-11", in_split=True)
    assert len(full) == 2 * 40 and inside.count() == 2 * 12
    one = full[(full["route"] == "A-B") & (full["date"] == date(1999, 6, 1))].iloc[0]
    ab = series[series["route"] == "A-B"].set_index("date")["avg_arr_delay"]
    want = [ab[date(1999, 6, 1) - timedelta(28 - i)] for i in range(28)]
    assert [x[0] for x in one["x"]] == want and one["target"] == ab[date(1999, 6, 1)]


def test_overlapping_folds_keep_all_rows(panel, series):
    folds = [Fold(1, "1999-03-01", "1999-04-01", "1999-04-01", "1999-07-01"), Fold(2, "1999-05-01", "1999-06-01", "1999-06-01", "1999-09-01")]
    got = pandas_of(fo.fold_baselines(panel, folds)).groupby(["fold", "model"]).size()
    days = pd.to_datetime(series["date"])
    for fold in folds:
        inside = ((days >= fold.test_start) & (days < fold.test_end)).sum()
        assert got[fold.fold, "naive"] == got[fold.fold, "ma"] == inside
