"""Cleaning, panel and weather operators on hand-made rows."""

import gzip
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelcast import config
from panelcast.catalog.queries import QUERIES
from panelcast.functions import text as tx
from panelcast.functions import weather as fw
from panelcast.operators import clean as oc
from panelcast.operators import panel as op
from panelcast.operators import weather as ow
from panelcast.plans.panel import build_panel
from panelcast.sources import flights as sf
from panelcast.sources import starschema
from panelcast.sources import tables as st
from panelcast.sources import weather as sw

FLIGHT = "FL_DATE date, REPORTING_AIRLINE string, ORIGIN string, DEST string, DEP_DELAY double, ARR_DELAY double, CANCELLED int, DISTANCE double, route string"


def flight(day, route, arr, cancelled=0, carrier="AA", dist=100.0):
    o, d = route.split("-")
    return (day, carrier, o, d, arr, arr, cancelled, dist, route)


def test_clean_flights_types_and_drops(frame):
    raw = frame(
        [
            ("2020-01-02", " aa", None, "lax ", "JFK", "5.5", "x", None, "100"),
            ("1/3/2020 12:00:00 AM", None, "dl", "LAX", "jfk", "", "7", "1.0", None),
            ("1/4/2020", "ua", "ua", None, "JFK", "1", "2", "0", "3"),
            (None, "ua", "ua", "LAX", "JFK", "1", "2", "0", "3"),
        ],
        "FL_DATE string, REPORTING_AIRLINE string, OP_UNIQUE_CARRIER string, ORIGIN string, DEST string, "
        "DEP_DELAY string, ARR_DELAY string, CANCELLED string, DISTANCE string",
    )
    rows = {r.FL_DATE: r for r in oc.clean_flights(raw).collect()}
    assert set(rows) == {date(2020, 1, 2), date(2020, 1, 3)}
    first, second = rows[date(2020, 1, 2)], rows[date(2020, 1, 3)]
    assert (first.REPORTING_AIRLINE, first.route, first.DEP_DELAY, first.ARR_DELAY, first.CANCELLED) == ("AA", "LAX-JFK", 5.5, None, 0)
    assert (second.REPORTING_AIRLINE, second.DEP_DELAY, second.ARR_DELAY, second.CANCELLED) == ("DL", None, 7.0, 1)


def test_nan_is_missing(frame):
    df = frame([(float("nan"), 1.0), (2.0, None)], "x double, y double")
    assert [(r.x, r.y) for r in oc.nan_to_null(df).collect()] == [(None, 1.0), (2.0, None)]
    raw = frame([("20200105", "AA", "A", "B", "NaN", "1", "NaN", "2")], "FL_DATE string, REPORTING_AIRLINE string, ORIGIN string, "
                "DEST string, DEP_DELAY string, ARR_DELAY string, CANCELLED string, DISTANCE string")
    row = oc.clean_flights(raw).first()
    assert (row.FL_DATE, row.DEP_DELAY, row.CANCELLED) == (date(2020, 1, 5), None, 0)


def test_legend_labels(frame):
    names = ["Acme Air, Inc.", "ExpressJet Airlines LLC d/b/a aha!", "Blue Corp", "Incline Co. Air"]
    df = frame([(n,) for n in names], "name string")
    got = [r.label for r in df.select(tx.legend_label("name").alias("label")).collect()]
    # a suffix ends at a word boundary, so its full stop is left to the trailing-punctuation rule, the comma before it stays
    assert got == ["Acme Air,", "ExpressJet (aha!)", "Blue", "Incline . Air"]


def test_hot_route_keeps_every_row(spark):
    """One route with most of the rows: counts and sums stay whole."""
    rows = spark.range(200000).select(
        F.when(F.col("id") % 3 < 2, "A-B").otherwise(F.concat(F.lit("C-"), (F.col("id") % 50).cast("string"))).alias("route"),
        F.date_add(F.lit(date(2020, 1, 1)), (F.col("id") % 30).cast("int")).alias("FL_DATE"),
        F.lit("AA").alias("REPORTING_AIRLINE"), F.lit(1.0).alias("DEP_DELAY"), F.lit(2.0).alias("ARR_DELAY"),
        F.lit(0).alias("CANCELLED"), F.lit(1.0).alias("DISTANCE"),
    )
    out = op.aggregate_daily(rows).groupBy().agg(F.sum("flight_count").alias("n"), F.sum("total_distance").alias("d")).first()
    assert (out.n, out.d) == (200000, 200000.0)


def test_top_routes_breaks_ties_by_name(frame):
    df = frame([("B-C",), ("A-B",), ("C-D",), ("C-D",)], "route string")
    assert [r.route for r in op.top_routes(df, 2).collect()] == ["C-D", "A-B"]


def test_aggregate_daily_all_cancelled_day(frame):
    d = date(2020, 1, 1)
    df = frame([flight(d, "A-B", None, 1, "DL"), flight(d, "A-B", None, 1, "AA", None), flight(d, "A-C", 3.0)], FLIGHT)
    rows = {r.route: r for r in op.aggregate_daily(df).collect()}
    assert rows["A-B"].avg_arr_delay is None and rows["A-B"].flight_count == 2 and rows["A-B"].cancel_rate == 1.0
    assert rows["A-B"].carriers == "AA,DL" and rows["A-B"].total_distance == 100.0
    slim = op.aggregate_daily(df.drop("REPORTING_AIRLINE", "DISTANCE"))
    assert "carriers" not in slim.columns and {r.route: r.flight_count for r in slim.collect()} == {"A-B": 2, "A-C": 1}


def test_gap_of_nine_days_carries_seven(frame):
    start = date(2020, 1, 1)
    df = frame([flight(start, "A-B", 4.0), flight(start + timedelta(10), "A-B", 8.0), flight(start + timedelta(5), "A-C", 1.0)], FLIGHT)
    panel = op.fill_missing_dates(op.add_route_metadata(op.aggregate_daily(df)))
    rows = {(r.route, (r.date - start).days): r for r in panel.collect()}
    assert len(rows) == 2 * 11
    assert [rows["A-B", i].avg_arr_delay for i in range(11)] == [4.0] * 8 + [0.0, 0.0, 8.0]
    assert [rows["A-C", i].avg_arr_delay for i in range(11)] == [0.0] * 5 + [1.0] * 6
    gap = rows["A-B", 3]
    assert (gap.flight_count, gap.cancelled_count, gap.cancel_rate) == (0, 0, 0.0)
    assert gap.total_distance is None and gap.carriers is None and gap.total_flights == 2


def test_all_cancelled_day_keeps_count_and_carries_delay(frame):
    start = date(2020, 1, 1)
    df = frame([flight(start, "A-B", 4.0), flight(start + timedelta(1), "A-B", None, 1)], FLIGHT)
    rows = {r.date: r for r in op.fill_missing_dates(op.aggregate_daily(df)).collect()}
    second = rows[start + timedelta(1)]
    assert second.flight_count == 1 and second.avg_arr_delay == 4.0 and second.cancel_rate == 1.0


def test_gap_fill_matches_grid_join(frame):
    start = date(2020, 1, 1)
    days = {"A-B": [3, 4, 20], "A-C": [0, 1, 2, 15], "B-A": [7]}
    df = frame([flight(start + timedelta(i), r, float(i)) for r, ds in days.items() for i in ds], FLIGHT)
    daily = op.aggregate_daily(df)
    spine = {(r.route, r.date) for r in op.calendar_spine(daily).collect()}
    panel = [(r.route, r.date) for r in op.fill_missing_dates(daily).collect()]
    assert len(panel) == len(set(panel)) == 3 * 21 and set(panel) == spine


def test_build_panel_picks_busiest(frame):
    start = date(2020, 1, 1)
    rows = [flight(start + timedelta(i % 3), "A-B", 1.0) for i in range(9)] + [flight(start, "A-C", 1.0)] * 4 + [flight(start, "C-A", 1.0)]
    panel = build_panel(frame(rows, FLIGHT), 2)
    assert {(r.route, r["count"]) for r in panel.groupBy("route").count().collect()} == {("A-B", 3), ("A-C", 3)}


CODES = {
    None: ("clear", 0), 0: ("clear", 0), 1: ("cloudy", 1), 3: ("cloudy", 1), 42: ("other", 2), 45: ("fog", 2),
    53: ("drizzle", 2), 55: ("dense_drizzle", 3), 57: ("freezing_drizzle", 4), 61: ("rain", 3), 65: ("heavy_rain", 4),
    67: ("freezing_rain", 4), 77: ("snow", 4), 80: ("rain_showers", 3), 82: ("heavy_showers", 4), 86: ("snow_showers", 4),
    95: ("thunderstorm", 5), 99: ("thunderstorm", 5),
}


def test_weather_codes(frame):
    df = frame([(c,) for c in CODES], "weather_code int")
    out = df.select("weather_code", fw.weather_condition("weather_code").alias("c"), fw.code_severity("weather_code").alias("s"))
    assert {r.weather_code: (r.c, r.s) for r in out.collect()} == CODES


def test_unknown_condition_and_label(frame):
    df = frame([("hail", 7)], "c string, s int")
    row = df.select(fw.condition_severity("c").alias("sev"), fw.severity_label("s").alias("label")).first()
    assert (row.sev, row.label) == (2, "Level 7")


def test_hourly_roll_up_needs_operating_hours(frame):
    at = lambda d, h: datetime(2020, 1, d, h)
    df = frame(
        [(at(1, 3), "A", 9.0, 1.0, 95), (at(1, 5), "A", 1.0, 1.0, 65), (at(1, 6), "A", 2.0, 0.5, 0), (at(2, 4), "A", 5.0, 1.0, 0)],
        "datetime timestamp_ntz, airport string, wind_speed double, precip double, weather_code int",
    )
    rows = ow.hourly_to_daily(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.peak_wind_operating, r.precip_operating, r.max_hourly_severity, r.storm_hours) == (2.0, 0.5, 5, 2)
    assert (r.morning_severity, r.evening_severity) == (4, 0)


def _weather(frame, rows):
    schema = "date date, airport string, " + ", ".join(
        f"{c} {'int' if c in ('severity', 'is_adverse') else 'double'}" for c in config.WEATHER_COLUMNS
    )
    full = []
    for day, airport, severity, wind in rows:
        values = {c: 1.0 for c in config.WEATHER_COLUMNS}
        values.update(severity=severity, is_adverse=int(severity >= 3), wind_speed_max=wind)
        full.append((day, airport, *[values[c] for c in config.WEATHER_COLUMNS]))
    return frame(full, schema)


def test_weather_on_one_side_and_none(frame):
    d = date(2020, 1, 1)
    panel = frame([("A-B", d), ("C-D", d), ("A-A", d)], "route string, date date")
    rows = {r.route: r for r in ow.merge_weather(panel, _weather(frame, [(d, "A", 4, 9.0)])).collect()}
    one, none, both = rows["A-B"], rows["C-D"], rows["A-A"]
    assert (one.weather_severity_max, one.weather_severity_combined, one.has_adverse_weather, one.max_wind) == (4, 4.0, 1, 9.0)
    assert (one.total_precip, one.storm_hours) == (1.0, 1.0)
    assert (none.weather_severity_max, none.weather_severity_combined, none.has_adverse_weather) == (None, None, 0)
    assert (none.total_precip, none.storm_hours, none.max_wind) == (0.0, 0.0, None)
    assert both.total_precip == 2.0
    assert ow.match_rate(ow.merge_weather(panel, _weather(frame, [(d, "A", 4, 9.0)]))).first()[0] == pytest.approx(200 / 3)


def test_keep_first_existing_wins(frame):
    d = date(2020, 1, 1)
    old = frame([("A", d, 1.0)], "airport string, date date, x double")
    new = frame([("A", d, 0.5), ("B", d, 2.0)], "airport string, date date, x double")
    assert {(r.airport, r.x) for r in sw.keep_first(old, new).collect()} == {("A", 1.0), ("B", 2.0)}


def test_csv_headers_that_differ(spark, tmp_path):
    (tmp_path / "a.csv").write_text("FL_DATE,REPORTING_AIRLINE,ORIGIN,DEST,ARR_DELAY,EXTRA\n2020-01-01,AA,LAX,JFK,1,z\n")
    (tmp_path / "b.csv").write_text('"DEST","ORIGIN","FL_DATE","OP_UNIQUE_CARRIER"\nSFO,LAX,2020-01-02,DL\n')
    df = sf.scan_flights_csv(spark, f"{tmp_path}/*.csv")
    assert df.columns == config.FLIGHT_COLUMNS
    rows = {r.FL_DATE: r for r in oc.clean_flights(df).collect()}
    assert rows[date(2020, 1, 1)].REPORTING_AIRLINE == "AA" and rows[date(2020, 1, 2)].REPORTING_AIRLINE == "DL"
    assert rows[date(2020, 1, 2)].route == "LAX-SFO"
    assert "EXTRA" in sf.scan_all_columns(spark, f"{tmp_path}/*.csv").columns
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write("\ufeffFL_DATE,ORIGIN,DEST\n2020-01-03,LAX,SEA\n")
    assert sf.scan_flights_csv(spark, f"{tmp_path}/*.csv*").filter("DEST = 'SEA'").first().FL_DATE == "2020-01-03"
    with pytest.raises(FileNotFoundError):
        sf.scan_all_columns(spark, f"{tmp_path}/none*.csv")


def test_panel_round_trip_prunes_folders(spark, frame, tmp_path):
    d = date(2020, 1, 1)
    df = frame([("A-B", d, 1.0), ("A-C", d, 2.0)], "route string, date date, x double")
    st.write_panel(df, f"{tmp_path}/p")
    back = st.read_panel(spark, f"{tmp_path}/p").filter("route = 'A-B'")
    assert [r.x for r in back.collect()] == [1.0]
    plan = back._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(route" in plan


def test_profile_counts_nulls(frame):
    df = frame([("A", date(2020, 1, 1), None), ("A", date(2020, 1, 2), 1.0)], "route string, date date, x double")
    got = {r.name: r.value for r in st.profile_table(df).collect()}
    assert got == {"rows": "2", "distinct_keys": "1", "first_date": "2020-01-01", "last_date": "2020-01-02",
                   "nulls_route": "0", "nulls_date": "0", "nulls_x": "1"}


def test_flights_scan_reads_only_needed_columns(spark, sf_dir):
    from panelcast.sources import starschema

    plan = starschema.flights(spark, sf_dir, False, False).groupBy("route").agg(F.sum("ARR_DELAY"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in text and "p_brand" not in text and "CartesianProduct" not in text


def test_dates_in_many_forms(spark):
    forms = ["2020-01-05", "1/5/2020", "20200105", "2020/01/05", "05-Jan-2020", "January 5, 2020", "Jan 5, 2020", "1/5/20", "5 Jan 2020", "2020-01-05 10:30:00", "2020-01-05T10:30:00", " 01/05/2020 00:00 "]
    df = spark.createDataFrame([(x,) for x in forms], "d string")
    assert {r.d for r in df.select(oc.parse_mixed_date("d").alias("d")).collect()} == {date(2020, 1, 5)}
    old = spark.createDataFrame([("1/5/95",), (None,), ("",)], "d string").select(oc.parse_mixed_date("d").alias("d"))
    assert [r.d for r in old.collect()] == [date(1995, 1, 5), None, None]
    for bad in ("soon", "2020-13-45", "13/45/2020", "1/2-2020", "Janu 5, 2020", "5-Jan 2020", "a|b|c", "2020-01-05 soon"):
        with pytest.raises(Exception, match="not a date"):
            spark.createDataFrame([(bad,)], "d string").select(oc.parse_mixed_date("d").alias("d")).collect()


def test_two_weather_rows_are_an_error_and_months_do_not_multiply(spark):
    cols = {c: F.lit(1.0) for c in config.WEATHER_COLUMNS}
    weather = spark.createDataFrame([("A", date(2020, 1, 1)), ("A", date(2020, 1, 1))], "airport string, date date").withColumns(cols)
    panel = spark.createDataFrame([("A-B", date(2020, 1, 1))], "route string, date date")
    with pytest.raises(Exception, match="two weather rows"):
        ow.join_weather_two_sided(panel, weather).collect()
    months = spark.createDataFrame([("A", date(2020, m, 1), m) for m in (1, 2, 3)], "airport string, date date, v int")
    days = spark.createDataFrame([(date(1999, 5, 1),), (date(1999, 6, 1),)], "date date")
    assert [(r.airport, r.v) for r in starschema.spread_over_calendar(months, days).collect()] == [("A", 3), ("A", 3)]


@pytest.mark.parametrize("name", ["coalesce_carrier", "top_carriers", "carrier_performance", "legend_label", "school_break", "era_label", "holiday_week", "missing_keys_resume"])
def test_plans_without_order_joins(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan and "c_custkey" not in plan


def test_headers_with_quotes_and_commas(spark, tmp_path):
    (tmp_path / "a.csv").write_text('FL_DATE,"ORIGIN","note, long"\n2020-01-01,A,"x"\n')
    (tmp_path / "b.csv").write_text("ORIGIN,DEST\nB,C\n")
    rows = sf.scan_all_columns(spark, f"{tmp_path}/*.csv").collect()
    assert {(r.ORIGIN, r.DEST, r["note, long"]) for r in rows} == {("A", None, "x"), ("B", "C", None)}


def test_every_day_in_every_form(spark):
    forms = ["M/d/yyyy", "MM/dd/yyyy", "yyyyMMdd", "yyyy-MM-dd", "yyyy-M-d", "d-MMM-yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy/MM/dd", "M/d/yy", "d MMM yyyy"]
    days = spark.sql("SELECT explode(sequence(DATE'1999-01-01', DATE'2001-03-01')) AS day")
    written = days.select("day", F.explode(F.array(*[F.date_format("day", x) for x in forms])).alias("text"))
    written = written.withColumn("text", F.explode(F.array(F.col("text"), F.upper("text"), F.concat(F.lit(" "), F.lower("text"), F.lit(" 07:30")))))
    rows = written.select("day", oc.parse_mixed_date("text").alias("got"))
    assert rows.filter("NOT (day <=> got)").count() == 0 and rows.count() > 20_000


def test_cleaning_stays_in_generated_code(spark):
    """One stage of generated code, below the size at which Spark gives it up, and one parse per row."""
    raw = spark.createDataFrame([("1/5/2020", "AA", " lax", "jfk", "1", "2", "0", "9")] * 3, ", ".join(f"{c} string" for c in ["FL_DATE", "REPORTING_AIRLINE", "ORIGIN", "DEST", "DEP_DELAY", "ARR_DELAY", "CANCELLED", "DISTANCE"]))
    plan = oc.clean_flights(raw)._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert text.count("regexp_replace") <= 6
    debug = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package").codegenStringSeq(plan.executedPlan())
    sizes = [debug.apply(i)._3().maxMethodCodeSize() for i in range(debug.size())]
    assert sizes and max(sizes) < 8_000


def test_header_reads_do_not_grow_with_the_files(spark, tmp_path):
    """Two files of over 100 MB: bytes that the file system hands out while headers are looked for."""
    line = "2020-01-01,LAX,JFK," + "x" * 980 + "\n"
    for name, columns in (("a", "FL_DATE,ORIGIN,DEST,NOTE"), ("b", "FL_DATE,ORIGIN,DEST,REMARK")):
        with open(tmp_path / f"{name}.csv", "w") as f:
            f.write(columns + "\n")
            for _ in range(11):
                f.write(line * 10_000)
    assert min((tmp_path / f"{n}.csv").stat().st_size for n in "ab") > 100_000_000
    statistics = spark._jvm.org.apache.hadoop.fs.FileSystem

    def read():
        return sum(s.getBytesRead() for s in statistics.getAllStatistics())

    before = read()
    settings = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert {h.split(",")[-1] for h in sf.headers(spark, f"{tmp_path}/*.csv")} == {"NOTE", "REMARK"}
    assert read() - before <= 2 * 65_536 + 1_000
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == settings
    df = sf.scan_all_columns(spark, f"{tmp_path}/*.csv")
    assert read() - before <= 4 * 65_536 + 2_000
    assert df.columns == ["FL_DATE", "ORIGIN", "DEST", "NOTE", "REMARK"]
