"""SQL twins of the registered queries, for DuckDB over the same tables."""

from panelcast import config
from panelcast.catalog.base import CUT, DIGITS, EXCLUDED_CARRIERS, N_ROUTES, OVERLAPPING, TOP_ROUTES
from panelcast.operators.insights import CATEGORIES

ORACLES = {}

FLIGHTS = """
flights AS (
  SELECT CAST(l_shipdate AS DATE) AS FL_DATE, p_brand AS REPORTING_AIRLINE,
         substr(ro.r_name, 1, 3) AS ORIGIN, substr(rd.r_name, 1, 3) AS DEST,
         CASE WHEN l_returnflag = 'R' AND l_quantity >= 46 THEN 1 ELSE 0 END AS CANCELLED,
         CASE WHEN l_returnflag = 'R' AND l_quantity >= 46 THEN NULL ELSE (l_quantity - 18) * 1.5 END AS ARR_DELAY,
         CASE WHEN l_returnflag = 'R' AND l_quantity >= 46 THEN NULL
              ELSE (l_quantity - 18) * 1.5 + (l_discount - 0.05) * 100 END AS DEP_DELAY,
         CAST(p_size * 100 AS DOUBLE) AS DISTANCE,
         substr(ro.r_name, 1, 3) || '-' || substr(rd.r_name, 1, 3) AS route
  FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation no ON s_nationkey = no.n_nationkey JOIN region ro ON no.n_regionkey = ro.r_regionkey
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation nd ON c_nationkey = nd.n_nationkey JOIN region rd ON nd.n_regionkey = rd.r_regionkey
  JOIN part ON l_partkey = p_partkey)"""

DAILY_ALL = FLIGHTS + """,
daily_all AS (
  SELECT FL_DATE AS date, route, count(*) AS flight_count, CAST(sum(CANCELLED) AS BIGINT) AS cancelled_count,
         avg(DEP_DELAY) AS avg_dep_delay, avg(ARR_DELAY) AS avg_arr_delay,
         coalesce(sum(DISTANCE), 0) AS total_distance,
         string_agg(DISTINCT REPORTING_AIRLINE, ',' ORDER BY REPORTING_AIRLINE) AS carriers,
         sum(CANCELLED) / count(*) AS cancel_rate
  FROM flights GROUP BY 1, 2)"""


def gap_filled(source):
    """CTEs meta, spine and filled over a daily table."""
    return f"""
meta AS (
  SELECT route, avg(flight_count) AS avg_daily_flights, CAST(sum(flight_count) AS BIGINT) AS total_flights,
         avg(total_distance / flight_count) AS avg_distance
  FROM {source} GROUP BY route),
spine AS (
  SELECT r.route, CAST(t.d AS DATE) AS date
  FROM (SELECT DISTINCT route FROM {source}) r,
       (SELECT unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS d
        FROM {source}) t),
filled AS (
  SELECT s.date, s.route, coalesce(flight_count, 0) AS flight_count, coalesce(cancelled_count, 0) AS cancelled_count,
         coalesce(last_value(avg_dep_delay IGNORE NULLS) OVER w, 0) AS avg_dep_delay,
         coalesce(last_value(avg_arr_delay IGNORE NULLS) OVER w, 0) AS avg_arr_delay,
         total_distance, carriers, coalesce(cancel_rate, 0) AS cancel_rate,
         avg_daily_flights, total_flights, avg_distance
  FROM spine s LEFT JOIN {source} d ON s.date = d.date AND s.route = d.route
  JOIN meta m ON s.route = m.route
  WINDOW w AS (PARTITION BY s.route ORDER BY s.date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))"""


ALL_FILLED = DAILY_ALL + "," + gap_filled("daily_all")

PANEL = DAILY_ALL + f""",
top_r AS (
  SELECT route, sum(flight_count) AS n FROM daily_all GROUP BY route ORDER BY n DESC, route LIMIT {N_ROUTES}),
daily AS (SELECT * FROM daily_all WHERE route IN (SELECT route FROM top_r)),""" + gap_filled("daily") + """,
panel AS (SELECT * FROM filled)"""


NOT_REGIONAL = "(" + ", ".join(f"'{c}'" for c in EXCLUDED_CARRIERS) + ")"


def r(expr, name=None):
    """A double column rounded like the Spark side."""
    return f"round(CAST({expr} AS DOUBLE), {DIGITS}) AS {name or expr}"


def rs(*names):
    return ", ".join(r(n) for n in names)


def sql(name, ctes, body):
    ORACLES[name] = f"WITH {ctes.strip()}\n{body.strip()}" if ctes else body.strip()


def delay_metrics(actual="actual", pred="pred"):
    """The seven metric columns over rows where both values are present."""
    e = f"({pred} - {actual})"
    return f"""
  {r(f"avg(abs({e}))", "mae")},
  {r(f"avg(CASE WHEN abs({e}) <= 15 THEN 100.0 ELSE 0 END)", "within_15")},
  {r(f"sqrt(avg({e} * {e}))", "rmse")},
  {r(f"CASE WHEN count(*) FILTER (abs({actual}) > 1) >= 0.5 * count(*) THEN avg(abs({e} / {actual})) FILTER (abs({actual}) > 1) * 100 END", "mape")},
  {r(f"median(abs({e}))", "median_ae")},
  {r(f"avg(CASE WHEN ({actual} > 15) = ({pred} > 15) THEN 100.0 ELSE 0 END)", "threshold_acc")},
  {r(f"CASE WHEN min({actual}) = max({actual}) THEN 0 ELSE 1 - sum({e} * {e}) / (var_pop({actual}) * count(*)) END", "r2")}"""


sql("naive_delay_by_route", PANEL + f""",
p AS (SELECT route, date, avg_arr_delay AS actual, lag(avg_arr_delay) OVER (PARTITION BY route ORDER BY date) AS pred FROM panel)""",
    f"SELECT route, {delay_metrics()} FROM p WHERE date >= DATE '{CUT.test_start}' AND pred IS NOT NULL GROUP BY route")

sql("clean_flights", FLIGHTS, f"""
SELECT route, upper(REPORTING_AIRLINE) AS REPORTING_AIRLINE, count(*) AS n, CAST(sum(CANCELLED) AS BIGINT) AS cancelled,
       {r("sum(ARR_DELAY)", "arr_delay")}, {r("sum(DISTANCE)", "distance")},
       min(FL_DATE) AS first_date, max(FL_DATE) AS last_date
FROM flights GROUP BY 1, 2""")

sql("coalesce_carrier", FLIGHTS, "SELECT REPORTING_AIRLINE, count(*) AS n FROM flights GROUP BY 1")
sql("split_route", FLIGHTS, "SELECT ORIGIN AS airport1, DEST AS airport2, count(*) AS n FROM flights GROUP BY 1, 2")
sql("top_routes", FLIGHTS, f"""
SELECT route, count(*) AS flight_count FROM flights GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {TOP_ROUTES}""")
sql("top_display_routes", PANEL, """
SELECT route, CAST(sum(flight_count) AS BIGINT) AS flight_count FROM panel GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
sql("filter_top_routes", FLIGHTS + f""",
t AS (SELECT route FROM flights GROUP BY route ORDER BY count(*) DESC, route LIMIT {TOP_ROUTES})""", """
SELECT FL_DATE AS date, route, count(*) AS flight_count FROM flights WHERE route IN (FROM t) GROUP BY 1, 2""")
sql("daily_route_agg", DAILY_ALL, f"""
SELECT date, route, flight_count, cancelled_count, {rs("avg_dep_delay", "avg_arr_delay", "total_distance")}, carriers,
       {rs("cancel_rate")} FROM daily_all""")
META = f"""{r("avg(flight_count)", "avg_daily_flights")}, CAST(sum(flight_count) AS BIGINT) AS total_flights,
       {r("avg(total_distance / flight_count)", "avg_distance")}"""
sql("route_metadata", DAILY_ALL, f"SELECT route, {META} FROM daily_all GROUP BY route")
sql("join_route_stats", DAILY_ALL + f""",
m AS (SELECT route, {META} FROM daily_all GROUP BY route)""", """
SELECT date, d.route, flight_count, avg_daily_flights, total_flights, avg_distance
FROM daily_all d JOIN m ON d.route = m.route""")
sql("gap_fill_spine", ALL_FILLED, "SELECT route, date FROM spine")
sql("gap_fill_defaults", ALL_FILLED, f"""
SELECT date, route, flight_count, cancelled_count, {rs("cancel_rate", "total_distance")}, carriers FROM filled""")
sql("route_meta_first", ALL_FILLED, f"""
SELECT date, route, total_flights, {rs("avg_daily_flights", "avg_distance")} FROM filled""")
sql("ffill_limit", ALL_FILLED, f"SELECT date, route, {rs('avg_dep_delay', 'avg_arr_delay')} FROM filled")
sql("panel", PANEL, f"""
SELECT date, route, flight_count, cancelled_count, total_flights, carriers,
       {rs("avg_dep_delay", "avg_arr_delay", "total_distance", "cancel_rate", "avg_daily_flights", "avg_distance")}
FROM panel""")
sql("exclude_regional", FLIGHTS, """
SELECT REPORTING_AIRLINE, count(*) AS n FROM flights
WHERE REPORTING_AIRLINE NOT IN """ + NOT_REGIONAL + " GROUP BY 1")
sql("completed_flights", FLIGHTS, f"""
SELECT route, count(*) AS n, {r("avg(ARR_DELAY)", "avg_delay")} FROM flights
WHERE CANCELLED = 0 AND ARR_DELAY IS NOT NULL GROUP BY 1""")
sql("sort_panel", PANEL, """
SELECT route, date, CAST(date - min(date) OVER (PARTITION BY route) + 1 AS INTEGER) AS position, flight_count FROM panel""")
sql("profile_table", PANEL, """
SELECT 'rows' AS name, CAST(count(*) AS VARCHAR) AS value FROM panel
UNION ALL SELECT 'distinct_keys', CAST(count(DISTINCT route) AS VARCHAR) FROM panel
UNION ALL SELECT 'first_date', CAST(min(date) AS VARCHAR) FROM panel
UNION ALL SELECT 'last_date', CAST(max(date) AS VARCHAR) FROM panel
UNION ALL SELECT 'nulls_route', CAST(count(*) - count(route) AS VARCHAR) FROM panel
UNION ALL SELECT 'nulls_date', CAST(count(*) - count(date) AS VARCHAR) FROM panel
UNION ALL SELECT 'nulls_flight_count', CAST(count(*) - count(flight_count) AS VARCHAR) FROM panel
UNION ALL SELECT 'nulls_avg_arr_delay', CAST(count(*) - count(avg_arr_delay) AS VARCHAR) FROM panel""")
sql("profile_flights", FLIGHTS, """
SELECT 'rows' AS name, CAST(count(*) AS VARCHAR) AS value FROM flights
UNION ALL SELECT 'distinct_keys', CAST(count(DISTINCT route) AS VARCHAR) FROM flights
UNION ALL SELECT 'first_date', CAST(min(FL_DATE) AS VARCHAR) FROM flights
UNION ALL SELECT 'last_date', CAST(max(FL_DATE) AS VARCHAR) FROM flights
UNION ALL """ + "\nUNION ALL ".join(
    f"SELECT 'nulls_{c}', CAST(count(*) - count({c}) AS VARCHAR) FROM flights"
    for c in ("FL_DATE", "ORIGIN", "DEST", "DEP_DELAY", "ARR_DELAY", "CANCELLED", "route")))
sql("sample_head", FLIGHTS, f"""
SELECT FL_DATE, REPORTING_AIRLINE, ORIGIN, DEST, {rs("DEP_DELAY", "ARR_DELAY")}, CANCELLED, {rs("DISTANCE")}, route
FROM flights ORDER BY FL_DATE, REPORTING_AIRLINE, ORIGIN, DEST, DEP_DELAY NULLS FIRST, ARR_DELAY NULLS FIRST, CANCELLED,
  DISTANCE, route LIMIT 1000""")
sql("distinct_routes_period", FLIGHTS, """
SELECT count(DISTINCT route) AS n_routes FROM flights WHERE FL_DATE < DATE '1996-01-01'""")

# ---- weather ----

CONDITION = """CASE WHEN weather_code IS NULL OR weather_code = 0 THEN 'clear' WHEN weather_code IN (1, 2, 3) THEN 'cloudy'
 WHEN weather_code IN (45, 48) THEN 'fog' WHEN weather_code IN (51, 53) THEN 'drizzle'
 WHEN weather_code = 55 THEN 'dense_drizzle' WHEN weather_code IN (56, 57) THEN 'freezing_drizzle'
 WHEN weather_code IN (61, 63) THEN 'rain' WHEN weather_code = 65 THEN 'heavy_rain'
 WHEN weather_code IN (66, 67) THEN 'freezing_rain' WHEN weather_code = 80 THEN 'rain_showers'
 WHEN weather_code IN (81, 82) THEN 'heavy_showers' WHEN weather_code IN (71, 73, 75, 77) THEN 'snow'
 WHEN weather_code IN (85, 86) THEN 'snow_showers' WHEN weather_code IN (95, 96, 99) THEN 'thunderstorm'
 ELSE 'other' END"""
SEVERITY = """CASE WHEN condition = 'clear' THEN 0 WHEN condition = 'cloudy' THEN 1
 WHEN condition IN ('dense_drizzle', 'rain', 'rain_showers') THEN 3
 WHEN condition IN ('heavy_rain', 'heavy_showers', 'freezing_drizzle', 'freezing_rain', 'snow', 'snow_showers') THEN 4
 WHEN condition = 'thunderstorm' THEN 5 ELSE 2 END"""
HOURLY = f"""
hourly0 AS (
  SELECT ts AS datetime,
         CASE event_type WHEN 'click' THEN 'AFR' WHEN 'error' THEN 'AME' WHEN 'purchase' THEN 'ASI'
              WHEN 'signup' THEN 'EUR' WHEN 'view' THEN 'MID' END AS airport,
         50.0::DOUBLE + user_id % 40 AS temp, value / 50 AS precip, value AS wind_speed, value * 1.5 AS wind_gusts,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS weather_code
  FROM events),
hourly1 AS (
  SELECT *, CASE WHEN weather_code BETWEEN 71 AND 77 OR weather_code IN (85, 86) THEN wind_speed / 100 ELSE 0 END AS snowfall,
         {CONDITION} AS condition FROM hourly0),
hourly AS (SELECT *, {SEVERITY} AS severity FROM hourly1)"""
WDAY = HOURLY + f""",
wday0 AS (
  SELECT CAST(datetime AS DATE) AS date, airport, max(temp) AS temp_max, min(temp) AS temp_min, avg(temp) AS temp_avg,
         sum(precip) AS precip_total, sum(CASE WHEN snowfall = 0 THEN precip ELSE 0 END) AS rain,
         sum(snowfall) AS snowfall, max(wind_speed) AS wind_speed_max, max(wind_gusts) AS wind_gusts_max,
         CAST(sum(weather_code) % 100 AS INTEGER) AS weather_code
  FROM hourly GROUP BY 1, 2),
wday1 AS (SELECT *, {CONDITION} AS condition FROM wday0),
wday AS (
  SELECT *, {SEVERITY} AS severity, CAST(precip_total > 0.1 AS INTEGER) AS has_precipitation,
         CAST(snowfall > 0 AS INTEGER) AS has_snow, CAST({SEVERITY} >= 3 AS INTEGER) AS is_adverse,
         temp_max - temp_min AS temp_range FROM wday1),
roll AS (
  SELECT airport, CAST(datetime AS DATE) AS date,
         coalesce(max(wind_speed) FILTER (hour(datetime) BETWEEN 6 AND 23), 0) AS peak_wind_operating,
         coalesce(sum(precip) FILTER (hour(datetime) BETWEEN 6 AND 23), 0) AS precip_operating,
         max(severity) AS max_hourly_severity, count(*) FILTER (severity >= 4) AS storm_hours,
         coalesce(max(severity) FILTER (hour(datetime) BETWEEN 5 AND 10), 0) AS morning_severity,
         coalesce(max(severity) FILTER (hour(datetime) BETWEEN 16 AND 21), 0) AS evening_severity
  FROM hourly GROUP BY 1, 2 HAVING count(*) FILTER (hour(datetime) BETWEEN 6 AND 23) > 0),
weather AS (
  SELECT w.*, coalesce(peak_wind_operating, 0) AS peak_wind_operating, coalesce(precip_operating, 0) AS precip_operating,
         coalesce(max_hourly_severity, 0) AS max_hourly_severity, coalesce(storm_hours, 0) AS storm_hours,
         coalesce(morning_severity, 0) AS morning_severity, coalesce(evening_severity, 0) AS evening_severity
  FROM wday w LEFT JOIN roll USING (airport, date))"""
CALW = WDAY + """,
calw AS (
  SELECT c.date AS cdate, day(c.date) AS dom, w.* EXCLUDE (date)
  FROM (SELECT CAST(unnest(generate_series(min(l_shipdate)::DATE::TIMESTAMP, max(l_shipdate)::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date FROM lineitem) c
  JOIN weather w ON day(c.date) = day(w.date))"""
W_COLS = config.WEATHER_COLUMNS
W_REAL = W_COLS[:8] + ["peak_wind_operating", "precip_operating"]
ROLL = config.HOURLY_ROLLUP_COLUMNS
APT = [f"apt{n}_{c}" for n in (1, 2) for c in W_COLS]
WPANEL = PANEL + "," + CALW + """,
wjoin AS (
  SELECT p.*, """ + ", ".join(f"a{n}.{c} AS apt{n}_{c}" for n in (1, 2) for c in W_COLS) + """
  FROM panel p
  LEFT JOIN calw a1 ON p.date = a1.cdate AND substr(p.route, 1, 3) = a1.airport
  LEFT JOIN calw a2 ON p.date = a2.cdate AND substr(p.route, 5, 3) = a2.airport),
wpanel AS (
  SELECT *, greatest(apt1_severity, apt2_severity) AS weather_severity_max,
         CASE WHEN apt1_severity IS NULL THEN apt2_severity WHEN apt2_severity IS NULL THEN apt1_severity
              ELSE (apt1_severity + apt2_severity) / 2 END AS weather_severity_combined,
         CASE WHEN apt1_is_adverse = 1 OR apt2_is_adverse = 1 THEN 1 ELSE 0 END AS has_adverse_weather,
         coalesce(apt1_precip_total, 0) + coalesce(apt2_precip_total, 0) AS total_precip,
         coalesce(apt1_snowfall, 0) + coalesce(apt2_snowfall, 0) AS total_snowfall,
         greatest(apt1_wind_speed_max, apt2_wind_speed_max) AS max_wind,
         greatest(apt1_peak_wind_operating, apt2_peak_wind_operating) AS peak_wind_operating,
         coalesce(apt1_precip_operating, 0) + coalesce(apt2_precip_operating, 0) AS precip_operating,
         greatest(apt1_max_hourly_severity, apt2_max_hourly_severity) AS max_hourly_severity,
         coalesce(apt1_storm_hours, 0) + coalesce(apt2_storm_hours, 0) AS storm_hours,
         greatest(apt1_morning_severity, apt2_morning_severity) AS morning_severity,
         greatest(apt1_evening_severity, apt2_evening_severity) AS evening_severity
  FROM wjoin)"""


def cols(names, real):
    """Columns by name, the real-valued ones rounded."""
    return ", ".join(r(c) if c in real else c for c in names)


sql("weather_condition", HOURLY, "SELECT weather_code, condition, count(*) AS n FROM hourly GROUP BY 1, 2")
sql("condition_severity", HOURLY, "SELECT condition, severity, count(*) AS n FROM hourly GROUP BY 1, 2")
sql("severity_label", HOURLY, """
SELECT severity, ['Clear', 'Partly Cloudy', 'Fog/Drizzle', 'Rain', 'Snow', 'Thunderstorm'][severity + 1] AS label,
       count(*) AS n FROM hourly GROUP BY 1, 2""")
sql("weather_flags", WDAY, f"""
SELECT date, airport, condition, severity, has_precipitation, has_snow, is_adverse,
       {rs("temp_range", "precip_total", "rain", "snowfall")} FROM wday""")
sql("hourly_to_daily", WDAY, f"SELECT airport, date, {cols(ROLL, W_REAL)} FROM roll")
sql("merge_hourly_into_daily", WDAY, f"""
SELECT w.date, w.airport, w.severity, {", ".join(r(f"coalesce(x.{c}, 0)", c) if c in W_REAL else f"coalesce(x.{c}, 0) AS {c}" for c in ROLL)}
FROM wday w LEFT JOIN (SELECT * FROM roll WHERE day(date) <> 7) x ON w.airport = x.airport AND w.date = x.date""")
sql("join_weather_two_sided", WPANEL, f"SELECT route, date, {cols(APT, [a for a in APT if a[5:] in W_REAL])} FROM wjoin")
PAIR_REAL = ["weather_severity_combined", "total_precip", "total_snowfall", "max_wind", "peak_wind_operating", "precip_operating"]
sql("weather_pair_features", WPANEL, f"""
SELECT route, date, weather_severity_max, has_adverse_weather, {cols(["weather_severity_combined", "total_precip", "total_snowfall", "max_wind", *ROLL], PAIR_REAL)}
FROM wpanel""")
sql("weather_match_rate", WPANEL, f"SELECT {r('100.0 * count(apt1_severity) / count(*)', 'match_rate')} FROM wpanel")
sql("weather_json_daily", WDAY, f"""
SELECT date, airport, {rs("temp_max", "temp_min", "temp_avg", "precip_total", "rain", "snowfall", "wind_speed_max", "wind_gusts_max")},
       weather_code FROM wday0""")
sql("weather_json_hourly", HOURLY, f"""
SELECT strftime(date_trunc('hour', datetime), '%Y-%m-%d %H:%M:%S') AS datetime, airport,
       {", ".join(r(f"max({c})", c) for c in ("temp", "precip", "snowfall", "wind_speed", "wind_gusts"))},
       max(weather_code) AS weather_code FROM hourly GROUP BY 1, 2""")
sql("missing_keys_resume", FLIGHTS + "," + CALW, "SELECT ORIGIN AS airport, FL_DATE AS date FROM flights EXCEPT SELECT airport, cdate FROM calw")
sql("missing_airports", FLIGHTS + "," + CALW, """
(SELECT ORIGIN AS airport, FL_DATE AS date FROM flights UNION SELECT DEST, FL_DATE FROM flights) EXCEPT SELECT airport, cdate FROM calw""")
sql("land_weather", WDAY, f"SELECT airport, date, {rs('wind_speed_max', 'temp_max')} FROM wday0")
sql("dedup_keep_first", WDAY, f"""
SELECT airport, date, {r("CASE WHEN day(date) <= 15 THEN wind_speed_max ELSE wind_speed_max + 1000 END", "wind_speed_max")},
       {rs("temp_max")} FROM wday0""")
SEVERE = "avg(CASE WHEN severity >= 3 THEN 100.0 ELSE 0 END)"
sql("severe_share_by_month", CALW, f"SELECT CAST(month(cdate) AS INTEGER) AS month, {r(SEVERE, 'severe_pct')} FROM calw GROUP BY 1")
sql("severe_share_by_airport", CALW, f"SELECT airport, {r(SEVERE, 'severe_pct')} FROM calw GROUP BY 1")
sql("severe_share_seasons", CALW + f",\nm AS (SELECT month(cdate) AS month, {SEVERE} AS s FROM calw GROUP BY 1)", f"""
SELECT {r("avg(s)", "all_months")}, {r("avg(s) FILTER (month IN (12, 1, 2))", "winter")},
       {r("avg(s) FILTER (month IN (6, 7, 8))", "summer")} FROM m""")
sql("value_counts_pct", HOURLY, f"""
SELECT condition, count(*) AS count, {r("count(*) * 100.0 / (SELECT count(*) FROM hourly)", "pct")} FROM hourly GROUP BY 1""")

# ---- calendar ----

DAYS = "days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)"
CALENDAR = f"""CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(day(date) AS INTEGER) AS day_of_month,
  CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter, CAST(year(date) AS INTEGER) AS year,
  CAST(week(date) AS INTEGER) AS week_of_year,
  CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, CAST(day(date) <= 3 AS INTEGER) AS is_month_start,
  CAST(day(date) >= 28 AS INTEGER) AS is_month_end,
  sin(2 * pi() * (isodow(date) - 1) / 7) AS day_of_week_sin, cos(2 * pi() * (isodow(date) - 1) / 7) AS day_of_week_cos,
  sin(2 * pi() * (month(date) - 1) / 12) AS month_sin, cos(2 * pi() * (month(date) - 1) / 12) AS month_cos"""
CYCLES = ["day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos"]
CAL_NAMES = ["day_of_week", "day_of_month", "month", "quarter", "year", "week_of_year", "is_weekend", "is_month_start", "is_month_end"]
BREAK = """CAST((month(date) = 12 AND day(date) >= 20) OR (month(date) = 1 AND day(date) <= 5)
  OR (month(date) = 3 AND day(date) BETWEEN 8 AND 24) OR month(date) IN (6, 7, 8)
  OR (month(date) = 11 AND day(date) BETWEEN 20 AND 30) AS INTEGER) AS is_school_break"""
ERAS = f"""CAST(date >= DATE '{CUT.era_start}' AND date < DATE '{CUT.era_peak_end}' AS INTEGER) AS is_covid_period,
  CAST(date >= DATE '{CUT.era_peak_end}' AND date < DATE '{CUT.era_recovery_end}' AS INTEGER) AS is_covid_recovery,
  CAST(date >= DATE '{CUT.era_recovery_end}' AS INTEGER) AS is_post_covid"""
HOLIDAYS = """
alld AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2003-01-31', INTERVAL 1 DAY)) AS DATE) AS date),
actual AS (
  SELECT date FROM alld WHERE (month(date), day(date)) IN ((1, 1), (7, 4), (11, 11), (12, 25))
    OR (isodow(date) = 1 AND month(date) IN (1, 2) AND day(date) BETWEEN 15 AND 21)
    OR (isodow(date) = 1 AND month(date) = 5 AND day(date) >= 25)
    OR (isodow(date) = 1 AND month(date) = 9 AND day(date) <= 7)
    OR (isodow(date) = 1 AND month(date) = 10 AND day(date) BETWEEN 8 AND 14)
    OR (isodow(date) = 4 AND month(date) = 11 AND day(date) BETWEEN 22 AND 28)),
holidays AS (
  SELECT date FROM (SELECT date FROM actual UNION SELECT date - 1 FROM actual WHERE isodow(date) = 6
    UNION SELECT date + 1 FROM actual WHERE isodow(date) = 7) WHERE year(date) BETWEEN 1995 AND 2002)"""


def holiday_days(source):
    return f"""{HOLIDAYS},
hd AS (
  SELECT p.date,
    least(30, coalesce(min(CASE WHEN h.date > p.date THEN h.date - p.date END), 30)) AS days_to_holiday,
    least(30, coalesce(min(CASE WHEN h.date < p.date THEN p.date - h.date END), 30)) AS days_from_holiday,
    max(CASE WHEN h.date = p.date THEN 1 ELSE 0 END) AS is_federal_holiday
  FROM (SELECT DISTINCT date FROM {source}) p, holidays h GROUP BY p.date)"""


HD = PANEL + "," + holiday_days("panel")
sql("calendar_features", DAYS + f",\nc AS (SELECT date, {CALENDAR} FROM days)", f"SELECT date, {', '.join(CAL_NAMES)}, {rs(*CYCLES)} FROM c")
sql("school_break", DAYS, f"SELECT date, {BREAK} FROM days")
HDAYS = DAYS + "," + holiday_days("days")
sql("holiday_asof_next", HDAYS, "SELECT date, CAST(days_to_holiday AS INTEGER) AS days_to_holiday FROM hd")
sql("holiday_asof_prev", HDAYS, "SELECT date, CAST(days_from_holiday AS INTEGER) AS days_from_holiday FROM hd")
sql("holiday_semi_flag", HDAYS, "SELECT date, is_federal_holiday FROM hd")
WEEK = "CASE WHEN days_to_holiday <= 3 OR days_from_holiday <= 3 THEN 1 ELSE 0 END AS is_holiday_week"
sql("holiday_week", HDAYS, f"SELECT date, {WEEK} FROM hd")
sql("period_flags", DAYS, f"SELECT date, {ERAS} FROM days")
ERA3 = f"""CASE WHEN date < DATE '{CUT.era_start}' THEN 'Pre-COVID' WHEN date < DATE '{CUT.era_peak_end}' THEN 'COVID' ELSE 'Post-COVID' END"""
ERA4 = f"""CASE WHEN date < DATE '{CUT.era_start}' THEN 'Pre-COVID' WHEN date < DATE '{CUT.era_peak_end}' THEN 'COVID'
  WHEN date < DATE '{CUT.era_recovery_end}' THEN 'Recovery' ELSE 'Post-COVID' END"""
DAYTYPE = "CASE WHEN isodow(date) >= 6 THEN 'Weekend' ELSE 'Weekday' END"
SEASON = "['Q1 (Winter)', 'Q2 (Spring)', 'Q3 (Summer)', 'Q4 (Fall)'][quarter(date)]"
sql("era_label", DAYS, f"SELECT date, {ERA3} AS era, {ERA4} AS period FROM days")
sql("segment_columns", DAYS, f"SELECT date, {DAYTYPE} AS day_type, {SEASON} AS season FROM days")

# ---- features ----

LAG_COLS = [f"lag_{k}_arr_delay" for k in (1, 7, 14, 28)]
ROLL_COLS = ["rolling_mean_7_arr_delay", "rolling_mean_14_arr_delay", "rolling_std_7_arr_delay", "rolling_std_14_arr_delay"]
LAG_FEATURES = [*LAG_COLS, *ROLL_COLS, "ewm_7_arr_delay"]


def lagged(source):
    return f"""
lag0 AS (
  SELECT route, date, {", ".join(f"lag(avg_arr_delay, {k}) OVER w AS lag_{k}_arr_delay" for k in (1, 7, 14, 28))},
    {", ".join(f"avg(avg_arr_delay) OVER w{k} AS rolling_mean_{k}_arr_delay, stddev_samp(avg_arr_delay) OVER w{k} AS rolling_std_{k}_arr_delay" for k in (7, 14))}
  FROM {source}
  WINDOW w AS (PARTITION BY route ORDER BY date),
    w7 AS (PARTITION BY route ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
    w14 AS (PARTITION BY route ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)),
ew AS (  -- days further back than 150 weigh less than 1e-18 of the whole
  SELECT a.route, a.date, sum(z.avg_arr_delay * pow(0.75, a.date - z.date - 1)) / sum(pow(0.75, a.date - z.date - 1)) AS ewm_7_arr_delay
  FROM {source} a JOIN {source} z ON a.route = z.route AND z.date BETWEEN a.date - 150 AND a.date - 1
  GROUP BY 1, 2),
lagf AS (SELECT lag0.*, ewm_7_arr_delay FROM lag0 LEFT JOIN ew USING (route, date))"""


LAGS = PANEL + "," + lagged("panel")
sql("lags", LAGS, f"SELECT route, date, {rs(*LAG_COLS)} FROM lagf")
sql("rolling_mean", LAGS, f"SELECT route, date, {rs(*ROLL_COLS[:2])} FROM lagf")
sql("rolling_std", LAGS, f"SELECT route, date, {rs(*ROLL_COLS[2:])} FROM lagf")
sql("ewm", LAGS, f"SELECT route, date, {rs('ewm_7_arr_delay')} FROM lagf")
sql("route_code", PANEL, """
SELECT route, CAST(dense_rank() OVER (ORDER BY route) - 1 AS INTEGER) AS route_encoded, count(*) AS n FROM panel GROUP BY route""")
STATS = f"""
stats AS (
  SELECT route, avg(flight_count) AS route_mean_demand, stddev_samp(flight_count) AS route_std_demand,
         median(flight_count) AS route_median_demand, avg(avg_arr_delay) AS route_delay_mean,
         coalesce(stddev_samp(avg_arr_delay), 0) AS route_delay_std
  FROM panel WHERE date < DATE '{CUT.train_end}' GROUP BY route)"""
STAT_COLS = ["route_mean_demand", "route_std_demand", "route_median_demand", "route_delay_mean", "route_delay_std"]
sql("train_route_stats", PANEL + "," + STATS, f"""
SELECT s.route, {rs(*STAT_COLS)}, (SELECT count(*) FROM panel p WHERE p.route = s.route) AS n FROM stats s""")
sql("train_stats_join", PANEL + "," + STATS, f"""
SELECT p.route, date, flight_count, {rs(*STAT_COLS)} FROM panel p JOIN stats s ON p.route = s.route""")

PAIRED = ["severe_weather_level", "both_clear", "weather_diff", *[f"weather_severity_lag_{k}" for k in config.WEATHER_LAGS]]
ZERO = [c for c in config.WEATHER_FEATURES if "temp" not in c and c not in PAIRED]
IMPUTED = WPANEL + f""",
imp AS (
  SELECT * REPLACE ({", ".join(f"coalesce({c}, 0) AS {c}" for c in ZERO)},
    {", ".join(f"coalesce({c}, (SELECT median({c}) FROM wpanel WHERE date < DATE '{CUT.train_end}'), 50) AS {c}" for c in ("apt1_temp_avg", "apt2_temp_avg"))})
  FROM wpanel),
der AS (
  SELECT *, CAST(weather_severity_max >= 4 AS INTEGER) + CAST(weather_severity_max >= 5 AS INTEGER) AS severe_weather_level,
    CAST(apt1_severity = 0 AND apt2_severity = 0 AS INTEGER) AS both_clear,
    CAST(abs(apt1_severity - apt2_severity) AS INTEGER) AS weather_diff,
    {", ".join(f"coalesce(lag(weather_severity_max, {k}) OVER (PARTITION BY route ORDER BY date), 0) AS weather_severity_lag_{k}" for k in (1, 3, 7))}
  FROM imp)"""
sql("impute_weather", IMPUTED, f"""
SELECT route, date, apt1_severity, weather_severity_max, {rs("apt1_temp_avg", "apt2_temp_avg", "max_wind")} FROM imp""")
sql("weather_derived", IMPUTED, "SELECT route, date, severe_weather_level, both_clear, weather_diff FROM der")
sql("weather_lags", IMPUTED, "SELECT route, date, weather_severity_lag_1, weather_severity_lag_3, weather_severity_lag_7 FROM der")
FILLED_LAGS = f"""
lmed AS (
  SELECT route, {", ".join(f"median({c}) AS m_{c}" for c in LAG_FEATURES)}
  FROM lagf WHERE date < DATE '{CUT.train_end}' GROUP BY route),
lagi AS (
  SELECT f.route, f.date, {", ".join(f"coalesce({c}, m_{c}, 0) AS {c}" for c in LAG_FEATURES)}
  FROM lagf f LEFT JOIN lmed m ON f.route = m.route)"""
sql("impute_lags", LAGS + "," + FILLED_LAGS, f"SELECT route, date, {rs(*LAG_FEATURES)} FROM lagi")

from panelcast.config import SEQUENCE_FEATURES, TABULAR_FEATURES, WEATHER_FEATURES  # noqa: E402

FEATURES = IMPUTED + "," + holiday_days("panel") + "," + lagged("panel") + "," + FILLED_LAGS + "," + STATS + f""",
codes AS (SELECT route, CAST(row_number() OVER (ORDER BY route) - 1 AS INTEGER) AS route_encoded FROM (SELECT DISTINCT route FROM panel)),
feat AS (
  SELECT d.*, {CALENDAR.replace("(date)", "(d.date)")}, {BREAK.replace("(date)", "(d.date)")}, {ERAS.replace("date >=", "d.date >=").replace("date <", "d.date <")},
    CAST(days_to_holiday AS INTEGER) AS days_to_holiday, CAST(days_from_holiday AS INTEGER) AS days_from_holiday,
    is_federal_holiday, {WEEK}, route_encoded, s.* EXCLUDE (route), l.* EXCLUDE (route, date)
  FROM der d JOIN hd ON d.date = hd.date JOIN codes c ON d.route = c.route JOIN stats s ON d.route = s.route
  JOIN lagi l ON d.route = l.route AND d.date = l.date)"""
FEATURE_REAL = [*CYCLES, *STAT_COLS, *LAG_FEATURES, *PAIR_REAL,
                *[f"apt{n}_{c}" for n in (1, 2) for c in ("temp_avg", "precip_total", "snowfall", "wind_speed_max")]]
sql("build_features", FEATURES, f"SELECT route, date, {r('avg_arr_delay')}, {cols(TABULAR_FEATURES, FEATURE_REAL)} FROM feat")
sql("ablation_features", FEATURES, f"""
SELECT route, date, {cols([c for c in TABULAR_FEATURES if c not in WEATHER_FEATURES], FEATURE_REAL)} FROM feat""")
sql("split_by_time", LAGS, f"""
SELECT route, CASE WHEN date < DATE '{CUT.train_end}' THEN 'train' WHEN date < DATE '{CUT.val_end}' THEN 'val' ELSE 'test' END AS split,
       count(*) AS n, min(date) AS first_date, max(date) AS last_date
FROM lagf WHERE lag_28_arr_delay IS NOT NULL GROUP BY 1, 2""")
sql("drop_incomplete", LAGS, f"""
SELECT route, count(*) AS n, min(date) AS first_date FROM lagf
WHERE {" AND ".join(f"{c} IS NOT NULL" for c in LAG_FEATURES)} GROUP BY 1""")

# ---- baselines ----

TRAIN, TEST = f"date < DATE '{CUT.train_end}'", f"date >= DATE '{CUT.test_start}'"
BASE = PANEL + f""",
rm AS (SELECT route, median(avg_arr_delay) AS m FROM panel WHERE {TRAIN} GROUP BY route),
gm AS (SELECT median(avg_arr_delay) AS g FROM panel WHERE {TRAIN}),
raw AS (
  SELECT route, date, avg_arr_delay, lag(avg_arr_delay) OVER w AS naive, lag(avg_arr_delay, 7) OVER w AS seasonal_7,
    {", ".join(f"avg(avg_arr_delay) OVER (PARTITION BY route ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS ma_{k}" for k in (7, 14, 28))}
  FROM panel WINDOW w AS (PARTITION BY route ORDER BY date)),
fb AS (SELECT raw.*, m, g FROM raw LEFT JOIN rm ON raw.route = rm.route, gm)"""
MODEL_NAMES = ["naive", "seasonal_7", "ma_7", "ma_14", "ma_28"]


def fallback(c, name):
    return r(f"coalesce({c}, m, g)", name)


sql("naive_fit", BASE, f"SELECT route, {r('m', 'median')} FROM rm UNION ALL SELECT NULL, {r('g', 'median')} FROM gm")
sql("naive_forecast", BASE, f"SELECT route, date, {r('avg_arr_delay')}, {fallback('naive', 'pred')} FROM fb")
sql("seasonal_naive", BASE, f"SELECT route, date, {r('avg_arr_delay')}, {fallback('seasonal_7', 'pred')} FROM fb")
sql("moving_average", BASE, f"""
SELECT route, date, {r('avg_arr_delay')}, {", ".join(fallback(f"ma_{k}", f"ma_{k}") for k in (7, 14, 28))} FROM fb""")
sql("map_lookup_fill", BASE, f"SELECT route, date, {fallback('seasonal_7', 'pred')}, CAST(seasonal_7 IS NULL AS INTEGER) AS filled FROM fb")


def fold_slice(f):
    test = f"date >= DATE '{f.test_start}' AND date < DATE '{f.test_end}'"
    return f"""
SELECT {f.fold} AS fold, p.route, date, avg_arr_delay AS actual,
  coalesce(lag(avg_arr_delay) OVER (PARTITION BY p.route ORDER BY date), m) AS naive,
  coalesce(avg(avg_arr_delay) OVER (PARTITION BY p.route ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), m) AS ma
FROM panel p JOIN (SELECT route, median(avg_arr_delay) AS m FROM panel WHERE date < DATE '{f.train_end}' GROUP BY route) t
  ON p.route = t.route WHERE {test}"""


def fold_rows(folds):
    return PANEL + ",\nfw AS (" + "\nUNION ALL".join(map(fold_slice, folds)) + """),
folds AS (SELECT fold, route, date, actual, 'naive' AS model, naive AS pred FROM fw
  UNION ALL SELECT fold, route, date, actual, 'ma', ma FROM fw)"""


FOLDS = fold_rows(CUT.folds)
sql("naive_in_split", fold_rows(OVERLAPPING), f"SELECT fold, route, date, {r('actual')}, model, {r('pred')} FROM folds")
SLICE = PANEL + f""",
sl AS (
  SELECT route, date, avg_arr_delay AS actual, lag(avg_arr_delay) OVER (PARTITION BY route ORDER BY date) AS naive,
    avg(avg_arr_delay) OVER (PARTITION BY route ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS ma
  FROM panel WHERE {TEST})"""
sql("naive_no_fallback", SLICE, f"SELECT route, date, {rs('actual', 'naive', 'ma')} FROM sl WHERE naive IS NOT NULL AND ma IS NOT NULL")
sql("baseline_from_features", BASE, f"""
SELECT route, date, {", ".join(f"round_even(round({c}, 9), 1) AS {n}" for c, n in (("avg_arr_delay", "actual"), ("naive", "naive"), ("ma_7", "ma")))}
FROM raw WHERE {TEST}""")

# ---- evaluation ----

PRED = BASE + ",\npred AS (" + "\n  UNION ALL ".join(
    f"SELECT route, date, avg_arr_delay AS actual, '{m}' AS model, {m} AS pred FROM raw WHERE {TEST}" for m in MODEL_NAMES) + ")"
ERR = PRED + f""",
err AS (
  SELECT *, pred - actual AS error, abs(pred - actual) AS abs_error,
    CASE WHEN abs(actual) >= 1 THEN (pred - actual) / actual * 100 END AS pct_error,
    {ERA3} AS time_period, {DAYTYPE} AS day_type, {SEASON} AS season
  FROM pred)"""


def basic_metrics():
    e = "(pred - actual)"
    return f"""{r(f"sqrt(avg({e} * {e}))", "rmse")}, {r(f"avg(abs({e}))", "mae")},
  {r(f"CASE WHEN count(*) FILTER (abs(actual) > 1) >= 0.5 * count(*) THEN avg(abs({e} / actual)) FILTER (abs(actual) > 1) * 100 END", "mape")},
  {r(f"CASE WHEN min(actual) = max(actual) THEN 0 ELSE 1 - sum({e} * {e}) / (var_pop(actual) * count(*)) END", "r2")},
  count(*) AS n_samples"""


sql("error_columns", ERR, f"SELECT route, date, model, {rs('error', 'abs_error', 'pct_error')} FROM err")
sql("metrics_basic", PRED, f"SELECT model, {basic_metrics()} FROM pred GROUP BY model")
sql("metrics_delay", PRED, f"SELECT model, {delay_metrics()} FROM pred GROUP BY model")
sql("metrics_overall", PRED, f"SELECT {delay_metrics()} FROM pred")
sql("metrics_by_segment", ERR, f"SELECT model, time_period, day_type, {basic_metrics()} FROM err GROUP BY 1, 2, 3")
sql("metrics_by_all_segments", ERR, "\nUNION ALL ".join(
    f"SELECT model, '{s}' AS section, {k} AS key, {basic_metrics()} FROM err GROUP BY 1, 2, 3"
    for s, k in (("overall", "'all'"), ("route", "route"), ("time_period", "time_period"), ("day_type", "day_type"), ("season", "season"))))
METRIC_NAMES = ["mae", "within_15", "rmse", "mape", "median_ae", "threshold_acc", "r2"]
PUBLISHED = ", ".join(f"round_even({m}, {3 if m == 'r2' else 1}) AS {m}" for m in METRIC_NAMES)
TENTHS = "round_even(round(actual, 9), 1) AS actual, round_even(round(pred, 9), 1) AS pred"
SHOWN = "shown AS (SELECT route FROM panel GROUP BY route ORDER BY sum(flight_count) DESC, route LIMIT 5)"
MERGED_MODELS = {"naive": "naive", "ma_7": "ma_7", "smooth": "ma_28", "weekly": "seasonal_7"}
sql("forecast_metrics_by_route", BASE + f""",
{SHOWN},
aligned AS (""" + "\n  UNION ALL ".join(
    f"SELECT route, '{m}' AS model, avg_arr_delay AS actual, {c} AS pred FROM raw WHERE {TEST} AND date >= DATE '2000-08-01'" for m, c in MERGED_MODELS.items()) + f"""),
pub AS (SELECT route, model, {TENTHS} FROM aligned),
fm AS (SELECT model, route, {delay_metrics()} FROM pub WHERE route IN (FROM shown) GROUP BY 1, 2
  UNION ALL SELECT model, 'all', {delay_metrics()} FROM pub GROUP BY 1)""", f"SELECT model, route, {PUBLISHED} FROM fm")
sql("metrics_by_route", PRED, f"SELECT model, route, {basic_metrics()} FROM pred GROUP BY 1, 2")
sql("metrics_by_time_period", BASE + f""",
h AS (SELECT {ERA3} AS time_period, avg_arr_delay AS actual, naive AS pred FROM raw WHERE naive IS NOT NULL)""",
    f"SELECT time_period, {basic_metrics()} FROM h GROUP BY 1")
sql("metrics_by_day_type", ERR, f"SELECT model, day_type, {basic_metrics()} FROM err GROUP BY 1, 2")
sql("metrics_by_season", ERR, f"SELECT model, season, {basic_metrics()} FROM err GROUP BY 1, 2")
sql("assign_folds", PANEL + ",\nroles AS (" + "\nUNION ALL ".join(
    f"""SELECT {f.fold} AS fold, route, date, CASE WHEN date < DATE '{f.train_end}' THEN 'train' WHEN date < DATE '{f.val_end}' THEN 'val'
  WHEN date >= DATE '{f.test_start}' AND date < DATE '{f.test_end}' THEN 'test' END AS role FROM panel""" for f in CUT.folds) + ")", """
SELECT fold, role, route, count(*) AS n, min(date) AS first_date, max(date) AS last_date
FROM roles WHERE role IS NOT NULL GROUP BY 1, 2, 3""")
sql("walk_forward_eval", FOLDS, f"SELECT model, fold, {delay_metrics()} FROM folds GROUP BY 1, 2")
FM = FOLDS + """,
fm AS (
  SELECT model, fold, avg(abs(pred - actual)) AS mae, avg(CASE WHEN abs(pred - actual) <= 15 THEN 100.0 ELSE 0 END) AS within_15,
    sqrt(avg((pred - actual) * (pred - actual))) AS rmse, median(abs(pred - actual)) AS median_ae,
    1 - sum((pred - actual) * (pred - actual)) / (var_pop(actual) * count(*)) AS r2
  FROM folds GROUP BY 1, 2)"""
sql("fold_summary", FM, "\nUNION ALL ".join(f"""
SELECT model, '{m}' AS metric, {r(f"avg({m})", "mean")}, {r(f"stddev_pop({m})", "std")},
  {", ".join(r(f"max({m}) FILTER (fold = {i})", f"fold_{i}") for i in (1, 2, 3, 4))} FROM fm GROUP BY model"""
    for m in ("mae", "rmse", "r2", "within_15", "median_ae")))
sql("worst_forecasts", ERR, f"""
SELECT date, route, {rs('actual', 'pred', 'error')} FROM err WHERE model = 'naive' ORDER BY abs_error DESC, route, date LIMIT 10""")
sql("residuals_over_time", ERR + ",\nde AS (SELECT date, avg(error) AS error FROM err WHERE model = 'ma_7' GROUP BY date)", f"""
SELECT date, {r('error')}, {r('avg(error) OVER (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)', 'rolling')} FROM de""")
for name, seg in (("segment_box_stats", "season"), ("segment_box_stats_by_model", "model")):
    sql(name, ERR, f"""
SELECT {seg}, {r('median(abs_error)', 'median_abs_error')}, {r('quantile_cont(error, 0.25)', 'q1')},
  {r('median(error)', 'median_error')}, {r('quantile_cont(error, 0.75)', 'q3')} FROM err GROUP BY 1""")
sql("mae_route_season_pivot", ERR + """,
c AS (SELECT route, quarter(date) AS q, avg(abs_error) AS mae FROM err WHERE model = 'ma_7' GROUP BY 1, 2)""", f"""
SELECT route, {", ".join(r(f"max(mae) FILTER (q = {q})", n) for q, n in ((1, "winter"), (2, "spring"), (3, "summer"), (4, "fall")))},
  {r("avg(mae)", "row_mean")} FROM c GROUP BY route""")
sql("seasonal_stats", ERR + """,
c AS (SELECT route, season, avg(abs_error) AS mae FROM err WHERE model = 'ma_7' GROUP BY 1, 2),
s AS (SELECT season, avg(mae) AS a FROM c GROUP BY 1),
best AS (SELECT season, a FROM s ORDER BY a, season LIMIT 1), worst AS (SELECT season, a FROM s ORDER BY a DESC, season LIMIT 1)""", f"""
SELECT best.season AS best_season, {r('best.a', 'best_season_mae')}, worst.season AS worst_season, {r('worst.a', 'worst_season_mae')},
  c.route AS worst_route, {r('c.mae', 'worst_route_mae')}, {r('worst.a - best.a', 'spread')}
FROM best, worst, c WHERE c.season = worst.season ORDER BY c.mae DESC, c.route LIMIT 1""")
for name, key in (("family_gap", "route"), ("family_gap_by_season", "season")):
    sql(name, ERR + f""",
c AS (SELECT {key}, model, avg(abs_error) AS mae FROM err GROUP BY 1, 2),
g AS (SELECT {key}, avg(mae) FILTER (model LIKE 'ma%') AS a, avg(mae) FILTER (model NOT LIKE 'ma%') AS z FROM c GROUP BY 1)""", f"""
SELECT {key}, {r('a', 'smooth_mae')}, {r('z', 'last_mae')}, {r('z - a', 'gap')} FROM g""")
PAIRS = [("ma_7", "ma_14"), ("ma_7", "ma_28"), ("ma_7", "naive"), ("ma_14", "ma_28"), ("ma_14", "naive"), ("ma_28", "naive"),
         ("ma_7", "seasonal_7"), ("ma_14", "seasonal_7"), ("ma_28", "seasonal_7"), ("naive", "seasonal_7")]
# the tail is integrated with Simpson's rule after substituting the angle: f(t) dt ~ cos(x)^(nu - 1) dx with t = sqrt(nu) tan(x)
sql("paired_t_test", BASE + ",\nd AS (" + "\nUNION ALL ".join(
    f"SELECT '{a}' AS model_1, '{z}' AS model_2, abs({a} - avg_arr_delay) - abs({z} - avg_arr_delay) AS d FROM raw WHERE {TEST}"
    for a, z in PAIRS) + """),
t AS (SELECT model_1, model_2, avg(d) AS mae_diff, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t_stat, count(*) AS n FROM d GROUP BY 1, 2),
p AS (
  SELECT model_1, model_2, greatest(0, 1 - 2 * exp(lgamma(n / 2.0) - lgamma((n - 1) / 2.0)) / sqrt(pi())
     * sum(CASE WHEN k IN (0, 20000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
           * pow(cos(atan(abs(t_stat) / sqrt(n - 1)) * k / 20000.0), n - 2)) * atan(abs(t_stat) / sqrt(n - 1)) / 60000.0) AS p
  FROM t, range(20001) g(k) GROUP BY model_1, model_2, n, t_stat)""", f"""
SELECT t.model_1, t.model_2, {r('mae_diff')}, {r('t_stat')}, n, {r('p', 'p_value')}, CAST(p < 0.05 AS INTEGER) AS significant
FROM t JOIN p ON t.model_1 = p.model_1 AND t.model_2 = p.model_2""")
sql("route_metric_extremes", PRED + ",\nmr AS (SELECT model, route, avg(abs(pred - actual)) AS mae FROM pred GROUP BY 1, 2)", f"""
SELECT model, first(route ORDER BY mae, route) AS best_route, {r('min(mae)', 'best_value')},
  first(route ORDER BY mae DESC, route) AS worst_route, {r('max(mae)', 'worst_value')}, {r('avg(mae)', 'mean_value')} FROM mr GROUP BY 1""")
MM = PRED + """,
mm AS (SELECT model, avg(abs(pred - actual)) AS mae, avg(CASE WHEN abs(pred - actual) <= 15 THEN 100.0 ELSE 0 END) AS hit FROM pred GROUP BY 1)"""
sql("fit_improvement", MM + ",\nn AS (SELECT mae AS nm, hit AS nh FROM mm WHERE model = 'naive')", f"""
SELECT model, {r('mae')}, {r('(nm - mae) / nm * 100', 'mae_reduction_pct')}, {r('hit - nh', 'hit_rate_change')} FROM mm, n WHERE model <> 'naive'""")
sql("loss_argmin", FM, f"""
SELECT model, {r('min(mae)', 'best_loss')}, first(fold ORDER BY mae, fold) AS best_step,
  CAST(min(mae) = (SELECT min(mae) FROM fm) AS INTEGER) AS is_best FROM fm GROUP BY 1""")
sql("leaderboard", MM + """,
ml AS (SELECT * FROM mm WHERE model NOT IN ('naive', 'seasonal_7')),
bm AS (SELECT model FROM (SELECT model, mae, lead(mae) OVER (ORDER BY mae, model) - mae AS gap, row_number() OVER (ORDER BY mae, model) AS k FROM ml) WHERE k = 1 AND gap >= 0.2),
bh AS (SELECT model FROM (SELECT model, hit - lead(hit) OVER (ORDER BY hit DESC, model) AS gap, row_number() OVER (ORDER BY hit DESC, model) AS k FROM ml) WHERE k = 1 AND gap >= 0.5)""", f"""
SELECT model, {r('mae')}, {r('hit', 'within_15')}, CAST(row_number() OVER (ORDER BY mae, model) AS INTEGER) AS mae_rank,
  CAST(row_number() OVER (ORDER BY hit DESC, model) AS INTEGER) AS hit_rank,
  CAST(model IN (FROM bm) AS INTEGER) AS clear_best_mae, CAST(model IN (FROM bh) AS INTEGER) AS clear_best_hit,
  {r("((SELECT mae FROM mm WHERE model = 'naive') - (SELECT min(mae) FROM mm)) / (SELECT mae FROM mm WHERE model = 'naive') * 100", 'improvement_pct')}
FROM mm""")
sql("canonical_model_order", MM, f"""
SELECT model, {r('mae')}, CASE model WHEN 'ma_7' THEN 1 WHEN 'ma_14' THEN 2 WHEN 'naive' THEN 3 ELSE 999 END AS position FROM mm""")

# ---- prediction tables ----

MERGED = BASE + f""",
merged AS (
  SELECT route, date, avg_arr_delay AS actual, naive, ma_7, CASE WHEN date >= DATE '2000-08-01' THEN ma_28 END AS smooth, seasonal_7 AS weekly
  FROM raw WHERE {TEST})"""
sql("merge_predictions", MERGED, f"SELECT route, date, {rs('actual', 'naive', 'ma_7', 'smooth', 'weekly')} FROM merged")
sql("align_predictions", MERGED, f"SELECT route, date, {rs('actual', 'smooth')} FROM merged WHERE smooth IS NOT NULL")
SERIES = BASE + f""",
series AS (
  SELECT route, date, avg_arr_delay AS actual, CASE WHEN {TEST} THEN ma_7 END AS predicted, CAST({TEST} AS INTEGER) AS is_test FROM raw)"""
sql("history_plus_forecast", SERIES, f"SELECT route, date, {rs('actual', 'predicted')}, is_test FROM series")
BRUSH = SERIES + f""",
brush AS (SELECT * FROM series WHERE {TEST} AND date <= least(DATE '{CUT.test_start}' + 180, (SELECT max(date) FROM series)))"""
sql("brush_range", BRUSH, f"SELECT route, date, {rs('actual', 'predicted')}, is_test FROM brush")
sql("brush_y_extent", BRUSH, f"""
SELECT {r("least(0, min(least(coalesce(actual, 0), coalesce(predicted, actual, 0))) * 1.15)", "y_min")},
  {r("max(greatest(coalesce(actual, 0), coalesce(predicted, 0))) * 1.15", "y_max")} FROM brush""")
sql("city_pairs", FLIGHTS, "SELECT DISTINCT least(ORIGIN, DEST) || '-' || greatest(ORIGIN, DEST) AS city_pair FROM flights")
sql("directional_routes", FLIGHTS, """
SELECT DISTINCT least(ORIGIN, DEST) || '-' || greatest(ORIGIN, DEST) AS city_pair,
  least(ORIGIN, DEST) || '-' || greatest(ORIGIN, DEST) AS outbound, greatest(ORIGIN, DEST) || '-' || least(ORIGIN, DEST) AS inbound FROM flights""")
sql("city_pair_hit_rate", PRED + """,
h AS (SELECT route, avg(CASE WHEN abs(pred - actual) <= 15 THEN 100.0 ELSE 0 END) AS hit FROM pred WHERE model = 'ma_28' GROUP BY 1)""", f"""
SELECT least(substr(route, 1, 3), substr(route, 5, 3)) || '-' || greatest(substr(route, 1, 3), substr(route, 5, 3)) AS city_pair,
  {r('avg(hit)', 'hit_rate')} FROM h GROUP BY 1""")

# ---- insights ----

sql("weather_impact_by_severity", IMPUTED, f"""
SELECT weather_severity_max AS severity,
  ['Clear', 'Partly Cloudy', 'Fog/Drizzle', 'Rain', 'Snow', 'Thunderstorm'][weather_severity_max + 1] AS label,
  {r('sum(avg_arr_delay * flight_count) / sum(flight_count)', 'avg_delay')}, CAST(sum(flight_count) AS BIGINT) AS n_flights,
  {r('sum(flight_count) FILTER (avg_arr_delay > 15) / sum(flight_count)', 'high_delay_pct')} FROM imp GROUP BY 1, 2""")
WVARS = {"apt1_temp_avg": "temp", "max_wind": "wind", "total_precip": "precip", "total_snowfall": "snowfall", "weather_severity_max": "severity"}
WCORR = WPANEL + ",\nwc AS (" + "\nUNION ALL ".join(f"""
  SELECT '{n}' AS variable, sum(w * (x - mx) * (y - my)) / (sqrt(sum(w * (x - mx) * (x - mx))) * sqrt(sum(w * (y - my) * (y - my)))) AS correlation
  FROM (SELECT {c} AS x, avg_arr_delay AS y, flight_count AS w, sum({c} * flight_count) OVER () / sum(flight_count) OVER () AS mx,
               sum(avg_arr_delay * flight_count) OVER () / sum(flight_count) OVER () AS my FROM wpanel WHERE {c} IS NOT NULL)"""
    for c, n in WVARS.items()) + ")"
sql("weighted_corr", WCORR, f"SELECT variable, {r('correlation')} FROM wc")
sql("corr_by_abs", WCORR, "SELECT variable, CAST(row_number() OVER (ORDER BY abs(correlation) DESC, variable) AS INTEGER) AS rank FROM wc")
sql("top_carriers", FLIGHTS, f"""
SELECT REPORTING_AIRLINE, count(*) AS flight_count FROM flights WHERE REPORTING_AIRLINE NOT IN {NOT_REGIONAL} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
CARRIERS = FLIGHTS + f""",
topc AS (SELECT REPORTING_AIRLINE AS code FROM flights WHERE REPORTING_AIRLINE NOT IN {NOT_REGIONAL} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10),
cf AS (SELECT * FROM flights JOIN topc ON REPORTING_AIRLINE = code),
cp AS (
  SELECT code, avg(ARR_DELAY) FILTER (CANCELLED = 0) AS avg_delay,
    count(*) FILTER (CANCELLED = 0 AND ARR_DELAY <= 15) / count(ARR_DELAY) FILTER (CANCELLED = 0) AS on_time_pct,
    count(ARR_DELAY) FILTER (CANCELLED = 0) AS n_flights, avg(CANCELLED) AS cancel_rate,
    count(*) FILTER (CANCELLED = 0 AND ARR_DELAY > 30) / count(ARR_DELAY) FILTER (CANCELLED = 0) AS severe_delay_pct
  FROM cf GROUP BY code)"""
sql("carrier_performance", CARRIERS, f"""
SELECT code, n_flights, {rs('avg_delay', 'on_time_pct', 'cancel_rate', 'severe_delay_pct')},
  (SELECT min(FL_DATE) FROM cf) AS date_start, (SELECT max(FL_DATE) FROM cf) AS date_end FROM cp""")
sql("carrier_cancel_join", CARRIERS, f"SELECT code, n_flights, {rs('avg_delay', 'cancel_rate')} FROM cp")
sql("legend_label", FLIGHTS, """
SELECT DISTINCT REPORTING_AIRLINE, REPORTING_AIRLINE || ' Air ,' AS label, REPORTING_AIRLINE AS carrier FROM flights""")
sql("sort_carriers", CARRIERS, f"""
SELECT code, CAST(row_number() OVER (ORDER BY avg_delay, code) AS INTEGER) AS rank, {r('avg_delay')} FROM cp""")
sql("mean_by_key", WPANEL, "\nUNION ALL ".join(
    f"SELECT '{n}' AS dimension, CAST({k} AS VARCHAR) AS key, {r('avg(avg_arr_delay)', 'mean')} FROM wpanel GROUP BY 2"
    for n, k in (("date", "date"), ("day_of_week", "isodow(date) - 1"), ("month", "month(date)"), ("route", "route"),
                 ("severity", "weather_severity_max"), ("period", ERA4))))
sql("mean_by_holiday", HD, f"""
SELECT 'is_federal_holiday' AS dimension, CAST(is_federal_holiday AS VARCHAR) AS key, {r('avg(avg_arr_delay)', 'mean')}
FROM panel JOIN hd ON panel.date = hd.date GROUP BY 2
UNION ALL SELECT 'is_school_break', CAST(is_school_break AS VARCHAR), {r('avg(avg_arr_delay)', 'mean')}
FROM (SELECT avg_arr_delay, {BREAK} FROM panel) GROUP BY 2""")
sql("severity_spine_mean", WPANEL, f"""
SELECT CAST(s AS INTEGER) AS severity, {r('coalesce(m, 0)', 'mean')} FROM range(6) t(s)
LEFT JOIN (SELECT weather_severity_max AS k, avg(avg_arr_delay) AS m FROM wpanel GROUP BY 1) ON s = k""")
sql("era_means", PANEL, f"SELECT {ERA4} AS period, {r('avg(avg_arr_delay)', 'mean')} FROM panel GROUP BY 1")
sql("route_summary_stats", PANEL, f"""
SELECT route, {r('avg(avg_arr_delay)', 'mean')}, {r('stddev_samp(avg_arr_delay)', 'std')}, {r('min(avg_arr_delay)', 'min')},
  {r('max(avg_arr_delay)', 'max')} FROM panel GROUP BY 1""")
sql("snow_days", WPANEL, f"SELECT route, date, {rs('total_snowfall', 'avg_arr_delay')} FROM wpanel WHERE total_snowfall > 0")
DSERIES = PANEL + ",\nds AS (SELECT date, avg(avg_arr_delay) AS avg_arr_delay FROM panel GROUP BY 1)"
sql("daily_mean_rolling30", DSERIES, f"""
SELECT date, {r('avg_arr_delay')}, {r('avg(avg_arr_delay) OVER (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)', 'rolling_30')} FROM ds""")


def correlations(source, names):
    return "\nUNION ALL ".join(f"SELECT '{a}' AS a, '{z}' AS b, {r(f'corr({a}, {z})', 'corr')} FROM {source}" for a in names for z in names)


MATRIX = ["avg_arr_delay", "avg_dep_delay", "flight_count", "cancel_rate", "weather_severity_max", "total_precip", "total_snowfall", "max_wind"]
sql("corr_matrix", WPANEL, correlations("wpanel", MATRIX))
sql("target_correlations", WPANEL, "\nUNION ALL ".join(
    f"SELECT '{c}' AS variable, {r(f'corr(avg_arr_delay, {c})', 'corr')} FROM wpanel" for c in MATRIX[1:]))
sql("lag_correlations", LAGS + ",\nj AS (SELECT lagf.*, avg_arr_delay FROM lagf JOIN panel USING (route, date))",
    correlations("j", ["avg_arr_delay", *LAG_COLS]))
sql("histogram", PANEL + """,
e AS (SELECT min(avg_arr_delay) AS lo, max(avg_arr_delay) AS hi FROM panel),
hb AS (SELECT least(49, floor((avg_arr_delay - lo) / ((hi - lo) / 50))) AS bin, count(*) AS n FROM panel, e GROUP BY 1)""", f"""
SELECT CAST(k AS INTEGER) AS bin, {r('lo + k * (hi - lo) / 50', 'lower')}, {r('lo + (k + 1) * (hi - lo) / 50', 'upper')},
  coalesce(n, 0) AS count FROM range(50) t(k) CROSS JOIN e LEFT JOIN hb ON hb.bin = k""")
sql("autocorrelation", DSERIES + """,
c AS (SELECT date, avg_arr_delay - (SELECT avg(avg_arr_delay) FROM ds) AS v FROM ds)""", f"""
SELECT CAST(k AS INTEGER) AS lag, {r('sum(a.v * z.v) / (SELECT sum(v * v) FROM c)', 'acf')}
FROM range(61) t(k) JOIN c a ON true JOIN c z ON z.date = a.date + CAST(k AS INTEGER) GROUP BY 1""")
ORACLES["partial_autocorrelation"] = f"""WITH RECURSIVE {DSERIES.strip()},
c AS (SELECT date, avg_arr_delay - (SELECT avg(avg_arr_delay) FROM ds) AS v FROM ds),
ac AS (
  SELECT z.date - a.date AS lag, sum(a.v * z.v) / (SELECT sum(v * v) FROM c) AS acf
  FROM c a JOIN c z ON z.date BETWEEN a.date AND a.date + 60 GROUP BY 1),
rl AS (SELECT list(acf ORDER BY lag) AS r FROM ac),
rec AS (
  SELECT 1 AS k, [r[2]] AS phi FROM rl
  UNION ALL
  SELECT k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - a * phi[k + 1 - j]), a)
  FROM (SELECT k, phi, (r[k + 2] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j])))
                       / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j + 1]))) AS a
        FROM rec, rl WHERE k < 60))
SELECT 'all' AS series, CAST(k AS INTEGER) AS lag, {r('phi[k]', 'pacf')} FROM rec
UNION ALL SELECT 'all', 0, 1.0"""
sql("autocorrelation_by_route", PANEL + """,
c AS (SELECT route, date, avg_arr_delay - avg(avg_arr_delay) OVER (PARTITION BY route) AS v FROM panel),
pw AS (SELECT route, sum(v * v) AS p FROM c GROUP BY 1)""", f"""
SELECT a.route, CAST(z.date - a.date AS INTEGER) AS lag, {r('sum(a.v * z.v) / max(p)', 'acf')}
FROM c a JOIN c z ON z.route = a.route AND z.date BETWEEN a.date AND a.date + 60 JOIN pw ON pw.route = a.route GROUP BY 1, 2""")
IMP_COLS = [(g, c) for g, v in (*CATEGORIES.items(), ("other", ["flight_count"])) for c in v]
IMPORTANCE = FEATURES + ",\ncorrs AS (SELECT " + ", ".join(
    f"corr({c}, avg_arr_delay) FILTER ({w}) AS {m}_{c}" for m, w in (("train", f"NOT ({TEST})"), ("test", TEST)) for _, c in IMP_COLS) + """ FROM feat),
im0 AS (SELECT unnest([""" + ", ".join(
    f"{{'model': '{m}', 'feature': '{c}', 'category': '{g}', 'c': {m}_{c}}}" for m in ("train", "test") for g, c in IMP_COLS) + """], recursive := true) FROM corrs),
im AS (SELECT model, feature, feature AS label, category, CASE WHEN c IS NULL OR isnan(c) THEN 0 ELSE abs(c) END AS importance FROM im0),
sh AS (SELECT *, round(importance / sum(importance) OVER (PARTITION BY model), 12) AS share FROM im),
rk AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY share DESC, feature) AS rank FROM sh)"""
sql("importance_share", IMPORTANCE, f"SELECT model, feature, {r('share')}, CAST(rank AS INTEGER) AS rank, count(*) OVER (PARTITION BY model) AS n_features FROM rk")
sql("feature_rank", IMPORTANCE, f"SELECT model, feature, {r('share')}, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 15")
sql("importance_category_join", IMPORTANCE, f"SELECT model, feature, {r('importance')}, label, category FROM im")
sql("importance_by_category", IMPORTANCE, f"""
SELECT model, category, {r('sum(share)', 'total')}, count(*) AS n_features, first(feature ORDER BY rank) AS top_feature,
  {r('max(share)', 'max_share')}, CAST(row_number() OVER (PARTITION BY model ORDER BY sum(share) DESC, category) AS INTEGER) AS category_rank
FROM rk GROUP BY 1, 2""")

# ---- scaling and sequences ----

SEQ_COLS = SEQUENCE_FEATURES
SCALED = FEATURES + f""",
sc AS (SELECT {", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in SEQ_COLS)} FROM feat WHERE {TRAIN})"""
sql("standard_scaler", SCALED, f"""
SELECT route, date, {", ".join(r(f"({c} - m_{c}) / s_{c}", c) for c in SEQ_COLS)}, {r('avg_arr_delay', 'back')} FROM feat, sc""")
IN_TEST = f"date >= DATE '{CUT.test_start}' AND date < DATE '{CUT.test_end}'"
CELLS = ", ".join(r(f"h.{c}", f"x_{c}") for c in SEQ_COLS)
STEP = f"CAST(27 - (t.date - h.date - 1) AS INTEGER) AS step, {r('t.avg_arr_delay', 'target')}, {CELLS}"
sql("sequence_windows", FEATURES, f"""
SELECT t.route, t.date, {STEP}
FROM feat t JOIN feat h ON t.route = h.route AND h.date BETWEEN t.date - 28 AND t.date - 1 WHERE t.{IN_TEST.replace("AND date", "AND t.date")}""")
sql("sequence_windows_in_split", FEATURES + f",\ns AS (SELECT * FROM feat WHERE {IN_TEST})", f"""
SELECT t.route, t.date, {STEP}
FROM s t JOIN s h ON t.route = h.route AND h.date BETWEEN t.date - 28 AND t.date - 1
WHERE t.date >= (SELECT min(date) FROM s) + 28""")

# ---- files in and out ----

sql("scan_flights_csv", FLIGHTS, f"""
SELECT route, upper(REPORTING_AIRLINE) AS REPORTING_AIRLINE, count(*) AS n, CAST(sum(CANCELLED) AS BIGINT) AS cancelled,
  {r('sum(ARR_DELAY)', 'arr_delay')} FROM flights GROUP BY 1, 2""")
sql("scan_all_columns", FLIGHTS, f"""
SELECT 'N1' AS TAIL_NUM, CAST(FL_DATE < DATE '1998-01-01' AS INTEGER) AS early, CAST(FL_DATE AS VARCHAR) AS FL_DATE, DEST, count(*) AS n,
  count(*) FILTER (FL_DATE < DATE '1998-01-01') AS n_reporting, count(ARR_DELAY) AS n_arrived, {r("sum(DEP_DELAY)", "dep_delay")}, {r("sum(DISTANCE)", "distance")}
FROM flights GROUP BY 2, 3, 4""")
sql("union_files", FLIGHTS, """
SELECT route, count(*) AS n, count(*) FILTER (FL_DATE >= DATE '1998-01-01' AND DISTANCE IS NOT NULL) AS n_distance FROM flights GROUP BY 1""")
ORACLES["scan_weather"] = ORACLES["weather_json_daily"]
sql("scan_features", LAGS, f"SELECT route, date, {rs('lag_7_arr_delay', 'ewm_7_arr_delay')} FROM lagf")
sql("sink_panel", PANEL, f"""
SELECT route, count(*) AS n, count(*) AS n_csv, CAST(sum(flight_count) AS BIGINT) AS flights, {r('avg(avg_arr_delay)', 'delay')}
FROM panel GROUP BY 1""")
NESTED = ", ".join(f"CASE WHEN {TEST} THEN round_even(round({m}, 9), 1) END AS {m}" for m in MODEL_NAMES)
sql("sink_nested_forecast", BASE + ",\n" + SHOWN, f"""
SELECT route, CAST(date AS VARCHAR) AS date, round_even(round(avg_arr_delay, 9), 1) AS actual, {NESTED},
  CASE WHEN {TEST} THEN 'forecast' ELSE 'history' END AS part FROM raw WHERE route IN (FROM shown)""")
SECTIONS = PRED + ",\n" + SHOWN + ",\n" + fold_rows(CUT.folds)[len(PANEL) + 2:] + f""",
pub AS (SELECT route, model, {TENTHS} FROM pred),
fm AS (SELECT model, route AS key, {delay_metrics()} FROM pub WHERE route IN (FROM shown) GROUP BY 1, 2
  UNION ALL SELECT model, 'all', {delay_metrics()} FROM pub GROUP BY 1
  UNION ALL SELECT model, CAST(fold AS VARCHAR), {delay_metrics()} FROM folds GROUP BY 1, 2)"""
sql("sink_forecast_sections", SECTIONS, f"SELECT model, key, {PUBLISHED} FROM fm")
sql("forecast_metadata", PANEL, f"""
SELECT 'avg_arrival_delay' AS target, 'daily_route_level' AS granularity, 'minutes' AS unit, '{CUT.test_start}' AS test_start,
  '{CUT.test_end}' AS test_end, CAST(min(date) AS VARCHAR) AS train_start, '{CUT.train_end}' AS train_end,
  count(DISTINCT route) AS trained_on_routes FROM panel""")
REPORT = ERR + """,
one AS (SELECT * FROM err WHERE model = 'ma_7'),
seg AS (
  SELECT *, sqrt(avg_sq) AS rmse FROM (""" + "\n  UNION ALL ".join(
    f"""SELECT '{s}' AS section, {k} AS key, avg(error * error) AS avg_sq, avg(abs_error) AS mae,
    CASE WHEN count(*) FILTER (abs(actual) > 1) >= 0.5 * count(*) THEN avg(abs(error / actual)) FILTER (abs(actual) > 1) * 100 END AS mape,
    1 - sum(error * error) / (var_pop(actual) * count(*)) AS r2, count(*) AS n_samples FROM one GROUP BY 1, 2"""
    for s, k in (("overall", "'all'"), ("route", "route"), ("day_type", "day_type"), ("season", "season"))) + """)),
w AS (SELECT * FROM one ORDER BY abs_error DESC, route, date LIMIT 10)"""
sql("sink_report", REPORT, "\nUNION ALL ".join(
    f"SELECT section, key, '{m}' AS metric, {r(m, 'value')} FROM seg" + (" WHERE section = 'overall'" if m in ("r2", "n_samples") else "")
    for m in ("rmse", "mae", "mape", "r2", "n_samples")) + "\nUNION ALL " + "\nUNION ALL ".join(
    f"SELECT 'worst', route || ' ' || date, '{m}', {r(m, 'value')} FROM w" for m in ("actual", "pred", "error")))



def weather_corr(c, n):
    return f"""
SELECT '{n}' AS label, sum(w * (x - mx) * (y - my)) / (sqrt(sum(w * (x - mx) * (x - mx))) * sqrt(sum(w * (y - my) * (y - my)))) AS v
FROM (SELECT {c} AS x, avg_arr_delay AS y, flight_count AS w, sum({c} * flight_count) OVER () / sum(flight_count) OVER () AS mx,
             sum(avg_arr_delay * flight_count) OVER () / sum(flight_count) OVER () AS my FROM feat)"""


ALL_CORRS = ", ".join(f"{{'feature': '{c}', 'c': corr({c}, avg_arr_delay)}}" for _, c in IMP_COLS)
ANALYSIS = FEATURES + "," + CARRIERS[len(FLIGHTS) + 1:] + f""",
wi AS (SELECT CAST(weather_severity_max AS VARCHAR) AS label, sum(avg_arr_delay * flight_count) / sum(flight_count) AS avg_delay,
  sum(flight_count) AS n_flights, coalesce(sum(flight_count) FILTER (avg_arr_delay > 15), 0) / sum(flight_count) AS high_delay_pct FROM feat GROUP BY 1),
wk AS ({" UNION ALL ".join(weather_corr(c, n) for c, n in WVARS.items())}),
ac0 AS (SELECT unnest([{ALL_CORRS}], recursive := true) FROM feat),
ac AS (SELECT feature, CASE WHEN c IS NULL OR isnan(c) THEN 0 ELSE abs(c) END AS i FROM ac0),
ash AS (SELECT feature, round(i / sum(i) OVER (), 12) AS share, count(*) OVER () AS n_features FROM ac),
ark AS (SELECT *, row_number() OVER (ORDER BY share DESC, feature) AS rank FROM ash)"""


def cells(name, section, source, label, metrics):
    return [f"SELECT '{name}' AS name, '{section}' AS section, {label} AS label, '{m}' AS metric, {r(c, 'value')} FROM {source}" for m, c in metrics.items()]


sql("sink_analysis", ANALYSIS, "\nUNION ALL ".join([
    *cells("weather_impact", "by_severity", "wi", "label", {m: m for m in ("avg_delay", "n_flights", "high_delay_pct")}),
    *cells("weather_impact", "correlation", "wk", "label", {"correlation": "v"}),
    *cells("carrier_performance", "carriers", "cp", "code", {m: m for m in ("avg_delay", "on_time_pct", "n_flights", "cancel_rate", "severe_delay_pct")}),
    *cells("feature_importance", "features", "ark", "feature", {m: m for m in ("share", "rank", "n_features")})]))

# ---- models ----

sql("score_sequences", BASE, f"SELECT route, date, {r('avg_arr_delay', 'target')}, {r('ma_7', 'pred')} FROM raw WHERE {IN_TEST}")
sql("score_recurrent", PANEL, f"""
SELECT route, date, target, pred FROM (
  SELECT route, date, {r('avg_arr_delay', 'target')},
    {r("tanh(sum(tanh(avg_arr_delay / 100)) OVER (PARTITION BY route ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING))", "pred")},
    row_number() OVER (PARTITION BY route ORDER BY date) AS n FROM panel) WHERE n > 28 AND {IN_TEST}""")
SPLIT = FEATURES + f""",
sp AS (SELECT *, CASE WHEN date < DATE '{CUT.train_end}' THEN 'train' WHEN date < DATE '{CUT.val_end}' THEN 'val'
  WHEN date >= DATE '{CUT.test_start}' THEN 'test' END AS split FROM feat)"""
FEW = [f for f in TABULAR_FEATURES if f in config.CALENDAR_FEATURES + config.ERA_FEATURES]
LAMBDA, ALPHA, LEAST = 2.0, 5.0, 20  # the settings of the query
soft = lambda g: f"(sign({g}) * greatest(abs({g}) - {ALPHA}, 0))"
worth = lambda g, n: f"pow({soft(g)}, 2) / ({n} + {LAMBDA})"
ROOT = SPLIT + f""",
tr AS (SELECT * FROM sp WHERE split = 'train'),
base AS (SELECT avg(avg_arr_delay) AS base, count(*) AS n FROM tr),
long AS (UNPIVOT (SELECT base - avg_arr_delay AS g, {", ".join(f"{f}::DOUBLE AS {f}" for f in FEW)} FROM tr, base) ON {", ".join(FEW)} INTO NAME feature VALUE x),
cells AS (SELECT feature, x, sum(g) AS g, count(*) AS n FROM long GROUP BY ALL),
cuts AS (
  SELECT feature, x, sum(g) OVER w AS gl, sum(n) OVER w AS nl, sum(g) OVER f AS ga, sum(n) OVER f AS na FROM cells
  WINDOW f AS (PARTITION BY feature), w AS (PARTITION BY feature ORDER BY x)),
gains AS (
  SELECT *, {worth("gl", "nl")} + {worth("(ga - gl)", "(na - nl)")} - {worth("ga", "na")} AS gain FROM cuts WHERE nl >= {LEAST} AND na - nl >= {LEAST}),
root AS (SELECT * FROM gains QUALIFY row_number() OVER (PARTITION BY feature ORDER BY round(gain, 6) DESC, x) = 1)"""
sql("fit_gbt", ROOT, f"""
SELECT 'gbt' AS model, f.feature, b.n AS n_train, (SELECT count(*) FROM sp WHERE split = 'val') AS n_val, {r("b.base", "base")}, 1.0::DOUBLE AS total,
  {r("r.gain", "root_gain")}, r.nl AS root_rows, 1 AS beats_mean
FROM base b, (SELECT unnest({TABULAR_FEATURES}) AS feature) f LEFT JOIN root r ON r.feature = f.feature""")
sql("predict_tabular", ROOT, f"""
SELECT route, date, {r("avg_arr_delay", "actual")}, 1 AS scored,
  {r(f"base - 0.5 * CASE WHEN x_value <= x THEN {soft('gl')} / (nl + {LAMBDA}) ELSE {soft('(ga - gl)')} / (na - nl + {LAMBDA}) END", "first_split")}
FROM (SELECT route, date, avg_arr_delay, unnest([{", ".join(f"{{'f': '{f}', 'v': {f}::DOUBLE}}" for f in FEW)}]) AS u FROM sp WHERE split = 'test') t
  JOIN (SELECT *, x AS cut FROM root ORDER BY round(gain, 6) DESC, list_position({FEW}, feature) LIMIT 1) best ON u.f = best.feature, base,
  LATERAL (SELECT u.v AS x_value)""")
sql("walk_forward_gbt", FEATURES, "\nUNION ALL ".join(f"""
SELECT 'gbt' AS model, {f.fold} AS fold, count(*) AS n_scored, 1 AS beats_naive FROM feat
WHERE date >= DATE '{f.test_start}' AND date < DATE '{f.test_end}'""" for f in CUT.folds))
sql("ablation", SPLIT, "\nUNION ALL ".join(f"SELECT '{m}' AS model, count(*) AS n_scored, 1 AS beats_naive FROM sp WHERE split = 'test'" for m in ("all", "ablated")))

sql("fit_seasonal_regression", PANEL, f"""
SELECT route, count(*) FILTER (date >= DATE '{CUT.test_start}') AS n_scored, count(*) FILTER (date < DATE '{CUT.val_end}') AS n_train,
  0.0::DOUBLE AS gradient FROM panel GROUP BY 1""")
sql("price_quantiles", "", "\nUNION ALL ".join(
    f"SELECT l_returnflag, {p}::DOUBLE AS prob, {r(f'quantile_cont(l_extendedprice, {p})', 'quantile')} FROM lineitem GROUP BY 1" for p in (0.05, 0.25, 0.5, 0.75, 0.999)))
