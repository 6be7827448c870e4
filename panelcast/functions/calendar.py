"""Calendar, holiday and era columns."""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.weather import flag, literal_map

HOLIDAY_CAP = 30

# Season labels by quarter.
SEASONS = {1: "Q1 (Winter)", 2: "Q2 (Spring)", 3: "Q3 (Summer)", 4: "Q4 (Fall)"}


def day(value) -> Column:
    return F.lit(value).cast("date") if isinstance(value, str) else value


def calendar_columns(date="date") -> dict:
    """The thirteen plain calendar columns, keyed by name. Monday is day 0."""
    d = F.col(date)
    dow, dom, month = F.weekday(d), F.dayofmonth(d), F.month(d)
    turn = 2 * math.pi
    return {
        "day_of_week": dow,
        "day_of_month": dom,
        "month": month,
        "quarter": F.quarter(d),
        "year": F.year(d),
        "week_of_year": F.weekofyear(d),
        "is_weekend": flag(dow >= 5),
        "is_month_start": flag(dom <= 3),
        "is_month_end": flag(dom >= 28),
        "day_of_week_sin": F.sin(F.lit(turn) * dow / 7),
        "day_of_week_cos": F.cos(F.lit(turn) * dow / 7),
        "month_sin": F.sin(F.lit(turn) * (month - 1) / 12),
        "month_cos": F.cos(F.lit(turn) * (month - 1) / 12),
    }


def school_break(date="date") -> Column:
    """1 in the approximate US school breaks: winter, spring, summer and Thanksgiving."""
    md = F.month(date) * 100 + F.dayofmonth(date)
    # First and last month-day of each break.
    ranges = [(1220, 1231), (101, 105), (308, 324), (601, 831), (1120, 1130)]
    hit = F.lit(False)
    for first, last in ranges:
        hit = hit | md.between(first, last)
    return flag(hit)


def era_flags(cut, date="date") -> dict:
    """Half-open era indicators: peak, recovery, after."""
    d = F.col(date)
    a, b, c = day(cut.era_start), day(cut.era_peak_end), day(cut.era_recovery_end)
    return {
        "is_covid_period": flag((d >= a) & (d < b)),
        "is_covid_recovery": flag((d >= b) & (d < c)),
        "is_post_covid": flag(d >= c),
    }


def era_label(cut, date="date", with_recovery=False) -> Column:
    """Era name; the four-way form keeps the recovery apart."""
    d = F.col(date)
    label = F.when(d < day(cut.era_start), "Pre-COVID").when(d < day(cut.era_peak_end), "COVID")
    if with_recovery:
        label = label.when(d < day(cut.era_recovery_end), "Recovery")
    return label.otherwise("Post-COVID")


def day_type(date="date") -> Column:
    return F.when(F.weekday(date) >= 5, "Weekend").otherwise("Weekday")


def season(date="date") -> Column:
    return literal_map(SEASONS)[F.quarter(date)]


def federal_holidays(spark: SparkSession, first_year: int, last_year: int, observed=True) -> DataFrame:
    """US federal holidays (date, name) by rule, about a dozen rows a year.

    With ``observed`` a Saturday holiday also counts on the Friday before and a Sunday one on the Monday after.
    """

    def fixed(month, dom):
        return F.make_date("y", F.lit(month), F.lit(dom))

    def nth(month, weekday, n):
        before = F.date_sub(F.make_date("y", F.lit(month), F.lit(1)), 1)
        return F.date_add(F.next_day(before, weekday), 7 * (n - 1))

    last_may_monday = F.next_day(F.date_sub(F.make_date("y", F.lit(6), F.lit(1)), 8), "MON")
    # Federal holiday rules.
    rules = [
        ("New Year's Day", fixed(1, 1), 1),
        ("Martin Luther King Jr. Day", nth(1, "MON", 3), 1986),
        ("Washington's Birthday", nth(2, "MON", 3), 1),
        ("Memorial Day", last_may_monday, 1),
        ("Juneteenth National Independence Day", fixed(6, 19), 2021),
        ("Independence Day", fixed(7, 4), 1),
        ("Labor Day", nth(9, "MON", 1), 1),
        ("Columbus Day", nth(10, "MON", 2), 1),
        ("Veterans Day", fixed(11, 11), 1),
        ("Thanksgiving", nth(11, "THU", 4), 1),
        ("Christmas Day", fixed(12, 25), 1),
    ]
    entries = F.array(*[F.struct(d.alias("date"), F.lit(n).alias("name"), F.lit(y).alias("since")) for n, d, y in rules])
    # one year more, so that a New Year's Day observed on 31 December is seen
    years = spark.range(first_year, last_year + 2).select(F.col("id").cast("int").alias("y"))
    actual = years.select("y", F.inline(entries)).filter("y >= since").select("date", "name")
    if observed:
        dow = F.weekday("date")
        shifts = F.when(dow == 5, F.array(F.lit(0), F.lit(-1))).when(dow == 6, F.array(F.lit(0), F.lit(1)))
        actual = actual.select(
            "date", "name", F.explode(F.coalesce(shifts, F.array(F.lit(0)))).alias("shift")
        ).select(
            F.date_add("date", F.col("shift")).alias("date"),
            F.when(F.col("shift") == 0, F.col("name")).otherwise(F.concat("name", F.lit(" (observed)"))).alias("name"),
        )
    in_range = actual.filter(F.year("date").between(first_year, last_year))
    return in_range.groupBy("date").agg(F.min("name").alias("name"))


def holiday_distances(holidays: DataFrame, cap=HOLIDAY_CAP) -> DataFrame:
    """One row per date within ``cap`` days of a holiday: days to the next strictly later one, days from the last
    strictly earlier one, and the holiday flag.

    Because distances are capped, every holiday only reaches ``cap`` days each way, so the as-of join is an explode of
    a bounded range and a group-by, with no range join.
    """
    reach = holidays.select(
        "date", F.explode(F.sequence(F.lit(-cap), F.lit(cap))).alias("off")
    ).select(F.date_add("date", F.col("off")).alias("date"), "off")
    near = reach.groupBy("date").agg(
        F.min(F.when(F.col("off") < 0, -F.col("off"))).alias("to_next"),
        F.min(F.when(F.col("off") > 0, F.col("off"))).alias("from_last"),
        F.max(flag(F.col("off") == 0)).alias("is_federal_holiday"),
    )
    return near.select(
        "date",
        "is_federal_holiday",
        F.coalesce("to_next", F.lit(cap)).alias("days_to_holiday"),
        F.coalesce("from_last", F.lit(cap)).alias("days_from_holiday"),
    )
