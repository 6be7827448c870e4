"""Flight cleaning, filters and time splits."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.config import REGIONAL_CARRIERS
from panelcast.functions.calendar import day

# The date forms, each with its own groups, and an optional time of day behind all of them.
DATE = (
    r"^(?:(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})"  # M/d/yyyy, M/d/yy
    r"|(\d{4})([-/])(\d{1,2})\5(\d{1,2})"  # yyyy-M-d, yyyy/M/d
    r"|(\d{4})(\d{2})(\d{2})"  # yyyyMMdd
    r"|(\d{1,2})([- ])([A-Za-z]{3})\12(\d{4})"  # d-MMM-yyyy, d MMM yyyy
    r"|([A-Za-z]+) (\d{1,2}), (\d{4})"  # MMM d, yyyy, MMMM d, yyyy
    r")(?:[T ]\d{1,2}:\d{2}.*)?$"
)
YEAR_MONTH_DAY = "$3$4$8$14$17|$1$6$9$13$15|$2$7$10$11$16"
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def parse_mixed_date(column):
    """Date of a text in any of the usual forms, with or without a time of day; null and empty texts are null.

    One replacement takes any form apart into year, month and day (groups of the other forms are empty), month names
    are looked up in a literal map, and one cast puts the parts together, so all of it stays in generated code and no
    parser is tried in vain. Two-digit years are 1969 to 2068. Text that is no date raises an error: dropping the row
    would lose it silently.
    """
    text = F.trim(F.col(column).cast("string"))
    parts = F.split(F.regexp_replace(text, DATE, YEAR_MONTH_DAY), "[|]")
    year, month, day_of_month = F.get(parts, 0), F.lower(F.get(parts, 1)), F.get(parts, 2)
    century = F.when(F.length(year) > 2, "").when(year > "68", "19").otherwise("20")
    numbers = F.create_map(*(F.lit(x) for i, name in enumerate(MONTHS) for key in dict.fromkeys((name, name[:3])) for x in (key, str(i + 1))))
    day = F.concat(century, year, F.lit("-"), F.coalesce(F.element_at(numbers, month), month), F.lit("-"), day_of_month).try_cast("date")
    wrong = F.raise_error(F.concat(F.lit("not a date: "), text)).cast("date")
    return F.when(text != "", F.coalesce(day, wrong))


def coalesce_carrier(df: DataFrame) -> DataFrame:
    """One carrier column, filled from the alternative one where a file has only that."""
    have = [c for c in ("REPORTING_AIRLINE", "OP_UNIQUE_CARRIER") if c in df.columns]
    if not have:
        return df.withColumn("REPORTING_AIRLINE", F.lit(None).cast("string"))
    return df.withColumn("REPORTING_AIRLINE", F.coalesce(*have)).drop("OP_UNIQUE_CARRIER")


def _number(column):
    """Number of a text; anything else, NaN included, is null."""
    return F.nullif(F.col(column).try_cast("double"), F.lit(float("nan")))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers as null in every floating column: NaN would poison averages and sort highest."""
    floating = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.nullif(F.col(c), F.lit(float("nan")).cast(dict(df.dtypes)[c])) for c in floating})


def clean_flights(df: DataFrame) -> DataFrame:
    """Typed flight rows: parsed dates, trimmed upper-case codes, bad numbers null, route key; keyless rows dropped."""
    df = coalesce_carrier(df)
    code = lambda c: F.upper(F.trim(F.col(c).cast("string"))).alias(c)
    number = lambda c: _number(c).alias(c)
    parsed = dict(df.dtypes)["FL_DATE"] == "date"
    dated = F.col("FL_DATE").isNotNull() if parsed else F.trim(F.col("FL_DATE").cast("string")) != ""  # a filter on the parsed date would parse twice
    typed = df.filter(dated).dropna(subset=["ORIGIN", "DEST"]).select(
        (F.col("FL_DATE") if parsed else parse_mixed_date("FL_DATE")).alias("FL_DATE"),
        code("REPORTING_AIRLINE"),
        code("ORIGIN"),
        code("DEST"),
        number("DEP_DELAY"),
        number("ARR_DELAY"),
        F.coalesce(_number("CANCELLED").cast("int"), F.lit(0)).alias("CANCELLED"),
        number("DISTANCE"),
    )
    return typed.withColumn("route", F.concat_ws("-", "ORIGIN", "DEST"))


def split_route(df: DataFrame, route="route", origin="airport1", dest="airport2") -> DataFrame:
    parts = F.split(route, "-")
    return df.withColumns({origin: parts[0], dest: parts[1]})


def filter_routes(df: DataFrame, routes: DataFrame, key="route") -> DataFrame:
    """Rows of the given routes."""
    return df.join(routes.select(key), key, "left_semi")


def exclude_regional(df: DataFrame, carrier="REPORTING_AIRLINE", codes=REGIONAL_CARRIERS) -> DataFrame:
    """Rows of known, non-regional carriers."""
    return df.filter(F.col(carrier).isNotNull() & ~F.col(carrier).isin(codes))


def completed_flights(df: DataFrame) -> DataFrame:
    return df.filter((F.col("CANCELLED") == 0) & F.col("ARR_DELAY").isNotNull())


def drop_incomplete(df: DataFrame, columns) -> DataFrame:
    """Rows with a value (neither null nor NaN) in every listed column."""
    return df.dropna(subset=list(columns))


def split_by_time(df: DataFrame, cut, columns=(), date="date") -> DataFrame:
    """Adds ``split``: train before the first cut-off, val up to the second, test from the test start; rows in none,
    or incomplete in ``columns``, are dropped."""
    d = F.col(date)
    label = (
        F.when(d < day(cut.train_end), "train").when(d < day(cut.val_end), "val").when(d >= day(cut.test_start), "test")
    )
    out = df.withColumn("split", label).filter(F.col("split").isNotNull())
    return drop_incomplete(out, columns) if columns else out


def brush_range(df: DataFrame, test_start, span_days=180, date="date", values=("actual", "predicted")) -> DataFrame:
    """Rows of the default chart window: from the test start for ``span_days``, or to the last date if earlier."""
    last = df.groupBy().agg(F.max(date).alias("d")).select(
        F.least(F.date_add(day(test_start), span_days), F.col("d"))
    ).scalar()
    return df.filter((F.col(date) >= day(test_start)) & (F.col(date) <= last))


def y_extent(df: DataFrame, actual="actual", predicted="predicted", pad=1.15, default_top=50.0) -> DataFrame:
    """Vertical chart range: padded extremes of both series, with zero always in view."""
    a, p = F.col(actual), F.col(predicted)
    low = F.min(F.least(F.coalesce(a, F.lit(0.0)), F.coalesce(p, a, F.lit(0.0))))
    high = F.max(F.greatest(F.coalesce(a, F.lit(0.0)), F.coalesce(p, F.lit(0.0))))
    top = F.when(F.coalesce(high, F.lit(0.0)) == 0, F.lit(default_top)).otherwise(high)
    return df.agg(F.least(F.lit(0.0), F.coalesce(low, F.lit(0.0)) * pad).alias("y_min"), (top * pad).alias("y_max"))


def snow_days(df: DataFrame) -> DataFrame:
    return df.filter(F.col("total_snowfall") > 0).select("route", "date", "total_snowfall", "avg_arr_delay")


