"""WMO weather codes to conditions, severities and flags, as native columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# WMO code groups.
CONDITION_CODES = {
    "clear": [0],
    "cloudy": [1, 2, 3],
    "fog": [45, 48],
    "drizzle": [51, 53],
    "dense_drizzle": [55],
    "freezing_drizzle": [56, 57],
    "rain": [61, 63],
    "heavy_rain": [65],
    "freezing_rain": [66, 67],
    "rain_showers": [80],
    "heavy_showers": [81, 82],
    "snow": [71, 73, 75, 77],
    "snow_showers": [85, 86],
    "thunderstorm": [95, 96, 99],
}

# Severity per condition.
CONDITION_SEVERITY = {
    "clear": 0, "cloudy": 1, "fog": 2, "drizzle": 2, "other": 2,
    "dense_drizzle": 3, "rain": 3, "rain_showers": 3,
    "heavy_rain": 4, "heavy_showers": 4, "freezing_drizzle": 4, "freezing_rain": 4, "snow": 4, "snow_showers": 4,
    "thunderstorm": 5,
}
DEFAULT_SEVERITY = 2

# Labels of the severity report.
SEVERITY_LABELS = {
    0: "Clear", 1: "Partly Cloudy", 2: "Fog/Drizzle", 3: "Rain", 4: "Snow", 5: "Thunderstorm",
}


def literal_map(mapping) -> Column:
    """A small dict as a map literal."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def weather_condition(code) -> Column:
    """Condition name of a WMO code; a missing code is clear, an unlisted one is other."""
    code = F.col(code) if isinstance(code, str) else code
    table = literal_map({c: name for name, codes in CONDITION_CODES.items() for c in codes})
    return F.when(code.isNull(), "clear").otherwise(F.coalesce(table[code.cast("int")], F.lit("other")))


def condition_severity(condition) -> Column:
    """Severity 0 to 5 of a condition name."""
    condition = F.col(condition) if isinstance(condition, str) else condition
    return F.coalesce(literal_map(CONDITION_SEVERITY)[condition], F.lit(DEFAULT_SEVERITY))


def code_severity(code) -> Column:
    """Severity of a WMO code in one lookup."""
    code = F.col(code) if isinstance(code, str) else code
    by_code = {c: CONDITION_SEVERITY[name] for name, codes in CONDITION_CODES.items() for c in codes}
    known = F.coalesce(literal_map(by_code)[code.cast("int")], F.lit(DEFAULT_SEVERITY))
    return F.when(code.isNull(), CONDITION_SEVERITY["clear"]).otherwise(known)


def severity_label(severity, labels=None) -> Column:
    """Display label of a severity; an unlisted one reads ``Level n``."""
    severity = F.col(severity) if isinstance(severity, str) else severity
    level = severity.cast("int")
    return F.coalesce(literal_map(labels or SEVERITY_LABELS)[level], F.concat(F.lit("Level "), level.cast("string")))


def row_max(a, b) -> Column:
    """Larger of two columns, skipping nulls."""
    return F.greatest(F.col(a), F.col(b))


def row_mean(a, b) -> Column:
    """Mean of two columns, skipping nulls."""
    a, b = F.col(a).cast("double"), F.col(b).cast("double")
    return F.coalesce((a + b) / 2, a, b)


def null_safe_sum(a, b) -> Column:
    """Sum of two columns with null as zero."""
    return F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0))


def flag(condition: Column) -> Column:
    """0/1 integer; an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")
