"""Display names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelcast.functions.weather import literal_map

# Display names of carriers by code, and aliases of full names.
CARRIER_NAMES = {
    "AA": "American Airlines", "DL": "Delta Air Lines", "UA": "United Airlines", "WN": "Southwest Airlines",
    "B6": "JetBlue Airways", "AS": "Alaska Airlines", "NK": "Spirit Airlines", "F9": "Frontier Airlines",
    "G4": "Allegiant Air", "HA": "Hawaiian Airlines",
}
CARRIER_ALIASES = {"ExpressJet Airlines LLC d/b/a aha!": "ExpressJet (aha!)"}
# Corporate suffixes dropped from legends.
SUFFIXES = r"(?i)\b(inc\.?|co\.?|corp\.?|corporation|l\.?l\.?c\.?)\b"


def carrier_name(code) -> Column:
    """Display name of a carrier code; an unknown code stands for itself."""
    return F.coalesce(literal_map(CARRIER_NAMES)[F.col(code)], F.col(code))


def legend_label(name) -> Column:
    """Name without corporate suffixes, trailing punctuation and repeated spaces."""
    known = F.coalesce(literal_map(CARRIER_ALIASES)[F.col(name)], F.col(name))
    bare = F.regexp_replace(known, SUFFIXES, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[.,]+$", ""), r"\s{2,}", " "))
