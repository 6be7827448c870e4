"""Flight files: CSVs whose headers differ, read by column name."""

import csv
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.config import FLIGHT_COLUMNS


#: A split and the cost of opening a file: beyond any file, so that each file is one split.
_ONE_FILE = str(1 << 44)
#: Files whose first lines are fetched at the same time.
_AT_ONCE = 32


def headers(spark: SparkSession, glob: str) -> dict[str, list[str]]:
    """Files by their first line. Empty files have none; no file is an error.

    The listing holds paths and lengths alone. Each file is then one task with a limit of one row, which stops the reader
    below it after its first buffer (64 KB), so the bytes read depend on the number of files and not on their size. The
    split settings are those of a session of its own; the caller's stay as they are.
    """
    own = spark.newSession()
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        own.conf.set(name, _ONE_FILE)
    try:
        listing = sorted(own.read.format("binaryFile").load(glob).filter("length > 0").select("path").collect())
    except AnalysisException as e:
        raise FileNotFoundError(f"no CSV files match {glob}") from e
    with ThreadPoolExecutor(_AT_ONCE) as pool:
        lines = pool.map(lambda r: own.read.text(r.path).limit(1).collect(), listing)
        groups = {}
        for r, line in zip(listing, lines, strict=True):
            if line:  # a compressed file may turn out empty
                groups.setdefault(line[0].value, []).append(r.path)
    if not groups:
        raise FileNotFoundError(f"no CSV files match {glob}")
    return groups


def scan_all_columns(spark: SparkSession, glob: str) -> DataFrame:
    """Union by name of all CSVs of the glob, every column as text. No file is an error.

    Headers follow CSV rules: quoted names may hold commas. Files of one header are one scan.
    """
    scans = {}
    for header, paths in headers(spark, glob).items():
        names = tuple(n.strip() for n in next(csv.reader([header.lstrip("\ufeff")])))
        scans.setdefault(names, []).extend(paths)
    parts = []
    for columns, files in scans.items():
        schema = T.StructType([T.StructField(n, T.StringType()) for n in columns])
        parts.append(spark.read.schema(schema).option("header", True).csv(files))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def scan_flights_csv(spark: SparkSession, glob: str) -> DataFrame:
    """The required flight columns of all CSVs; a column that no file has is null."""
    df = scan_all_columns(spark, glob)
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in FLIGHT_COLUMNS])


def distinct_route_count(flights: DataFrame) -> DataFrame:
    """Number of directional routes seen; grouping first keeps the distinct count off a single task."""
    return flights.select(F.concat_ws("-", "ORIGIN", "DEST").alias("route")).groupBy("route").agg(
        F.lit(1).alias("one")
    ).agg(F.count("one").alias("n_routes"))


def sample_head(df: DataFrame, n=1000) -> DataFrame:
    """First rows in column order, the same ones on every run."""
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in df.columns]).limit(n)
