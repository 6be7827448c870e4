"""Side-by-side check of registered queries against their SQL: python tests/check_oracles.py SF_DIR [name ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def session(cores=8):
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


SAME_TYPE = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE"}


def type_notes(df, description):
    want = {c[0]: str(c[1]) for c in description}
    return " ".join(f"{n}:{t}/{want[n]}" for n, t in df.dtypes if SAME_TYPE.get(t) != want[n])


def normal(v):
    if isinstance(v, float):
        v = round(v, 5)
        return "0.0" if v == 0 else repr(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def compare(spark, con, name, sf_dir, oracle):
    start = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    if oracle is None:
        return took, len(got), "no sql", []
    start = time.time()
    rel = con.execute(oracle)
    cols, described = [c[0] for c in rel.description], rel.description
    want = rel.fetchall()
    sql_took = time.time() - start
    if sorted(cols) != sorted(df.columns):
        return took, len(got), f"COLUMNS {sorted(set(cols) ^ set(df.columns))}", []
    a, z = rows_of(df.columns, got), rows_of(cols, want)
    if a == z:
        return took, len(got), f"ok (sql {sql_took:.1f}s) {type_notes(df, described)}", []
    diff = [(x, y) for x, y in zip(a, z) if x != y][:3]
    bad = sum(x != y for x, y in zip(a, z))
    return took, len(got), f"MISMATCH {len(a)} vs {len(z)} rows, {bad} differ", [sorted(cols), *diff]


if __name__ == "__main__":
    sf_dir = sys.argv[1]
    spark, con = session(), duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    oracles = entry.oracle_sql()
    failed = []
    for name in sys.argv[2:] or list(entry.queries()):
        try:
            took, n, verdict, detail = compare(spark, con, name, sf_dir, oracles.get(name))
        except Exception as e:  # keep going: the report lists every failure
            took, n, verdict, detail = 0, 0, f"ERROR {str(e)[:600]}", []
        print(f"{name:32s} {took:6.2f}s {n:7d} rows  {verdict}", flush=True)
        for x in detail:
            print("     ", x)
        if not verdict.startswith(("ok", "no sql")):
            failed.append(name)
    print("failed:", failed)
