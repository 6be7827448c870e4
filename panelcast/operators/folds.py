"""Walk-forward folds, scaling and sequence windows."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.config import SEQUENCE_LENGTH, TARGET
from panelcast.functions.calendar import day
from panelcast.functions.stats import exact_median


def _role(fold, date="date"):
    d = F.col(date)
    return (
        F.when(d < day(fold.train_end), "train")
        .when(d < day(fold.val_end), "val")
        .when((d >= day(fold.test_start)) & (d < day(fold.test_end)), "test")
    )


def assign_folds(df: DataFrame, folds) -> DataFrame:
    """One row per fold whose train, validation or test range holds the date. A narrow explode of a few literals."""
    roles = F.array(*[F.struct(F.lit(f.fold).alias("fold"), _role(f).alias("role")) for f in folds])
    return df.select("*", F.inline(F.filter(roles, lambda r: r.role.isNotNull())))


def fold_baselines(panel: DataFrame, folds, window=7, target=TARGET) -> DataFrame:
    """Naive and moving-average predictions of every fold's test slice in one plan: (fold, route, date, actual, model,
    pred).

    Look-back is inside the slice; a slice's first day falls back to the route's median before the fold's training end,
    then to the median of all such rows. Folds are judged on their own, so their slices may overlap: a row is repeated
    for each fold that trains or tests on it.
    """
    d = F.col("date")
    parts = F.array(*[
        F.struct(
            F.lit(f.fold).alias("fold"),
            (d < day(f.train_end)).alias("_train"),
            ((d >= day(f.test_start)) & (d < day(f.test_end))).alias("_test"),
        )
        for f in folds
    ])
    rows = panel.select("route", "date", target, F.inline(F.filter(parts, lambda p: p["_train"] | p["_test"])))
    overall = exact_median(rows.filter("_train"), ["fold"], target).agg(
        F.map_from_entries(F.collect_list(F.struct("fold", "median")))
    ).scalar()
    train_median = F.median(F.when(F.col("_train"), F.col(target))).over(W.partitionBy("route", "fold"))
    tested = rows.withColumn("_median", F.coalesce(train_median, overall[F.col("fold")])).filter("_test")
    w = W.partitionBy("route", "fold").orderBy("date")
    tested = tested.select(
        "fold", "route", "date", F.col(target).alias("actual"),
        F.coalesce(F.lag(target, 1).over(w), "_median").alias("naive"),
        F.coalesce(F.avg(target).over(w.rowsBetween(-window, -1)), "_median").alias("ma"),
    )
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("pred")) for m in ("naive", "ma")])
    return tested.select("fold", "route", "date", "actual", F.inline(pairs)).filter(F.col("pred").isNotNull())


def scaler_stats(train: DataFrame, columns) -> DataFrame:
    """One row per column: mean and population deviation (0 becomes 1), over rows with a value."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"m_{c}").alias("mean"),
            F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")).alias("std"),
        )
        for c in columns
    ])
    return train.agg(*aggs).select(F.inline(rows))


def scale(df: DataFrame, stats: DataFrame, columns) -> DataFrame:
    """Z-scores of the columns; the statistics are one small map, read as a scalar."""
    table = stats.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std"))))).scalar()
    out = df.withColumn("_scaler", table)
    z = lambda c: (F.col(c) - F.col("_scaler")[c]["mean"]) / F.col("_scaler")[c]["std"]
    return out.withColumns({c: z(c) for c in columns}).drop("_scaler")


def inverse_scale(df: DataFrame, stats: DataFrame, feature, columns) -> DataFrame:
    """Predictions of one scaled feature back in its units."""
    one = stats.filter(F.col("feature") == feature)
    mean, std = one.select("mean").scalar(), one.select("std").scalar()
    return df.withColumns({c: F.col(c) * std + mean for c in columns})


#: Rows that a block of a route adds; it also holds the rows before them that their windows reach.
BLOCK = 256


def sequence_blocks(
    df: DataFrame, features, target=TARGET, start=None, end=None, length=SEQUENCE_LENGTH, in_split=False, block=BLOCK
) -> DataFrame:
    """(route, block, rows): runs of consecutive rows with the ``length`` rows before them, from which windows are cut.

    ``rows`` holds (at, date, wanted, target, x) in order; a window belongs to each wanted row, and its features are ``x`` of
    the rows before it. Neighbouring blocks share ``length`` rows, so a row is held 1 + length / block times and not once
    per window. Wanted are rows of [start, end) with enough predecessors, which may lie before ``start`` unless ``in_split``.
    """
    d = F.col("date")
    inside = [d >= day(start)] if start else []
    inside += [d < day(end)] if end else []
    inside = reduce(lambda a, b: a & b, inside, F.lit(True))
    source = df.filter(inside) if in_split else df
    own = F.floor(F.col("at") / block)
    numbered = source.select(
        "route", "date", inside.alias("inside"), F.col(target).alias("target"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"),
        (F.row_number().over(W.partitionBy("route").orderBy("date")) - 1).cast("long").alias("at"),
    )
    blocks = F.when(F.col("at") % block >= block - length, F.array(own, own + 1)).otherwise(F.array(own))
    if length > block:
        raise ValueError("a block is shorter than a window")
    dealt = numbered.withColumn("block", F.explode(blocks))
    wanted = F.col("inside") & (F.col("block") == own) & (F.col("at") >= length)
    row = F.struct("at", "date", wanted.alias("wanted"), "target", "x")
    held = dealt.select("route", "block", row.alias("row")).groupBy("route", "block").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return held.filter(F.exists("rows", lambda r: r["wanted"]))


def cut_windows(blocks: DataFrame, length=SEQUENCE_LENGTH) -> DataFrame:
    """(route, date, target, x): the windows of blocks, each a matrix of ``length`` rows. Consume them, don't store them."""
    held = blocks.select("route", "rows", F.transform("rows", lambda r: r["x"]).alias("xs"))
    before = lambda i: F.when(i >= length, F.slice("xs", i - length + 1, length))
    windows = F.transform("rows", lambda r, i: F.struct(r["date"].alias("date"), r["target"].alias("target"), F.when(r["wanted"], before(i)).alias("x")))
    return held.select("route", F.inline(windows)).filter(F.col("x").isNotNull())


def sequence_windows(
    df: DataFrame, features, target=TARGET, start=None, end=None, length=SEQUENCE_LENGTH, in_split=False
) -> DataFrame:
    """(route, date, target, x): per row of [start, end) the matrix of the ``length`` rows before it, cut from blocks.

    History reaches before ``start`` unless ``in_split``; rows with fewer predecessors are left out.
    """
    return cut_windows(sequence_blocks(df, features, target, start, end, length, in_split, max(BLOCK, length)), length)
