"""Exact quantiles of groups of any size, weighted correlation and the t-test tail."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from panelcast.sources.staging import stage


def exact_quantiles(df: DataFrame, keys, value, probs) -> DataFrame:
    """Exact interpolated quantiles per key, as rows (keys, prob, quantile), for groups of any size.

    Distinct values with their counts are dealt into ranges of (keys, value) and stored. The counts of each range, a few
    numbers per key and range, say which range holds a wanted rank; only those ranges are ordered and counted through, so
    no task holds a whole group, and a value that many rows share is one row.
    """
    keys, probs = list(keys), [float(p) for p in probs]
    named = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    rows = df.select(named.alias("k"), F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    counted = rows.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
    dealt = stage(counted.repartitionByRange("k", "v").withColumn("part", F.spark_partition_id()), "quantiles")

    of_key = W.partitionBy("k")
    before = F.sum("inside").over(of_key.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    place = F.col("prob") * (F.col("n") - 1)
    parts = dealt.groupBy("k", "part").agg(F.sum("c").alias("inside")).select(
        "k", "part", "inside", F.coalesce(before, F.lit(0)).alias("before"), F.sum("inside").over(of_key).alias("n")
    )
    parts = parts.select("*", F.explode(F.array(*map(F.lit, probs))).alias("prob"))
    parts = parts.select("*", (F.floor(place) + 1).alias("low"), (F.ceil(place) + 1).alias("high"))
    holds = (F.col("before") < F.col("high")) & (F.col("before") + F.col("inside") >= F.col("low"))
    near = dealt.join(parts.filter(holds), ["k", "part"])
    upto = F.col("before") + F.sum("c").over(W.partitionBy("k", "part", "prob").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    ranked = near.withColumn("upto", upto)
    at = lambda rank: F.max(F.when((F.col("upto") >= F.col(rank)) & (F.col("upto") - F.col("c") < F.col(rank)), F.col("v")))
    picked = ranked.groupBy("k", "prob", "n").agg(at("low").alias("a"), at("high").alias("z"))
    quantile = F.col("a") + (F.col("z") - F.col("a")) * (place - F.floor(place))
    return picked.select(*[F.col(f"k.{c}").alias(c) for c in keys], "prob", quantile.alias("quantile"))


def exact_median(df: DataFrame, keys, value, name="median") -> DataFrame:
    """Exact median per key, for few but possibly huge groups."""
    return exact_quantiles(df, keys, value, [0.5]).select(*keys, F.col("quantile").alias(name))


def weighted_corr(df: DataFrame, columns: dict, target, weight) -> DataFrame:
    """Weighted Pearson correlation of each column with the target, as rows (variable, correlation), over rows where all
    three are present; ``columns`` maps columns to names.

    The weighted means come first, a row of a few numbers; the moments are then sums around them and keep their digits
    far from zero.
    """
    def present(c):
        return F.col(c).isNotNull() & F.col(target).isNotNull() & F.col(weight).isNotNull()

    y, w = F.col(target).cast("double"), F.col(weight).cast("double")
    mean = lambda value, c: F.try_divide(F.sum(F.when(present(c), w * value)), F.sum(F.when(present(c), w)))
    means = df.groupBy().agg(F.struct(*[
        F.struct(mean(F.col(c).cast("double"), c).alias("x"), mean(y, c).alias("y")).alias(n) for c, n in columns.items()
    ])).scalar()
    rows = df.withColumn("_means", means)
    sums = []
    for c, n in columns.items():
        dx, dy = F.col(c).cast("double") - F.col("_means")[n]["x"], y - F.col("_means")[n]["y"]
        total = lambda product, c=c: F.sum(F.when(present(c), w * product))
        var_x, var_y = total(dx * dx), total(dy * dy)
        sums.append(F.when((var_x > 0) & (var_y > 0), total(dx * dy) / (F.sqrt(var_x) * F.sqrt(var_y))).alias(n))
    pairs = F.array(*[F.struct(F.lit(n).alias("variable"), F.col(n).alias("correlation")) for n in columns.values()])
    return rows.agg(*sums).select(F.inline(pairs))


def t_two_sided(t: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t, for the handful of result rows of a test."""
    from pyspark.sql.types import DoubleType

    def tail(ts, dofs):
        import math

        import pandas as pd

        def p_value(t, nu):
            if t != t or nu != nu or nu <= 0:
                return None
            # regularised incomplete beta I_x(nu/2, 1/2) by its continued fraction (Lentz)
            a, b, x = nu / 2.0, 0.5, nu / (nu + t * t)
            if x >= 1.0:
                return 1.0
            if x <= 0.0:
                return 0.0
            flip = x > (a + 1) / (a + b + 2)
            if flip:
                a, b, x = b, a, 1.0 - x
            front = math.exp(
                math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
            ) / a
            c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or 1e-300)
            h = d
            for m in range(1, 500):
                for num in (
                    m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
                ):
                    d = 1.0 / (1.0 + num * d or 1e-300)
                    c = 1.0 + num / c or 1e-300
                    h *= c * d
                if abs(c * d - 1.0) < 1e-15:
                    break
            value = front * h
            return 1.0 - value if flip else value

        return pd.Series([p_value(float(t), float(n)) for t, n in zip(ts, dofs)], dtype="float64")

    return F.pandas_udf(tail, DoubleType())(t.cast("double"), dof.cast("double"))


def stack_long(df: DataFrame, keys, columns, name="name", value="value") -> DataFrame:
    """Wide to long: one row per key and listed column."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    return df.select(*keys, F.inline(pairs))
