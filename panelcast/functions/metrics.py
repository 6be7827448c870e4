"""Forecast error metrics as aggregate expressions.

All expressions but the median are sums, so they combine on the map side and a hot group costs no more than any other.
``e`` is prediction minus actual; rows with a null on either side must be dropped first (``paired``).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.config import DELAY_THRESHOLD

MAPE_MIN_ACTUAL = 1.0
MAPE_MIN_SHARE = 0.5


def paired(df: DataFrame, actual="actual", pred="pred") -> DataFrame:
    return df.dropna(subset=[actual, pred])


def published(column, decimals=1) -> Column:
    """Value rounded half-even for publishing.

    Digits beyond the ninth are dropped first: they depend on the order in which a mean was summed, and would send a
    value on a rounding edge either way.
    """
    return F.bround(F.round(column, 9), decimals)


def _y(actual):
    return F.col(actual)


def _e(actual, pred):
    return F.col(pred) - F.col(actual)


def mae(actual="actual", pred="pred") -> Column:
    return F.avg(F.abs(_e(actual, pred)))


def rmse(actual="actual", pred="pred") -> Column:
    e = _e(actual, pred)
    return F.sqrt(F.avg(e * e))


def mape(actual="actual", pred="pred") -> Column:
    """Percentage error over actuals beyond +-1, null when fewer than half of the rows qualify."""
    far = F.abs(_y(actual)) > MAPE_MIN_ACTUAL
    share = F.avg(F.when(far, 1.0).otherwise(0.0))
    value = F.avg(F.when(far, F.abs(_e(actual, pred) / _y(actual)))) * 100
    return F.when(share >= MAPE_MIN_SHARE, value)


def r2(actual="actual", pred="pred") -> Column:
    """1 - SSE/SST; 0 when the actuals do not vary. This is not ``regr_r2``."""
    e = _e(actual, pred)
    total = F.var_pop(_y(actual)) * F.count(_y(actual))
    constant = F.min(_y(actual)) == F.max(_y(actual))
    return F.when(constant, 0.0).otherwise(1 - F.try_divide(F.sum(e * e), total))


def within(threshold=DELAY_THRESHOLD, actual="actual", pred="pred") -> Column:
    """Hit rate: share of errors up to the threshold, in percent."""
    return F.avg(F.when(F.abs(_e(actual, pred)) <= threshold, 100.0).otherwise(0.0))


def threshold_accuracy(threshold=DELAY_THRESHOLD, actual="actual", pred="pred") -> Column:
    """Share of rows where both or neither of actual and prediction exceed the threshold, in percent."""
    same = (_y(actual) > threshold) == (F.col(pred) > threshold)
    return F.avg(F.when(same, 100.0).otherwise(0.0))


def median_abs_error(actual="actual", pred="pred") -> Column:
    return F.median(F.abs(_e(actual, pred)))


def basic(actual="actual", pred="pred") -> list:
    """rmse, mae, mape, r2 and the number of samples."""
    return [
        rmse(actual, pred).alias("rmse"),
        mae(actual, pred).alias("mae"),
        mape(actual, pred).alias("mape"),
        r2(actual, pred).alias("r2"),
        F.count(_y(actual)).alias("n_samples"),
    ]


def delay(threshold=DELAY_THRESHOLD, actual="actual", pred="pred") -> list:
    """The delay metrics without the median, which needs care on large groups (``evaluation.delay_metrics``)."""
    return [
        mae(actual, pred).alias("mae"),
        within(threshold, actual, pred).alias("within_15"),
        rmse(actual, pred).alias("rmse"),
        mape(actual, pred).alias("mape"),
        threshold_accuracy(threshold, actual, pred).alias("threshold_acc"),
        r2(actual, pred).alias("r2"),
    ]
