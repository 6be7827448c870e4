"""Features to walk-forward results."""

from pyspark.sql import DataFrame

from panelcast.config import TARGET
from panelcast.operators import evaluation as oe
from panelcast.operators import folds as fo
from panelcast.operators import forecasting as fc
from panelcast.sources.staging import stage


def walk_forward(features_df: DataFrame, folds, columns=None, params=None, target=TARGET) -> DataFrame:
    """Delay metrics per model and fold: the baselines in one plan and, given feature columns, one boosted fit per fold.

    Pass a staged table. ``evaluation.fold_summary`` turns the result into means and deviations over folds.
    """
    preds = fo.fold_baselines(features_df, folds, target=target)
    if columns:
        boosted = fc.walk_forward_gbt(features_df, columns, folds, params, target)
        preds = preds if boosted is None else preds.unionByName(boosted)
    return oe.delay_metrics(stage(preds, "fold-predictions"), ["model", "fold"])
