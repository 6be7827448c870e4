"""The catalog's source: one definition per query, and whole jobs behind the registered names."""

import ast
import inspect
from pathlib import Path

from panelcast.catalog import base, queries
from panelcast.operators import forecasting


def test_every_name_is_defined_once():
    tree = ast.parse(Path(queries.__file__).read_text())
    names = [f.name for f in tree.body if isinstance(f, ast.FunctionDef)]
    assert len(names) == len(set(names)), sorted({n for n in names if names.count(n) > 1})


def test_the_search_is_as_long_as_the_default():
    assert queries.TRIALS == inspect.signature(forecasting.tune_gbt).parameters["n_trials"].default == 50


def test_the_panel_holds_every_route(spark, sf_dir):
    routes = base.delays(spark, sf_dir).select("route").distinct().count()
    assert base.panel(spark, sf_dir).select("route").distinct().count() == routes > base.TOP_ROUTES
