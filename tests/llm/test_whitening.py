"""Whitening against a plain NumPy version over all rows."""

import math

import numpy as np
import pytest

from panelcast.llm import whitening
from panelcast.llm.queries import QUERIES, table


def plain(vectors):
    """id -> (deviation, whitened), n, explained; for distinct ids."""
    kept = {i: v for i, v in vectors.items() if v and all(c is not None and math.isfinite(c) for c in v)}
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for v in kept.values()], dtype=object)
    n, s = len(x), x.sum(0)
    deviation = [int(d) for d in ((n * x - s) ** 2).sum(1)]
    centred = ((n * x - s) / n).astype(float)
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    order = [k for k in np.argsort(-values)[:8] if values[k] > 1e-12 * np.trace(covariance)]
    white = centred @ axes[:, order] / np.sqrt(values[order])
    return dict(zip(kept, zip(deviation, white, strict=True), strict=True)), n, values[order] / np.trace(covariance)


def compare(rows, vectors):
    want, n, explained = plain(vectors)
    by = {}
    for r in rows:
        by.setdefault(r[0], {})[r["component"]] = r
    assert by.keys() == want.keys()
    k = len(explained)
    got = np.array([[by[i][c + 1]["whitened"] for c in range(k)] for i in want])
    white = np.array([w for _, w in want.values()])
    signs = np.sign((got * white).sum(0))
    assert np.abs(got * signs - white).max() < 1e-6
    for i, (deviation, _) in want.items():
        assert sorted(by[i]) == list(range(1, k + 1))
        assert all(r["n"] == n and r["deviation"] == deviation for r in by[i].values())
        assert all(abs(by[i][c + 1]["explained"] - explained[c]) <= 1e-9 for c in range(k))
    assert {r["identity_error"] for r in rows} and max(r["identity_error"] for r in rows) < 1e-8


def test_query_against_numpy(spark, sf_dir):
    vectors = {r.vec_id: r.embedding for r in table(spark, sf_dir, "embeddings").collect()}
    rows = QUERIES["op12_embedding_whitening"](spark, sf_dir)
    assert dict(rows.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double",
    }
    compare(rows.collect(), vectors)


@pytest.fixture
def odd():
    rng = np.random.default_rng(5)
    some = {i: rng.normal(size=3).tolist() for i in range(40)}
    some |= {100 + i: [0.5, -0.25, 0.125] for i in range(60)}  # most rows are one vector
    return some | {200: None, 201: [], 202: [1.0, None, 2.0], 203: [math.nan, 0.0, 0.0], 204: [math.inf, 0.0, 0.0], 205: [1e300, 0.0, 0.0]}


def test_copies_nulls_and_clashing_columns(spark, odd):
    df = spark.createDataFrame([(i, v, 1.5, "s") for i, v in odd.items()], "vec_id long, embedding array<double>, x double, slice string")
    rows = whitening.whitened_components(df, "vec_id", "embedding").collect()
    compare(rows, {i: v for i, v in odd.items() if i != 205})
    assert {r["n"] for r in rows} == {100}


def test_weights_of_one(spark, odd):
    df = spark.createDataFrame(list(odd.items()), "id long, v array<double>")
    rows = whitening.whitened_components(df, "id", "v", weighted=False).collect()
    assert {r["n"] for r in rows} == {41} and {r["id"] for r in rows} == {i for i in odd if i < 200}
    assert max(r["identity_error"] for r in rows) < 1e-8


def test_large_offsets_do_not_cancel(spark):
    rng = np.random.default_rng(1)
    vectors = {i: (4e6 + rng.integers(-3, 4, 4) / 1024).tolist() for i in range(300)}
    df = spark.createDataFrame(list(vectors.items()), "id long, v array<double>")
    compare(whitening.whitened_components(df, "id", "v").collect(), vectors)


def test_empty_equal_null_ids_and_other_widths(spark):
    schema = "id long, v array<double>"
    assert whitening.whitened_components(spark.createDataFrame([], schema), "id", "v").count() == 0
    assert whitening.whitened_components(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema), "id", "v").count() == 0
    df = spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0])], schema)
    rows = whitening.whitened_components(df, "id", "v").collect()
    assert sorted(str(r["id"]) for r in rows) == ["1", "1", "None", "None"] and {r["component"] for r in rows} == {1}
