"""Windows cut from blocks, and the recurrent network against one step and one unit at a time."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import folds as fo
from panelcast.operators import recurrent as rn

D = date(2020, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    out = [(r, D + timedelta(i), float(rng.normal()), float(i)) for r, n in (("A-B", 90), ("C-D", 8), ("E-F", 5)) for i in range(n)]
    return spark.createDataFrame(out, "route string, date date, avg_arr_delay double, x double")


def network(inputs, hidden, layers, heads, seed=0):
    rng = np.random.default_rng(seed)
    t, size = {}, inputs
    for k in range(layers):
        t |= {f"lstm{k}_input": rng.normal(size=(4 * hidden, size)), f"lstm{k}_hidden": rng.normal(size=(4 * hidden, hidden)), f"lstm{k}_bias": rng.normal(size=(1, 4 * hidden))}
        size = hidden
    for k in range(heads):
        t |= {f"attend{k}_in": rng.normal(size=(3, hidden)), f"attend{k}_in_bias": rng.normal(size=(1, 3)), f"attend{k}_out": rng.normal(size=(1, 3))}
    if heads > 1:
        t |= {"project": rng.normal(size=(hidden, heads * hidden)), "project_bias": rng.normal(size=(1, hidden))}
    return t | {"head_in": rng.normal(size=(6, hidden)), "head_in_bias": rng.normal(size=(1, 6)), "head_out": rng.normal(size=(1, 6)), "head_out_bias": rng.normal(size=(1, 1))}


def step_by_step(t, window, layers, heads):
    squash = lambda v: 1 / (1 + math.exp(-v))
    dot = lambda w, v: sum(a * b for a, b in zip(w, v, strict=True))
    steps = [list(map(float, row)) for row in window]
    for k in range(layers):
        size = t[f"lstm{k}_hidden"].shape[1]
        h, c, out = [0.0] * size, [0.0] * size, []
        for x in steps:
            z = [dot(t[f"lstm{k}_input"][j], x) + dot(t[f"lstm{k}_hidden"][j], h) + t[f"lstm{k}_bias"][0][j] for j in range(4 * size)]
            c = [squash(z[size + j]) * c[j] + squash(z[j]) * math.tanh(z[2 * size + j]) for j in range(size)]
            h = [squash(z[3 * size + j]) * math.tanh(c[j]) for j in range(size)]
            out.append(h)
        steps = out
    contexts = []
    for k in range(heads):
        scores = [dot(t[f"attend{k}_out"][0], [math.tanh(dot(w, h) + b) for w, b in zip(t[f"attend{k}_in"], t[f"attend{k}_in_bias"][0])]) for h in steps]
        total = sum(map(math.exp, scores))
        contexts += [sum(math.exp(s) / total * h[j] for s, h in zip(scores, steps)) for j in range(len(steps[0]))]
    context = contexts or steps[-1]
    if heads > 1:
        context = [dot(w, context) + b for w, b in zip(t["project"], t["project_bias"][0])]
    inner = [max(0.0, dot(w, context) + b) for w, b in zip(t["head_in"], t["head_in_bias"][0])]
    return dot(t["head_out"][0], inner) + t["head_out_bias"][0][0]


@pytest.mark.parametrize("layers, heads", [(1, 0), (2, 1), (2, 3)])
def test_forward_pass_equals_step_by_step(layers, heads):
    t = network(3, 4, layers, heads)
    x = np.random.default_rng(5).normal(size=(7, 6, 3))
    assert rn.Network(t).predict(x) == pytest.approx([step_by_step(t, w, layers, heads) for w in x])


@pytest.mark.parametrize("block", [7, 16, 200])
def test_blocks_give_the_windows_of_every_row(rows, block):
    blocks = fo.sequence_blocks(rows, ["avg_arr_delay", "x"], length=5, block=block, start="2020-01-04", end="2020-03-01")
    got = {(r.route, r.date): r for r in fo.cut_windows(blocks, 5).collect()}
    series = {}
    for r in rows.collect():
        series.setdefault(r.route, {})[r.date] = (r.avg_arr_delay, r.x)
    want = {(route, d) for route, s in series.items() for d in s if (d - D).days >= 5 and d < date(2020, 3, 1)}
    assert set(got) == want
    for (route, d), r in got.items():
        assert [tuple(v) for v in r.x] == [series[route][d - timedelta(5 - i)] for i in range(5)] and r.target == series[route][d][0]
    held = blocks.select(F.sum(F.size("rows"))).first()[0]
    assert held <= len(want) * (1 + 5 / block) + 3 * 2 * 12


def test_scored_blocks_equal_scored_windows_and_weights_come_back(spark, rows):
    net = rn.Network(network(2, 4, 2, 1))
    back = rn.Network.from_table(net.to_table(spark))
    blocks = fo.sequence_blocks(rows, ["avg_arr_delay", "x"], length=5, block=16)
    got = {(r.route, r.date): (r.target, r.pred) for r in rn.score_blocks(blocks, back, 5).collect()}
    windows = fo.cut_windows(blocks, 5).collect()
    assert len(got) == len(windows) == 85 + 3
    for w in windows:
        target, pred = got[w.route, w.date]
        assert target == w.target and pred == pytest.approx(net.predict(np.array([w.x]))[0])


def test_nulls_short_routes_and_empty_tables(spark, rows):
    assert rn.score_blocks(fo.sequence_blocks(rows.limit(0), ["x"], length=5), rn.Network(network(1, 2, 1, 0)), 5).count() == 0
    holes = rows.withColumn("x", F.when(F.col("x") != 3, F.col("x")))
    got = rn.score_blocks(fo.sequence_blocks(holes, ["x"], length=5), rn.Network(network(1, 2, 1, 0)), 5).filter("route = 'C-D'").orderBy("date").collect()
    assert [r.pred is None for r in got] == [True, True, True]
    with pytest.raises(ValueError):
        fo.sequence_blocks(rows, ["x"], length=30, block=10)
