"""Boosted trees against a plain version that tries every cut of every node."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import boosting as bo


def plain(x, y, train, val, s):
    """Exhaustive second-order boosting on raw values: base, and per round nested (feature, threshold, gain, left, right) or a leaf value."""
    soft = lambda g: np.sign(g) * max(abs(g) - s.reg_alpha, 0)
    worth = lambda g, h: soft(g) ** 2 / (h + s.reg_lambda)
    base = y[train].mean()
    pred, trees = np.full(len(y), base), []

    def build(rows, g, depth):
        total, n = g[rows].sum(), len(rows)
        value = -s.learning_rate * soft(total) / (n + s.reg_lambda)
        best = None
        for f in range(x.shape[1]) if depth < s.max_depth else []:
            for cut in sorted(set(x[train, f]))[:-1]:
                left = rows[x[rows, f] <= cut]
                if min(len(left), n - len(left)) < max(s.min_child_weight, 1):
                    continue
                gl = g[left].sum()
                gain = worth(gl, len(left)) + worth(total - gl, n - len(left)) - worth(total, n)
                if gain > 1e-9 and (best is None or gain > best[2] + 1e-9):
                    best = (f, cut, gain)
        if best is None:
            return value
        go = x[rows, best[0]] <= best[1]
        return (*best, build(rows[go], g, depth + 1), build(rows[~go], g, depth + 1))

    def follow(tree, row):
        while isinstance(tree, tuple):
            tree = tree[3] if row[tree[0]] <= tree[1] else tree[4]
        return tree

    errors = []
    for _ in range(s.n_estimators):
        tree = build(np.flatnonzero(train), pred - y, 0)
        trees.append(tree)
        pred = pred + [follow(tree, r) for r in x]
        errors.append((((pred - y)[val] ** 2).mean(), np.abs((pred - y)[val]).mean()))
        if len(errors) - 1 - int(np.argmin([e[0] for e in errors])) >= s.early_stopping_rounds:
            break
    best = int(np.argmin([e[0] for e in errors]))
    return base, trees[: best + 1], errors, lambda rows: base + sum(np.array([follow(t, r) for r in rows]) for t in trees[: best + 1])


def nested(model, tree, node=0):
    f = int(tree.feature[node])
    if f < 0:
        return float(tree.value[node])
    return f, float(model.cuts[f][tree.cut[node]]), float(tree.gain[node]), nested(model, tree, 2 * node + 1), nested(model, tree, 2 * node + 2)


def same(a, b):
    if not isinstance(a, tuple) or not isinstance(b, tuple):
        return not isinstance(a, tuple) and not isinstance(b, tuple) and a == pytest.approx(b, abs=1e-9)
    return a[0] == b[0] and a[1:3] == pytest.approx(b[1:3], abs=1e-7) and same(a[3], b[3]) and same(a[4], b[4])


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n = 160
    x = np.column_stack((rng.integers(0, 40, n) / 4, rng.integers(0, 2, n), rng.normal(size=n).round(1)))
    y = 3 * np.sin(x[:, 0]) + 2 * x[:, 1] + 0.3 * rng.normal(size=n)
    split = np.array(["train"] * 100 + ["val"] * 40 + ["test"] * 20)
    df = spark.createDataFrame([(*map(float, r), float(v), str(k)) for r, v, k in zip(x, y, split)], "a double, b double, c double, y double, split string")
    return df, x, y, split


SETTINGS = [
    bo.Settings(n_estimators=6, max_depth=3, subsample=1, colsample_bytree=1, reg_alpha=0.7, reg_lambda=2.5, min_child_weight=4),
    bo.Settings(n_estimators=60, max_depth=2, learning_rate=0.5, subsample=1, colsample_bytree=1, reg_lambda=1e-8, min_child_weight=1, early_stopping_rounds=5),
]


def fits(data, settings):
    df, *_ = data
    return bo.fit_trees(df, ["a", "b", "c"], "y", F.col("split") == "train", F.col("split") == "val", settings)


@pytest.mark.parametrize("block_rows", [250_000, 30])
def test_trees_leaves_and_importances_equal_the_plain_version(data, monkeypatch, block_rows):
    """Once inside a task and once spread over several blocks."""
    monkeypatch.setattr(bo, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(bo, "REBASE", 3)
    df, x, y, split = data
    for s, model in zip(SETTINGS, fits(data, SETTINGS), strict=True):
        base, trees, errors, predict = plain(x, y, split == "train", split == "val", s)
        assert model.base == pytest.approx(base) and len(model.trees) == len(trees) and len(model.history) == len(errors)
        assert all(same(nested(model, t), want) for t, want in zip(model.trees, trees, strict=True))
        assert np.array(model.history) == pytest.approx(np.array(errors))
        got = df.filter("split = 'test'").select("a", "b", "c", model.column().alias("pred")).toPandas()
        assert got.pred.to_numpy() == pytest.approx(predict(got[["a", "b", "c"]].to_numpy()))
        gains = {f: [] for f in range(3)}

        def walk(t):
            if isinstance(t, tuple):
                gains[t[0]].append(t[2])
                walk(t[3]), walk(t[4])

        for t in trees:
            walk(t)
        mean = np.array([np.mean(g) if g else 0 for g in gains.values()])
        assert model.importances == pytest.approx(mean / mean.sum())


def test_sampling_is_seeded_and_alike_in_one_block_and_many(data, monkeypatch):
    s = [bo.Settings(n_estimators=8, max_depth=3, subsample=0.6, colsample_bytree=0.7, seed=k) for k in (1, 1, 2)]
    one, again, other = fits(data, s)
    monkeypatch.setattr(bo, "BLOCK_ROWS", 30)
    spread = fits(data, s[:1])[0]
    trees = lambda m: [nested(m, t) for t in m.trees]
    assert trees(one) == trees(again) and trees(one) != trees(other)
    assert all(same(a, z) for a, z in zip(trees(one), trees(spread), strict=True))


def test_hurdles_end_hopeless_fits(data):
    s = bo.Settings(n_estimators=50, max_depth=1, learning_rate=0.01, early_stopping_rounds=50)
    free, stopped = fits(data, [s, bo.replace(s, hurdles=((10, 0.001),))])
    assert not free.given_up and stopped.given_up and len(stopped.history) == 10


def test_missing_values_empty_tables_and_constant_features(spark):
    df = spark.createDataFrame([(None, 1.0, 5.0, "train"), (1.0, 1.0, 1.0, "train"), (1.0, 1.0, 1.0, "train"), (float("nan"), 1.0, 5.0, "train"), (2.0, 1.0, None, "train")] * 4, "a double, b double, y double, split string")
    s = bo.Settings(n_estimators=30, max_depth=2, learning_rate=0.5, subsample=1, colsample_bytree=1, min_child_weight=1, reg_lambda=0)
    model = bo.fit_trees(df, ["a", "b"], "y", F.lit(True), F.lit(False), [s])[0]
    got = {(r.a is None or r.a != r.a): r.p for r in df.filter("y IS NOT NULL").select("a", model.column().alias("p")).collect()}
    assert len(model.trees) == 30 and got == {True: pytest.approx(5.0, abs=1e-4), False: pytest.approx(1.0, abs=1e-4)}
    empty = bo.fit_trees(df.limit(0), ["a", "b"], "y", F.lit(True), F.lit(False), [s])[0]
    assert empty.trees == [] and df.select(empty.column().alias("p")).first().p == 0.0


def test_levels_go_on_from_the_level_before(monkeypatch):
    """Only finished trees are walked from the root; sums of a level are those of all its rows, added up in their order."""
    rng, n = np.random.default_rng(4), 3000
    bins = rng.integers(0, 9, (5, n)).astype(np.uint8)
    label, code = bins[0] * 0.5 - bins[1] * bins[2] * 0.1 + rng.normal(size=n), rng.integers(0, 3, n).astype(np.uint8)
    block = bo.Block(bins, label, rng.integers(0, 2**60, n), code, (9,) * 5)
    walk, roots, levels = bo.Tree.nodes, [], []
    monkeypatch.setattr(bo.Tree, "nodes", lambda tree, wide, at=None, rows=None: roots.append(at is None) or walk(tree, wide, at, rows))
    sums = bo.Block.histograms

    def checked(block, tree, nodes, features, round_, s):
        got = dict(sums(block, tree, nodes, features, round_, s))
        used = np.flatnonzero((block.code == bo.TRAIN) & (bo.uniform(block.ids, s.seed * 1_000_003 + round_) < s.subsample))
        ends = walk(tree, block.wide, rows=used)
        for f in features:
            want = np.zeros((2, len(nodes), 9))
            for row, end in zip(used, ends, strict=True):
                if end in nodes:
                    want[:, nodes.index(end), block.bins[f, row]] += block.margin[row] - block.label[row], 1
            assert np.array_equal(got[f], want)
        levels.append(len(nodes))
        return iter(got.items())

    monkeypatch.setattr(bo.Block, "histograms", checked)
    found = bo.boost(bo.LocalRows(block), 5, bo.Settings(n_estimators=3, max_depth=4))
    assert max(levels) > 4 and sum(roots) == len(found["history"]) == 3
