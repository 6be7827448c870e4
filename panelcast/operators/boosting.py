"""Second-order gradient boosting on histograms, for squared error.

Rows are binned once into a byte per feature and stored in blocks. A level of a tree needs, for each of its nodes, sums of
gradients and rows per feature and bin; these are added up block by block, and what the driver sees is the best split per
node and feature. Splits and leaves use first and second derivatives with L1 and L2 terms:

    T(G) = sign(G) * max(|G| - reg_alpha, 0)      score = T(G)^2 / (H + reg_lambda)      leaf = -T(G) / (H + reg_lambda)

A table of one block is fitted inside a task, so independent fits (folds, trials, ablations) run side by side; a larger one
takes a job per level, in which every block adds its sums and a shuffle by feature finds the best splits. Both walk through
the same code and give the same trees.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.sources.staging import stage

#: Rows of a block. A fit inside one task holds one block: (2 * features + 60) bytes a row.
BLOCK_ROWS = 250_000
#: Rounds after which a distributed fit stores the rows' sums of trees again.
REBASE = 10
TRAIN, VAL = 1, 2


@dataclass(frozen=True)
class Settings:
    """The parameters of a fit. Training stops once the validation error has not fallen for ``early_stopping_rounds``."""

    n_estimators: int = 500
    max_depth: int = 6
    learning_rate: float = 0.1
    subsample: float = 0.8
    colsample_bytree: float = 0.8
    min_child_weight: float = 3
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    seed: int = 42
    early_stopping_rounds: int = 50
    #: Rounds and squared validation errors: a fit that is worse than that after so many rounds is given up.
    hurdles: tuple[tuple[int, float], ...] = ()


def soft(total, alpha: float):
    return np.sign(total) * np.maximum(np.abs(total) - alpha, 0.0)


def score(total, weight, s: Settings):
    return np.maximum(np.abs(total) - s.reg_alpha, 0.0) ** 2 / np.maximum(weight + s.reg_lambda, 1e-300)


@dataclass
class Tree:
    """A tree in heap order: node i has the children 2 i + 1 (up to the cut) and 2 i + 2. A leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int16), np.zeros(n), np.zeros(n))

    def nodes(self, wide: np.ndarray, at: np.ndarray | None = None, rows: np.ndarray | None = None) -> np.ndarray:
        """The node in which each row ends, from the node ``at`` on which it stands (the root if None).

        ``wide`` has the bins of a row side by side; ``rows`` says which of its rows are meant (all if None).
        """
        if at is None:
            at = np.zeros(len(wide) if rows is None else len(rows), np.int64)
        place = np.arange(len(at)) if rows is None else rows
        flat, cell = wide.reshape(-1), place * wide.shape[1]
        leaf, feature = self.feature < 0, np.maximum(self.feature, 0).astype(np.int64)
        # a leaf is its own next node on both sides
        left = np.where(leaf, np.arange(len(leaf)), 2 * np.arange(len(leaf)) + 1)
        step = (~leaf).astype(np.int64)
        while not leaf[at].all():
            right = flat[cell + feature[at]] > self.cut[at]
            at = left[at] + step[at] * right
        return at


def uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) per row and salt, the same wherever the row lies."""
    x = ids.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) / 2.0**64


@dataclass
class Block:
    """Rows of one fit: bins (a row per feature), labels, ids, TRAIN or VAL or 0, bins that a feature can have, and the sum of
    the trees so far."""

    bins: np.ndarray
    label: np.ndarray
    ids: np.ndarray
    code: np.ndarray
    widths: tuple[int, ...]
    margin: np.ndarray | None = None
    #: Of the round that was drawn last: its number, and the sampled rows in nodes that may still be cut, with their gradients and nodes.
    drawn: tuple | None = None

    @cached_property
    def wide(self) -> np.ndarray:
        """The bins with those of a row side by side, for walks down a tree."""
        return np.ascontiguousarray(self.bins.T)

    def __getstate__(self) -> dict:
        """Stored and sent blocks go without what can be made again."""
        return {k: v for k, v in self.__dict__.items() if k != "wide"}

    def sums(self) -> np.ndarray:
        """Number and sum of the training labels."""
        y = self.label[self.code == TRAIN]
        return np.array([len(y), y.sum()])

    def errors(self) -> np.ndarray:
        """Number, squared and absolute error of the validation rows."""
        d = (self.margin - self.label)[self.code == VAL]
        return np.array([len(d), (d * d).sum(), np.abs(d).sum()])

    def add(self, tree: Tree) -> None:
        self.margin = self.margin + tree.value[tree.nodes(self.wide)]

    def histograms(self, tree: Tree, nodes: list[int], features: list[int], round_: int, s: Settings) -> Iterator[tuple[int, np.ndarray]]:
        """(feature, sums) with gradients and rows per node and bin of the sampled training rows."""
        if self.drawn is None or self.drawn[0] != round_:
            used = np.flatnonzero((self.code == TRAIN) & (uniform(self.ids, s.seed * 1_000_003 + round_) < s.subsample))
            self.drawn = round_, used, (self.margin - self.label)[used], np.zeros(len(used), np.int64)
        _, used, gradient, at = self.drawn
        at = tree.nodes(self.wide, at, used)  # one step, if the level before was asked for here
        place = np.full(len(tree.feature), -1)
        place[nodes] = range(len(nodes))
        order = place[at]
        inside = np.flatnonzero(order >= 0)  # the others stay where they are
        if len(nodes) > 1:  # side by side by node, in the same order in each node
            inside = inside[np.argsort(order[inside].astype(np.uint16 if len(nodes) < 2**16 else np.int64), kind="stable")]
        used, gradient, at, order = used[inside], gradient[inside], at[inside], order[inside]
        self.drawn = round_, used, gradient, at
        bases = {width: order * width for width in {self.widths[f] for f in features}}
        for f in features:
            key = bases[self.widths[f]] + self.bins[f][used]
            size = len(nodes) * self.widths[f]
            yield f, np.stack((np.bincount(key, gradient, size), np.bincount(key, minlength=size))).reshape(2, len(nodes), -1)


def best_cuts(sums: np.ndarray, s: Settings) -> np.ndarray:
    """Per node: gain, cut, gradient and rows on the left, gradient and rows in all. No gain means no split."""
    gradient, weight = sums
    left_g, left_w = np.cumsum(gradient, 1), np.cumsum(weight, 1)
    all_g, all_w = left_g[:, -1], left_w[:, -1]
    least = max(s.min_child_weight, 1)
    # a bin without rows cuts like the one before it, which comes first anyway
    allowed = (weight > 0) & (left_w >= least) & (left_w <= (all_w - least)[:, None])
    at, each = np.flatnonzero(allowed), allowed.sum(1)
    g, w = left_g.reshape(-1)[at], left_w.reshape(-1)[at]
    both = score(g, w, s) + score(np.repeat(all_g, each) - g, np.repeat(all_w, each) - w, s)
    gain = np.full(gradient.shape, -np.inf)
    gain.reshape(-1)[at] = both - np.repeat(score(all_g, all_w, s), each)
    cut, rows = gain.argmax(1), np.arange(len(gain))
    return np.column_stack((gain[rows, cut], cut, left_g[rows, cut], left_w[rows, cut], all_g, all_w))


class LocalRows:
    """One block, in the memory of a task."""

    def __init__(self, block: Block):
        self.block = block

    def sums(self) -> np.ndarray:
        return self.block.sums()

    def start(self, base: float) -> None:
        self.block.margin = np.full(len(self.block.label), base)

    def best(self, tree, nodes, features, round_, s) -> dict[int, np.ndarray]:
        return {f: best_cuts(h, s) for f, h in self.block.histograms(tree, nodes, features, round_, s)}

    def add(self, tree: Tree) -> None:
        self.block.add(tree)

    def errors(self) -> np.ndarray:
        return self.block.errors()


class SpreadRows:
    """Blocks spread over the cluster; a method is a job over all of them.

    Rounds are hundreds of short jobs over the same blocks of numbers, so they are kept as such: a partition holds blocks,
    and every ``REBASE`` rounds new ones that hold the sum of the trees so far. Each set is a function of the one before and
    in the end of the stored table, so a lost executor's blocks are computed again.
    """

    def __init__(self, blocks):
        self.blocks, self.trees, self.base = blocks.persist(), [], 0.0

    def _current(self):
        trees, base = tuple(self.trees), self.base

        def work(block: Block) -> Block:
            margin = np.full(len(block.label), base) if block.margin is None else block.margin
            out = replace(block, margin=margin, drawn=None)
            for tree in trees:
                out.add(tree)
            return out

        return self.blocks.map(work)

    def sums(self) -> np.ndarray:
        return self.blocks.map(Block.sums).treeReduce(np.add)

    def start(self, base: float) -> None:
        self.base = base

    def best(self, tree, nodes, features, round_, s) -> dict[int, np.ndarray]:
        parts = self._current().flatMap(lambda b: b.histograms(tree, nodes, features, round_, s))
        return dict(parts.reduceByKey(np.add, min(len(features), 64)).mapValues(lambda h: best_cuts(h, s)).collect())

    def add(self, tree: Tree) -> None:
        self.trees.append(tree)
        if len(self.trees) >= REBASE:
            fresh = self._current().persist()
            fresh.count()
            self.blocks.unpersist()
            self.blocks, self.trees = fresh, []

    def errors(self) -> np.ndarray:
        return self._current().map(Block.errors).treeReduce(np.add)


def grow(rows, features: list[int], round_: int, s: Settings) -> Tree:
    """One tree, level by level. Equal gains go to the first feature and the lowest cut."""
    tree, nodes = Tree.empty(s.max_depth), [0]
    for level in range(s.max_depth):
        if not nodes:
            break
        found = rows.best(tree, nodes, features, round_, s)
        inner = []
        for i, node in enumerate(nodes):
            _, _, _, _, all_g, all_w = found[features[0]][i]
            tree.value[node] = leaf(all_g, all_w, s)
            gain, f = max((found[f][i][0], -f) for f in features)
            if gain > 1e-9:
                _, cut, left_g, left_w, g, w = found[-f][i]
                tree.feature[node], tree.cut[node], tree.gain[node] = -f, cut, gain
                tree.value[2 * node + 1], tree.value[2 * node + 2] = leaf(left_g, left_w, s), leaf(g - left_g, w - left_w, s)
                inner += [c for c, n in ((2 * node + 1, left_w), (2 * node + 2, w - left_w)) if n >= 2 * max(s.min_child_weight, 1)]
        nodes = inner
    return tree


def leaf(gradient: float, weight: float, s: Settings) -> float:
    return -s.learning_rate * soft(gradient, s.reg_alpha) / (weight + s.reg_lambda) if weight else 0.0


def boost(rows, n_features: int, s: Settings, columns: list[int] | None = None) -> dict:
    """Base value, trees up to the best round, and errors (squared mean, absolute mean) of the validation rows per round."""
    columns = list(range(n_features)) if columns is None else columns
    n, total = rows.sums()
    base = float(total / n) if n else 0.0
    rows.start(base)
    trees, history, best, hurdles, given_up = [], [], 0, dict(s.hurdles), False
    for k in range(s.n_estimators if n else 0):
        rng = np.random.default_rng([s.seed, k])
        some = sorted(rng.choice(columns, max(1, round(len(columns) * s.colsample_bytree)), replace=False).tolist())
        tree = grow(rows, some, k, s)
        rows.add(tree)
        trees.append(tree)
        n_val, square, absolute = rows.errors()
        if n_val:
            history.append((float(square / n_val), float(absolute / n_val)))
            if history[-1][0] < history[best][0]:
                best = k
            if k + 1 in hurdles and min(h[0] for h in history) > hurdles[k + 1]:
                given_up = True
                break
            if k - best >= s.early_stopping_rounds:
                break
    kept = trees[: best + 1] if history else trees
    return {"base": base, "trees": kept, "history": history, "given_up": given_up}


@dataclass
class BoostedTrees:
    """A fitted model: names and cuts of the features, and what ``boost`` returned."""

    features: list[str]
    cuts: list[np.ndarray]
    base: float
    trees: list[Tree]
    history: list[tuple[float, float]] = field(default_factory=list)
    given_up: bool = False

    @property
    def importances(self) -> np.ndarray:
        """Mean gain of the splits of each feature, as shares of their sum."""
        total, count = np.zeros(len(self.features)), np.zeros(len(self.features))
        for t in self.trees:
            inner = t.feature >= 0
            np.add.at(total, t.feature[inner], t.gain[inner])
            np.add.at(count, t.feature[inner], 1)
        mean = np.divide(total, count, out=np.zeros_like(total), where=count > 0)
        return mean / mean.sum() if mean.sum() else mean

    def predict(self, x: np.ndarray) -> np.ndarray:
        wide = np.ascontiguousarray(binned(x, self.cuts).T)
        return self.base + sum((t.value[t.nodes(wide)] for t in self.trees), np.zeros(len(x)))

    def column(self, features: list[str] | None = None) -> Column:
        """The prediction of a row that has the features as columns. A missing value counts as larger than all others."""

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            return pd.Series(self.predict(np.vstack(x.to_numpy())) if len(x) else [], dtype="float64")

        return predict(F.array(*[present(c) for c in features or self.features]))


def present(c: str) -> Column:
    """A feature as a double; null as NaN, which no cut lies above."""
    return F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """A row per feature: how many of its cuts lie below the value, so that bin <= b means value <= cut b."""
    return np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)]).astype(np.uint8).reshape(len(cuts), len(x))


def cut_points(rows: DataFrame, features: list[str], max_bin: int = 256, accuracy: int = 10_000) -> list[np.ndarray]:
    """Ascending cuts of each feature, at most ``max_bin`` - 1: all its values where they are few (the last one
    sets missing values apart), else quantiles.

    Two passes with bounded aggregates: sketches first, then the values of the features that have few.
    """
    x = rows.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(features)])
    names, probs = x.columns, [k / max_bin for k in range(1, max_bin)]
    stats = [F.percentile_approx(c, probs, accuracy).alias(f"q_{c}") for c in names] + [F.approx_count_distinct(c).alias(f"n_{c}") for c in names]
    first = x.agg(*stats).first()
    few = [c for c in names if first[f"n_{c}"] <= max_bin // 2]
    values = x.agg(*[F.collect_set(c).alias(c) for c in few]).first() if few else {}
    cuts = [sorted(values[c]) if c in few else sorted(set(first[f"q_{c}"] or [])) for c in names]
    return [np.array(c[: max_bin - 1], np.float64) for c in cuts]


BLOCK = "bins binary, label binary, ids binary, codes binary"


def store_blocks(rows: DataFrame, features: list[str], cuts: list[np.ndarray], target: str, codes: list[Column]) -> DataFrame:
    """Binned rows that have a target and are used by one of the ``codes`` (TRAIN, VAL or 0 per row and fit), as stored blocks."""
    x = rows.select(F.array(*[present(c) for c in features]).alias("x"), F.col(target).cast("double").alias("y"), F.array(*[c.cast("int") for c in codes]).alias("codes"))
    x = x.filter(F.col("y").isNotNull() & ~F.isnan("y") & F.exists("codes", lambda c: c > 0)).withColumn("id", F.xxhash64("x", "y"))
    parts = 1 + x.count() // BLOCK_ROWS

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block() -> pa.RecordBatch:
            bins, *others = (np.concatenate(c, axis=-1) for c in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in (bins, *others)], ["bins", "label", "ids", "codes"])

        for batch in batches:
            if batch.num_rows:
                wide = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                kinds = batch["codes"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                held.append((binned(wide, cuts), batch["y"].to_numpy(), batch["id"].to_numpy(), kinds.T.astype(np.uint8)))
                n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield block()
                held, n = [], 0
        if held:
            yield block()

    return stage(x.repartition(parts).mapInArrow(make, BLOCK), "boosting-blocks")


def block_of(row, code: int, cuts: list[np.ndarray]) -> Block:
    """The rows of a stored block, as the fit with that code sees them."""
    widths = tuple(len(c) + 1 for c in cuts)
    label = np.frombuffer(row["label"], np.float64)
    codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, len(label))
    return Block(np.frombuffer(row["bins"], np.uint8).reshape(-1, len(label)), label, np.frombuffer(row["ids"], np.int64), codes[code], widths)


@dataclass(frozen=True)
class Fit:
    """One fit over stored blocks: its settings, which of the codes it uses, and which features (all if None)."""

    settings: Settings
    code: int = 0
    columns: tuple[int, ...] | None = None


def fit_blocks(blocks: DataFrame, features: list[str], cuts: list[np.ndarray], fits: list[Fit], at_once: int = 4) -> list[BoostedTrees]:
    """The models of several fits: one task each if there is one block, else distributed, ``at_once`` at the same time."""
    chosen = [list(f.columns) if f.columns is not None else list(range(len(features))) for f in fits]
    if blocks.count() <= 1:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    k = row["fit"]
                    found = boost(LocalRows(block_of(row, fits[k].code, cuts)), len(features), fits[k].settings, chosen[k])
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pickle.dumps(found)], pa.binary())], ["fit", "model"])

        each = blocks.withColumn("fit", F.explode(F.array(*[F.lit(k).cast("long") for k in range(len(fits))])))
        found = {r.fit: pickle.loads(r.model) for r in each.repartitionByRange(len(fits), "fit").mapInArrow(run, "fit long, model binary").collect()}
    else:

        def spread(k: int) -> dict:
            code = fits[k].code
            rows = SpreadRows(blocks.rdd.map(lambda r: block_of(r, code, cuts)))
            try:
                return boost(rows, len(features), fits[k].settings, chosen[k])
            finally:
                rows.blocks.unpersist()

        with ThreadPoolExecutor(at_once) as pool:
            found = dict(enumerate(pool.map(spread, range(len(fits)))))
    nothing = {"base": 0.0, "trees": [], "history": [], "given_up": False}
    return [BoostedTrees(list(features), cuts, **found.get(k, nothing)) for k in range(len(fits))]


def fit_trees(rows: DataFrame, features: list[str], target: str, train: Column, val: Column, settings: list[Settings]) -> list[BoostedTrees]:
    """Models of several settings on the rows where ``train`` holds, stopped early on those where ``val`` does. Pass a stored table."""
    features = list(features)
    cuts = cut_points(rows.filter(train), features)
    code = F.when(train, TRAIN).when(val, VAL).otherwise(0)
    return fit_blocks(store_blocks(rows, features, cuts, target, [code]), features, cuts, [Fit(s) for s in settings])


@dataclass(frozen=True)
class Cut:
    """The best first cut of a feature: its value, its gain, and the training rows up to it."""

    value: float
    gain: float
    rows: float


def first_cuts(rows: DataFrame, features: list[str], target: str, train: Column, settings: Settings) -> dict[str, Cut]:
    """What each feature alone could do at the root of the first tree; features without an allowed cut are left out."""
    features = list(features)
    cuts = cut_points(rows.filter(train), features)
    blocks = store_blocks(rows, features, cuts, target, [F.when(train, TRAIN).otherwise(0)])
    spread = SpreadRows(blocks.rdd.map(lambda r: block_of(r, 0, cuts)))
    n, total = spread.sums() if blocks.count() else (0, 0.0)
    if not n:
        return {}
    spread.start(float(total / n))
    found = spread.best(Tree.empty(1), [0], list(range(len(features))), 0, settings)
    spread.blocks.unpersist()
    return {features[f]: Cut(float(cuts[f][int(c[0][1])]), float(c[0][0]), float(c[0][3])) for f, c in found.items() if np.isfinite(c[0][0])}
