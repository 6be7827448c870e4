"""Scoring with a recurrent network: stacked LSTM layers, attention over time, a two-layer head.

Weights are a table (tensor, row, values), a row per matrix row. The forward pass is plain matrix products over batches of
windows; windows are cut from blocks where they are scored and never stored.

Tensors, with H hidden units and gates in the order input, forget, candidate, output: ``lstm{k}_input`` (4H x inputs),
``lstm{k}_hidden`` (4H x H), ``lstm{k}_bias`` (1 x 4H); per attention head ``attend{k}_in``, ``attend{k}_in_bias``,
``attend{k}_out`` (1 x units; its bias would cancel in the softmax), and with several heads ``project`` and
``project_bias``; ``head_in``, ``head_in_bias``, ``head_out``, ``head_out_bias``. Without attention the last state is used,
without a head the first unit of the context.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from panelcast.config import SEQUENCE_LENGTH

#: Windows in one forward pass.
BATCH = 1024


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


class Network:
    def __init__(self, tensors: dict[str, np.ndarray]):
        self.tensors = {k: np.atleast_2d(np.asarray(v, float)) for k, v in tensors.items()}
        self.layers = sum(k.startswith("lstm") and k.endswith("_input") for k in tensors)
        self.heads = sum(k.startswith("attend") and k.endswith("_in") for k in tensors)

    @classmethod
    def from_table(cls, table: DataFrame) -> Network:
        """Reads (tensor, row, values). A model fits in memory, as every worker holds it."""
        rows: dict[str, list] = {}
        for tensor, _, values in table.select("tensor", "row", "values").orderBy("tensor", "row").collect():
            rows.setdefault(tensor, []).append(values)
        return cls({k: np.array(v) for k, v in rows.items()})

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, i, [float(x) for x in row]) for k, v in sorted(self.tensors.items()) for i, row in enumerate(v)]
        return spark.createDataFrame(rows, "tensor string, row int, values array<double>")

    def states(self, x: np.ndarray) -> np.ndarray:
        """Hidden states of the last layer: (windows, steps, hidden units)."""
        t = self.tensors
        for k in range(self.layers):
            inner, bias = t[f"lstm{k}_hidden"], t[f"lstm{k}_bias"][0]
            size = inner.shape[1]
            given = x @ t[f"lstm{k}_input"].T + bias  # all steps at once
            h, c, out = np.zeros((len(x), size)), np.zeros((len(x), size)), np.empty((*x.shape[:2], size))
            for step in range(x.shape[1]):
                i, f, g, o = np.split(given[:, step] + h @ inner.T, 4, axis=1)
                c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
                h = sigmoid(o) * np.tanh(c)
                out[:, step] = h
            x = out
        return x

    def predict(self, x: np.ndarray) -> np.ndarray:
        """One value per window of an array (windows, steps, inputs)."""
        t, states = self.tensors, self.states(np.asarray(x, float))
        contexts = []
        for k in range(self.heads):
            scores = np.tanh(states @ t[f"attend{k}_in"].T + t[f"attend{k}_in_bias"][0]) @ t[f"attend{k}_out"][0]
            weights = np.exp(scores - scores.max(1, keepdims=True))
            weights /= weights.sum(1, keepdims=True)
            contexts.append(np.einsum("ns,nsh->nh", weights, states))
        context = np.concatenate(contexts, 1) if contexts else states[:, -1]
        if self.heads > 1:
            context = context @ t["project"].T + t["project_bias"][0]
        if "head_in" not in t:
            return context[:, 0]
        inner = np.maximum(context @ t["head_in"].T + t["head_in_bias"][0], 0.0)
        return (inner @ t["head_out"].T + t["head_out_bias"][0])[:, 0]


def score_blocks(blocks: DataFrame, network: Network, length=SEQUENCE_LENGTH) -> DataFrame:
    """(route, date, target, pred) of all wanted rows of ``folds.sequence_blocks``. A missing cell gives no prediction.

    The network is broadcast: a model's size does not grow with the data, and a Python worker reads it once.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(network)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                rows = batch["rows"].slice(n, 1).flatten()
                fields = dict(zip((f.name for f in rows.type), rows.flatten(), strict=True))
                x = fields["x"].flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                wanted = np.flatnonzero(fields["wanted"].to_numpy(zero_copy_only=False))
                wanted = wanted[wanted >= length]
                views = np.lib.stride_tricks.sliding_window_view(x, length, axis=0) if len(wanted) else np.empty((0, 0, 0))
                for at in range(0, len(wanted), BATCH):
                    some = wanted[at : at + BATCH]
                    found = shared.value.predict(views[some - length].transpose(0, 2, 1))
                    place = pa.array(some)
                    columns = [pa.array([batch["route"][n].as_py()] * len(some), pa.string()), fields["date"].take(place), fields["target"].take(place).cast(pa.float64()), pa.array(found, pa.float64(), from_pandas=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["route", "date", "target", "pred"])

    return blocks.select("route", "rows").mapInArrow(score, "route string, date date, target double, pred double")
