"""Guided search over settings by tree-structured Parzen estimators."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Range:
    """Values of one setting: from low to high, on a log scale or in steps if asked for."""

    low: float
    high: float
    log: bool = False
    step: int | None = None

    def value(self, u: float):
        """The value at a place in [0, 1]."""
        if self.step:
            count = int((self.high - self.low) // self.step) + 1
            return int(self.low + self.step * min(int(u * count), count - 1))
        return float(self.low * (self.high / self.low) ** u if self.log else self.low + (self.high - self.low) * u)

    def place(self, value) -> float:
        if self.step:
            return ((value - self.low) / self.step + 0.5) / (int((self.high - self.low) // self.step) + 1)
        return math.log(value / self.low) / math.log(self.high / self.low) if self.log else (value - self.low) / (self.high - self.low)


class Parzen:
    """A mixture of normals on [0, 1]: one at each observation, as wide as the gap to its neighbours, and a wide one."""

    def __init__(self, places: list[float]):
        at = np.sort(np.array(places, float))
        edges = np.concatenate(([0.0], at, [1.0]))
        gap = np.maximum(at - edges[:-2], edges[2:] - at)
        self.centre = np.append(at, 0.5)
        self.width = np.append(np.clip(gap, 1 / min(100, 1 + len(at)), 1.0), 1.0)
        below = lambda x: np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in x])
        self.inside = below((1 - self.centre) / self.width) - below(-self.centre / self.width)

    def sample(self, rng: np.random.Generator, n: int) -> np.ndarray:
        out = []
        while len(out) < n:
            k = rng.integers(len(self.centre))
            x = rng.normal(self.centre[k], self.width[k])
            if 0 <= x <= 1:
                out.append(x)
        return np.array(out)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, None] - self.centre) / self.width
        return np.log(np.mean(np.exp(-0.5 * z * z) / (self.width * self.inside), axis=1) + 1e-300)


class ParzenSearch:
    """Asks for settings to try and learns from their losses.

    The first ``startup`` trials are random. Later, the best tenth of the finished trials (25 at most) and the rest each
    give a density per setting, and of ``candidates`` drawn from the good one the candidate wins that is likeliest there
    against the rest. Trials that are still running count among the rest, so trials asked for together differ. All draws
    are seeded by the number of the trial.
    """

    def __init__(self, space: dict[str, Range], seed: int = 42, startup: int = 10, candidates: int = 24):
        self.space, self.seed, self.startup, self.candidates = dict(space), seed, startup, candidates
        self.told: list[tuple[float, dict]] = []
        self.running: list[dict] = []
        self.asked = 0

    def ask(self, n: int = 1) -> list[dict]:
        out = []
        for _ in range(n):
            rng = np.random.default_rng([self.seed, self.asked])
            one = self._random(rng) if len(self.told) < self.startup else self._guided(rng)
            self.asked += 1
            self.running.append(one)
            out.append(one)
        return out

    def tell(self, settings: dict, loss: float) -> None:
        if settings in self.running:
            self.running.remove(settings)
        self.told.append((loss, settings))

    def _random(self, rng) -> dict:
        return {name: r.value(rng.random()) for name, r in self.space.items()}

    def _guided(self, rng) -> dict:
        ranked = [s for _, s in sorted(self.told, key=lambda t: t[0])]
        n = min(math.ceil(0.1 * len(ranked)), 25)
        good, rest = ranked[:n], ranked[n:] + self.running
        out = {}
        for name, r in self.space.items():
            likely, other = (Parzen([r.place(s[name]) for s in some]) for some in (good, rest))
            x = likely.sample(rng, self.candidates)
            out[name] = r.value(float(x[np.argmax(likely.log_density(x) - other.log_density(x))]))
        return out


def random_settings(space: dict[str, Range], n: int, seed: int = 42) -> list[dict]:
    """Settings that learn from nothing: the yardstick of a guided search."""
    return ParzenSearch(space, seed, startup=n).ask(n)
