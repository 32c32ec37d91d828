"""Models of the score of a configuration, and what to try next. Numpy on the driver: their data are trials, not rows."""

from __future__ import annotations

from math import sqrt

import numpy as np

from plumbline.operators.stats import normal_cdf, normal_pdf


class Forest:
    """Random regression trees; mean and variance over the trees."""

    def __init__(self, n_trees: int = 10, depth: int = 8, seed: int = 1) -> None:
        self.n_trees, self.depth, self.seed = n_trees, depth, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        self.trees = []
        for _ in range(self.n_trees):
            at = rng.integers(0, len(x), len(x))
            self.trees.append(self._grow(x[at], y[at], self.depth, rng))
        return self

    def _grow(self, x, y, depth, rng):
        if depth == 0 or len(y) < 3 or np.ptp(y) == 0:
            return float(y.mean())
        best = None
        for f in rng.permutation(x.shape[1])[: max(1, int(np.ceil(x.shape[1] * 5 / 6)))]:
            values = np.unique(x[:, f])
            if len(values) < 2:
                continue
            cut = rng.uniform(values[0], values[-1]) if len(values) > 8 else float(rng.choice((values[1:] + values[:-1]) / 2))
            left = x[:, f] <= cut
            if left.all() or not left.any():
                continue
            loss = y[left].var() * left.sum() + y[~left].var() * (~left).sum()
            if best is None or loss < best[0]:
                best = (loss, f, cut, left)
        if best is None:
            return float(y.mean())
        _, f, cut, left = best
        return (f, cut, self._grow(x[left], y[left], depth - 1, rng), self._grow(x[~left], y[~left], depth - 1, rng))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((len(self.trees), len(x)))
        for t, tree in enumerate(self.trees):
            for i, row in enumerate(x):
                node = tree
                while isinstance(node, tuple):
                    node = node[2] if row[node[0]] <= node[1] else node[3]
                out[t, i] = node
        return out.mean(axis=0), out.var(axis=0) + 1e-10


class GaussianProcess:
    """Matern 5/2 process; the length scale is the one of a small grid with the highest likelihood."""

    def __init__(self, noise: float = 1e-4) -> None:
        self.noise = noise

    def _kernel(self, a: np.ndarray, b: np.ndarray, scale: float) -> np.ndarray:
        r = np.sqrt(5 * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)) / scale
        return (1 + r + r * r / 3) * np.exp(-r)

    def fit(self, x: np.ndarray, y: np.ndarray) -> GaussianProcess:
        self.mean, self.sd = y.mean(), y.std() or 1.0
        z = (y - self.mean) / self.sd
        best = (-np.inf, None)
        for scale in (0.1, 0.2, 0.4, 0.8, 1.6, 3.2):
            try:
                low = np.linalg.cholesky(self._kernel(x, x, scale) + self.noise * np.eye(len(x)))
            except np.linalg.LinAlgError:
                continue
            alpha = np.linalg.solve(low.T, np.linalg.solve(low, z))
            fit = -0.5 * z @ alpha - np.log(np.diag(low)).sum()
            if fit > best[0]:
                best = (fit, (scale, low, alpha))
        self.x, (self.scale, self.low, self.alpha) = x, best[1]
        return self

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self._kernel(x, self.x, self.scale)
        v = np.linalg.solve(self.low, k.T)
        return k @ self.alpha * self.sd + self.mean, np.maximum(1 - (v * v).sum(0), 1e-10) * self.sd**2


class RankedEnsemble:
    """Models of several tasks, weighted by how often they rank the target's trials right in resampled pairs.

    Members whose median loss is above the 70th percentile of the target model's loss don't count.
    """

    def __init__(self, others: list, samples: int = 100, seed: int = 1) -> None:
        self.others, self.samples, self.seed = others, samples, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> RankedEnsemble:
        rng = np.random.default_rng(self.seed)
        target = GaussianProcess().fit(x, y)
        self.models = [*self.others, target]
        losses = np.zeros((len(self.models), self.samples))
        truth = y[:, None] < y[None]
        for i, m in enumerate(self.models):
            mean, var = m.predict(x)
            for s in range(self.samples):
                draw = rng.normal(mean, np.sqrt(var))
                losses[i, s] = ((draw[:, None] < draw[None]) != truth).sum()
        limit = np.percentile(losses[-1], 70)
        alive = [i for i in range(len(self.models)) if i == len(self.models) - 1 or np.median(losses[i]) <= limit]
        wins = np.zeros(len(self.models))
        for s in range(self.samples):
            low = min(losses[i, s] for i in alive)
            best = [i for i in alive if losses[i, s] == low]
            wins[best[-1]] += 1
        self.weights = wins / wins.sum()
        return self

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [(w, *m.predict(x)) for w, m in zip(self.weights, self.models) if w]
        return sum(w * m for w, m, _ in parts), sum(w * w * v for w, _, v in parts)


def acquisition(kind: str, mean: np.ndarray, var: np.ndarray, best: float, cost: np.ndarray | None = None, xi: float = 0.0, kappa: float = 2.0) -> np.ndarray:
    """How much a configuration promises, for scores to be maximised: ei, eips (ei per cost), logei, pi or lcb."""
    sd = np.sqrt(var)
    out = np.zeros(len(mean))
    for i in range(len(mean)):
        gap = mean[i] - best - xi
        z = gap / sd[i] if sd[i] > 0 else 0.0
        if kind == "lcb":
            out[i] = mean[i] + kappa * sd[i]
        elif kind == "pi":
            out[i] = normal_cdf(z) if sd[i] > 0 else float(gap > 0)
        else:
            ei = gap * normal_cdf(z) + sd[i] * normal_pdf(z) if sd[i] > 0 else 0.0
            out[i] = np.log(max(ei, 1e-300)) if kind == "logei" else ei / (cost[i] if kind == "eips" and cost is not None else 1.0)
    return out


def integrated(models: list, x: np.ndarray, best: float, kind: str = "ei") -> np.ndarray:
    """The mean acquisition over several models of one task."""
    return np.mean([acquisition(kind, *m.predict(x), best) for m in models], axis=0)


def scott_bandwidth(x: np.ndarray) -> np.ndarray:
    return np.maximum(x.std(axis=0) * len(x) ** (-1 / (x.shape[1] + 4)), 1e-2)


def density_ratio(good: np.ndarray, bad: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Log-ratio of the kernel densities of good and bad configurations."""

    def density(points: np.ndarray) -> np.ndarray:
        h = scott_bandwidth(points)
        z = (x[:, None] - points[None]) / h
        return np.log(np.exp(-0.5 * (z * z).sum(2)).mean(axis=1) + 1e-300) - np.log(h).sum()

    return density(good) - density(bad)


def distance(a: np.ndarray, b: np.ndarray) -> float:
    return sqrt(float(((a - b) ** 2).sum()))
