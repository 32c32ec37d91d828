"""Landmarks ask for every row and look at every threshold."""

import numpy as np
import pytest

from plumbline.dataset import Dataset
from plumbline.models import cart, classic
from plumbline.operators import profile


def cells(spark, d, n=1500, seed=2):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 2)
    x[:60] = x[0]  # equal points
    f, y = rng.integers(0, 5, n), ((x[:, 0] > 0.3) + (x[:, -1] > 0.9) + (rng.random(n) < 0.1)).astype(int)
    w = rng.integers(1, 4, n)
    rows = [(*map(float, x[i]), int(f[i]), int(y[i]), int(w[i]), 2 * i + 1) for i in range(n)]
    return x, f, y, w, spark.createDataFrame(rows, ", ".join(f"x{j} double" for j in range(d)) + ", _f int, _y int, _n long, k long").persist()


@pytest.mark.parametrize("d", [1, 3])
def test_neighbour_in_any_other_fold(spark, d):
    x, f, y, _, df = cells(spark, d)
    xs = [f"x{j}" for j in range(d)]
    got = {tuple(r)[:-1]: r["_y"] for r in classic.nearest_apart(df, xs, "_f", "k", "_y", block=64).collect()}
    far = ((x[:, None] - x[None]) ** 2).sum(2)
    far[f[:, None] == f[None]] = np.inf
    assert got == {(*map(float, x[i]), int(f[i])): int(y[far[i].argmin()]) for i in range(len(x))}


def brute(x, y, w, depth, gini):
    """(predictor, sum of the leaves' impurities)."""
    count = np.bincount(y, w)
    n = count.sum()
    loss = lambda c: c.sum() - (c * c).sum() / c.sum() if gini else c.sum() * np.log(c.sum()) - (c * np.log(np.maximum(c, 1))).sum()
    best = (loss(count) - 1e-9 * n,)
    for j in range(x.shape[1]) if depth else []:
        for a, b in zip(np.unique(x[:, j])[:-1], np.unique(x[:, j])[1:]):
            low = x[:, j] <= a
            best = min(best, (loss(np.bincount(y[low], w[low])) + loss(np.bincount(y[~low], w[~low])), j, (a + b) / 2))
    if len(best) == 1:
        return lambda q: np.full(len(q), count.argmax())
    _, j, at = best
    low = x[:, j] <= at
    left, right = (brute(x[s], y[s], w[s], depth - 1, gini) for s in (low, ~low))
    return lambda q: np.where(q[:, j] <= at, left(q), right(q))


@pytest.mark.parametrize("numbers", [600, 1_000_000])
def test_trees_over_parts_are_those_of_all_thresholds(spark, numbers):
    x, f, y, w, df = cells(spark, 2)
    shapes = [(2, 3, True), (2, 3, False), (1, 1, False)]
    trees = [cart.Cart(fold, *shape) for shape in shapes for fold in range(2)]
    cart.grow(df, ["x0", "x1"], trees, numbers)
    want = []
    for tree in trees:
        at, test = f != tree.fold, f == tree.fold
        said = brute(x[at][:, : tree.columns], y[at], w[at], tree.depth, tree.gini)
        assert [tree.leaf[v] for v in tree.nodes(x)] == said(x).tolist()
        want.append(int(w[test][said(x[test]) == y[test]].sum()))
    assert cart.right(df, ["x0", "x1"], trees) == want


def test_all_rows_are_tested_and_all_thresholds_seen(spark):
    # keys that 50 doesn't divide, and a class border that 32 bins miss
    rows = [(2 * i + 1, float(i), int(i >= 997)) for i in range(1400)]
    ds = Dataset.of(spark.createDataFrame(rows, "id long, x double, y int"), ["x"], "y", keep=("id",))
    got = profile.landmarks(ds, "id")
    assert got["Landmark1NN"] > 0.99 and min(got[f"Landmark{t}"] for t in ("DecisionTree", "DecisionNodeLearner", "RandomNodeLearner")) > 0.9985
    assert profile.landmarks(ds, "id", legacy_scale=True)["Landmark1NN"] == got["Landmark1NN"] / 2
