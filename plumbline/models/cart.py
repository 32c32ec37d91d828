"""Classification trees whose thresholds are looked for between all neighbouring values of all rows, many trees at a time."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut, map_arrow

#: Numbers of a sorted list that one task holds.
NUMBERS = 1_000_000


@dataclass
class Cart:
    """A tree for the rows outside ``fold``, on the first ``columns`` columns."""

    fold: int
    columns: int
    depth: int
    gini: bool = True  # else entropy

    def __post_init__(self) -> None:
        self.feature = np.full(2, -1)  # by node, the children of node i are 2i and 2i + 1; of a leaf: -1
        self.cut = np.zeros(2)
        self.open = {1}
        self.leaf = {1: -1}  # node -> the most frequent class, the smallest of equally frequent ones

    def split(self, node: int, feature: int, at: float, left: Counter, right: Counter) -> None:
        while len(self.feature) <= 2 * node + 1:
            self.feature, self.cut = np.r_[self.feature, np.full(len(self.feature), -1)], np.r_[self.cut, np.zeros(len(self.cut))]
        self.feature[node], self.cut[node] = feature, at
        for child, counts in ((2 * node, left), (2 * node + 1, right)):
            self.settle(child, counts)
            if len(counts) > 1 and child.bit_length() <= self.depth:
                self.open.add(child)

    def settle(self, node: int, counts: Counter) -> None:
        self.leaf[node] = max(counts, key=lambda c: (counts[c], -c))

    def nodes(self, x: np.ndarray) -> np.ndarray:
        at = np.ones(len(x), np.int64)
        while len(inner := np.flatnonzero(self.feature[at] >= 0)):
            node = at[inner]
            at[inner] = 2 * node + (x[inner, self.feature[node]] > self.cut[node])
        return at

    def term(self, n):
        """What a class of ``n`` rows adds to the sum that ``loss`` takes."""
        return n * n if self.gini else n * np.log(np.maximum(n, 1))

    def loss(self, n, terms):
        """Rows times their impurity."""
        return n - terms / np.maximum(n, 1) if self.gini else self.term(n) - terms


def _lists(batches: Iterator[pa.RecordBatch], xs: list[str]):
    """(list, part, numbers, fold, class, rows) of each part of a sorted list; a part is never in two tasks."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    name = np.stack([t[c].to_numpy() for c in ("_j", "_p")], axis=1)
    x = np.stack([t[c].to_numpy() for c in xs], axis=1)
    f, y, n = (t[c].to_numpy() for c in ("_f", "_y", "_n"))
    for j, p in np.unique(name, axis=0).tolist():
        at = np.flatnonzero((name == (j, p)).all(axis=1))
        yield j, p, x[at], f[at], y[at].astype(np.int64), n[at].astype(float)


def _training(trees: list[Cart], j: int, x: np.ndarray, f: np.ndarray):
    """(tree, rows it learns from that are in an open node, their nodes)."""
    for i, tree in enumerate(trees):
        if tree.open and j < tree.columns:
            node = tree.nodes(x)
            at = np.flatnonzero((f != tree.fold) & np.isin(node, list(tree.open)))
            if len(at):
                yield i, at, node[at]


def _counter(y: np.ndarray, n: np.ndarray) -> Counter:
    kinds, of = np.unique(y, return_inverse=True)
    return Counter(dict(zip(kinds.tolist(), np.bincount(of, n).tolist())))


def _best(tree: Cart, node: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, before: dict[int, Counter], total: dict[int, Counter]):
    """(node, loss, last value on the left, first on the right, classes on the left within this part) of the best split of each node inside a part whose rows are in the order of ``x``."""
    order = np.lexsort((y, node))
    new = np.r_[True, (node[order][1:] != node[order][:-1]) | (y[order][1:] != y[order][:-1])]
    group, starts = np.cumsum(new) - 1, np.flatnonzero(new)
    sums = np.cumsum(n[order])
    which = [(int(node[order[s]]), int(y[order[s]])) for s in starts]
    shift = np.array([before[v][c] for v, c in which], float) - (sums - n[order])[starts]
    after, whole = np.zeros(len(x)), np.zeros(len(x))
    after[order], whole[order] = sums + shift[group], np.array([total[v][c] for v, c in which], float)[group]
    left = tree.term(after) - tree.term(after - n)
    right = tree.term(whole - after) - tree.term(whole - after + n)
    order = np.argsort(node, kind="stable")
    ends = np.r_[np.flatnonzero(np.diff(node[order])) + 1, len(order)]
    for s, e in zip(np.r_[0, ends[:-1]], ends):
        rows = order[s:e]
        rises = np.flatnonzero(x[rows][1:] > x[rows][:-1])
        if not len(rises):
            continue
        v = int(node[rows[0]])
        had, all_ = np.array(list(before[v].values()), float), np.array(list(total[v].values()), float)
        rest = np.array([total[v][c] - before[v][c] for c in total[v]], float)
        count = had.sum() + np.cumsum(n[rows])
        loss = tree.loss(count, tree.term(had).sum() + np.cumsum(left[rows])) + tree.loss(all_.sum() - count, tree.term(rest).sum() + np.cumsum(right[rows]))
        i = int(rises[np.argmin(loss[rises])])
        yield v, float(loss[i]), float(x[rows[i]]), float(x[rows[i + 1]]), _counter(y[rows[: i + 1]], n[rows[: i + 1]])


def _whole_loss(tree: Cart, counts: Counter) -> float:
    n = np.array(list(counts.values()), float)
    return float(tree.loss(n.sum(), tree.term(n).sum()))


def grow(cells: DataFrame, xs: list[str], trees: list[Cart], numbers: int = NUMBERS) -> None:
    """Grow all ``trees`` together, a level at a time, from ``cells``: finite numbers ``xs``, fold _f, class code _y and how many rows _n are like that.

    For each column the cells are written once in its order, dealt into parts that a task can hold; equal values may lie in several parts.
    A level is two passes over them: the classes of each part by open node, from which come those before each part, then each part's best threshold.
    Thresholds between two parts are judged at the driver. What comes there are class counts by part and open node. Splits without a gain aren't made.
    """
    per_task = max(1, numbers // (len(xs) + 3))
    n = cells.count()
    parts = max(1, -(-n // per_task), min(cells.sparkSession.sparkContext.defaultParallelism, n // 10_000))
    table = None
    for j, c in enumerate(xs):
        ranged = cells.repartitionByRange(parts, F.col(c), F.xxhash64(*xs, "_f", "_y")).sortWithinPartitions(c)
        one = cut(ranged.select(*xs, "_f", "_y", "_n", F.lit(j).alias("_j"), F.spark_partition_id().alias("_p")))
        table = one if table is None else table.unionByName(one)
    while any(t.open for t in trees):

        def counted(batches):
            for j, p, x, f, y, n in _lists(batches, xs):
                found = []
                for i, at, node in _training(trees, j, x, f):
                    order = np.argsort(node, kind="stable")
                    for rows in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                        counts = _counter(y[at[rows]], n[at[rows]])
                        found.append((j, p, i, int(node[rows[0]]), list(counts), [int(k) for k in counts.values()], float(x[at[rows[0]], j]), float(x[at[rows[-1]], j])))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*found)], names=["j", "p", "i", "v", "y", "n", "lo", "hi"])

        rows = map_arrow(table, counted, "j long, p long, i long, v long, y array<long>, n array<long>, lo double, hi double").collect()
        before: dict[tuple[int, int], dict[tuple[int, int], Counter]] = {}  # (list, part) -> (tree, node) -> classes in the parts before
        seen: dict[tuple[int, int, int], tuple[Counter, float]] = {}  # (list, tree, node) -> classes up to here, last value
        between = []
        for r in sorted(rows, key=lambda r: (r["j"], r["p"])):
            had, last = seen.get((r["j"], r["i"], r["v"]), (Counter(), None))
            before.setdefault((r["j"], r["p"]), {})[r["i"], r["v"]] = had
            if last is not None and last < r["lo"]:
                between.append((r["i"], r["v"], r["j"], last, r["lo"], had))
            seen[r["j"], r["i"], r["v"]] = had + Counter(dict(zip(r["y"], r["n"]))), r["hi"]
        total = {(i, v): counts for (j, i, v), (counts, _) in seen.items() if j == 0}

        def split(batches):
            for j, p, x, f, y, n in _lists(batches, xs):
                found = []
                for i, at, node in _training(trees, j, x, f):
                    had = {v: before[j, p][i, v] for v in np.unique(node).tolist()}
                    for v, loss, lo, hi, counts in _best(trees[i], node, x[at, j], y[at], n[at], had, {v: total[i, v] for v in had}):
                        found.append((j, p, i, v, loss, lo, hi, list(counts), [int(k) for k in counts.values()]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*found)], names=["j", "p", "i", "v", "loss", "lo", "hi", "y", "n"])

        best: dict[tuple[int, int], tuple] = {}
        inside = map_arrow(table, split, "j long, p long, i long, v long, loss double, lo double, hi double, y array<long>, n array<long>").collect()
        offers = [(r["i"], r["v"], r["loss"], r["j"], r["lo"], r["hi"], before[r["j"], r["p"]][r["i"], r["v"]] + Counter(dict(zip(r["y"], r["n"])))) for r in inside]
        offers += [(i, v, _whole_loss(trees[i], had) + _whole_loss(trees[i], total[i, v] - had), j, lo, hi, had) for i, v, j, lo, hi, had in between]
        for i, v, *offer in offers:
            if (i, v) not in best or offer[:3] < best[i, v][:3]:
                best[i, v] = offer
        for tree in trees:
            tree.open = set()
        for (i, v), counts in total.items():
            tree = trees[i]
            if v == 1:
                tree.settle(1, counts)
            if (i, v) in best and tree.depth > 0:
                loss, j, lo, hi, left = best[i, v]
                size = sum(counts.values())
                if _whole_loss(tree, counts) - loss > 1e-12 * size * max(1.0, float(np.log(size))):
                    middle = lo + (hi - lo) / 2
                    tree.split(v, j, middle if middle < hi else lo, left, counts - left)


def right(cells: DataFrame, xs: list[str], trees: list[Cart]) -> list[int]:
    """How many rows of its own fold each tree predicts rightly."""

    def step(batches):
        total = np.zeros(len(trees), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in xs], axis=1)
            f, y, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_f", "_y", "_n"))
            for i, tree in enumerate(trees):
                at = np.flatnonzero(f == tree.fold)
                nodes, of = np.unique(tree.nodes(x[at]), return_inverse=True)
                said = np.array([tree.leaf[v] for v in nodes.tolist()], np.int64)[of]
                total[i] += n[at][said == y[at]].sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(trees))), pa.array(total)], names=["i", "n"])

    got = {r["i"]: r["n"] for r in map_arrow(cells, step, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    return [got.get(i, 0) for i in range(len(trees))]
