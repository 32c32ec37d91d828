"""Exact nearest neighbours of every row, by blocks that no task has to see all of."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from plumbline.session import cut, ship

#: Rows of a round's sample: so many in all, or so many for each block that is still too large.
SAMPLE, SAMPLE_BLOCK = 20_000, 64


class Forest:
    """One k-d tree for each group; its leaves are the blocks."""

    def __init__(self, groups: list[str]) -> None:
        self.axis, self.cut, self.kids = [], [], []  # of a leaf: axis -1
        self.root = {g: self._node() for g in groups}
        self.low: np.ndarray | None = None
        self.high: np.ndarray | None = None

    def _node(self) -> int:
        self.axis.append(-1)
        self.cut.append(0.0)
        self.kids.append((-1, -1))
        return len(self.axis) - 1

    def split(self, leaf: int, x: np.ndarray, n: float, block: int) -> bool:
        """A leaf of about ``n`` rows halved at medians of its sample, until its parts hold about ``block`` or the sample is too small."""
        if n <= block or len(x) < 16:
            return False
        spread = x.max(axis=0) - x.min(axis=0)
        a = int(np.argmax(spread))
        if not spread[a] > 0:
            return False
        at = float(np.median(x[:, a]))
        if at >= x[:, a].max():  # the left side takes what is at most the cut
            at = float(x[x[:, a] < at, a].max())
        left = x[:, a] <= at
        self.axis[leaf], self.cut[leaf] = a, at
        self.kids[leaf] = self._node(), self._node()
        for kid, part in zip(self.kids[leaf], (x[left], x[~left])):
            self.split(kid, part, n * len(part) / len(x), block)
        return True

    def leaves(self, x: np.ndarray, groups: np.ndarray) -> np.ndarray:
        at = np.array([self.root[g] for g in groups], np.int64)
        axis, cuts, kids = np.array(self.axis), np.array(self.cut), np.array(self.kids)
        while (inner := np.flatnonzero(axis[at] >= 0)).size:
            node = at[inner]
            right = x[inner, axis[node]] > cuts[node]
            at[inner] = kids[node, right.astype(int)]
        return at

    def boxes(self, rows: list, d: int) -> None:
        """The boxes of the leaves' rows, and from them those of the inner nodes."""
        self.low, self.high = np.full((len(self.axis), d), np.inf), np.full((len(self.axis), d), -np.inf)
        for r in rows:
            self.low[r["_b"]], self.high[r["_b"]] = [r[f"l{i}"] for i in range(d)], [r[f"h{i}"] for i in range(d)]
        for v in range(len(self.axis) - 1, -1, -1):  # children come after their parents
            if self.axis[v] >= 0:
                a, b = self.kids[v]
                self.low[v], self.high[v] = np.minimum(self.low[a], self.low[b]), np.maximum(self.high[a], self.high[b])

    def reached(self, x: np.ndarray, radius: np.ndarray, root: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows whose ball of a squared ``radius`` reaches its box)."""
        todo = [(root, np.arange(len(x)))]
        while todo:
            v, rows = todo.pop()
            gap = np.maximum(0, np.maximum(self.low[v] - x[rows], x[rows] - self.high[v]))
            rows = rows[(gap**2).sum(axis=1) <= radius[rows] * (1 + 1e-9)]
            if not len(rows):
                continue
            if self.axis[v] < 0:
                yield v, rows
            else:
                todo += [(kid, rows) for kid in self.kids[v]]


def _search(q: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances, ids) of the k nearest rows but the row itself, the smaller id of equally near ones; inf where there are fewer."""
    dist, near = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int64)
    step = max(1, 2_000_000 // max(1, len(x)))
    for s in range(0, len(q) if len(x) else 0, step):
        part = np.zeros((len(q[s : s + step]), len(x)))
        for j in range(x.shape[1]):  # by differences: exact for near rows, and the same from both sides
            part += (q[s : s + step, j, None] - x[None, :, j]) ** 2
        part[qid[s : s + step, None] == ids[None]] = np.inf
        rows = np.arange(len(part))
        for i in range(min(k, len(x))):
            best = part.argmin(axis=1)
            dist[s + rows, i] = part[rows, best]
            near[s + rows, i] = np.where(np.isfinite(part[rows, best]), ids[best], -1)
            part[rows, best] = np.inf
    return dist, near


def _sorted(t: pa.Table, columns: list[str], k: int):
    """Rows in the order of their ids, the start of each run of equal points, and which are among the first k + 1 of their run."""
    t = t.take(pa.array(np.argsort(t["_id"].to_numpy(), kind="stable")))
    x, ids = np.stack([t[c].to_numpy() for c in columns], axis=1), t["_id"].to_numpy()
    new = np.r_[True, (x[1:] != x[:-1]).any(axis=1)] if len(x) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0)) if len(x) else np.zeros(0, np.int64)
    return t, x, ids, start, np.arange(len(x)) - start <= k


def grown(points: DataFrame, xs: list[str], block: int, salt: list[str]) -> tuple[Forest, DataFrame]:
    """The k-d trees of each group _g of ``points``, and the points with the leaf _b that they lie in.

    Leaves are halved at medians of samples until they hold about ``block`` rows. The samples only say where a block ends: all points are placed,
    and the boxes are those of all points. ``salt`` are the columns that a sample is drawn by.
    """
    d = len(xs)
    ship(points.sparkSession)
    forest = Forest([r["_g"] for r in points.select("_g").distinct().collect()])
    wide = StructType([*points.schema.fields, StructField("_b", LongType())])

    def placed(tree: Forest) -> DataFrame:
        def step(batches):
            for b in batches:
                x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in xs], axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.leaves(x, np.array(b.column("_g").to_pylist(), object)), pa.int64())], [*b.schema.names, "_b"])

        return points.mapInArrow(step, wide)

    while True:
        boxes = placed(forest).groupBy("_b").agg(F.count("*").alias("n"), *[F.min(c).alias(f"l{i}") for i, c in enumerate(xs)], *[F.max(c).alias(f"h{i}") for i, c in enumerate(xs)]).collect()
        large = {r["_b"]: r["n"] for r in boxes if r["n"] > 2 * block and any(r[f"l{i}"] < r[f"h{i}"] for i in range(d))}
        if not large:
            break
        share = min(1.0, max(SAMPLE, SAMPLE_BLOCK * len(large)) / sum(large.values()))
        sample = placed(forest).where(F.col("_b").isin(list(large)) & (F.pmod(F.xxhash64(*salt, F.lit(len(forest.axis))), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)).select("_b", *xs).collect()
        held: dict[int, list] = {}
        for r in sample:
            held.setdefault(r["_b"], []).append(r[1:])
        if not any([forest.split(b, np.array(held[b]), n, block) for b, n in large.items() if b in held]):
            break  # what is left are runs of equal points
    forest.boxes(boxes, d)
    return forest, placed(forest)


def nearest(df: DataFrame, columns: list[str], k: int = 1, group: str | None = None, block: int = 4096) -> DataFrame:
    """(_id, near: the ids of the ``k`` nearest other rows, near ones first), within each value of ``group`` if given.

    ``df`` must be a fixed copy with finite numbers and an ``_id`` that grows in the order of ``columns``, which also settles equal
    distances. Rows lie in blocks of about ``block``, the leaves of a k-d tree. Each is searched in its own block; where the ball
    to its k-th neighbour reaches the box of another block, it is searched there as well, so no pair is lost at an edge.
    Of equal points only the first k + 1 can be a neighbour, so a block of many isn't compared pairwise.
    """
    d = len(columns)
    points = df.select("_id", (F.col(group).cast("string") if group else F.lit("")).alias("_g"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    xs = [f"x{i}" for i in range(d)]
    wide = f"_id long, _g string, {', '.join(f'{c} double' for c in xs)}, _b long"
    forest, placed = grown(points, xs, block, ["_id"])
    cells = cut(placed)

    def own(t: pa.Table) -> pa.Table:
        t, x, ids, start, first = _sorted(t, xs, k)
        dist, near = np.zeros((len(x), k)), np.zeros((len(x), k), np.int64)
        dist[first], near[first] = _search(x[first], ids[first], x[first], ids[first], k)
        late = np.flatnonzero(~first)
        near[late] = ids[start[late, None] + np.arange(k)]
        return pa.table({**{c: t[c] for c in wide_names}, "_d": pa.array(dist.tolist(), pa.list_(pa.float64())), "_n": pa.array(near.tolist(), pa.list_(pa.int64()))})

    wide_names = ["_id", "_g", *xs, "_b"]
    inside = cut(cells.groupBy("_b").applyInArrow(own, f"{wide}, _d array<double>, _n array<long>"))

    def across(batches):
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in xs], axis=1)
            radius = np.array([v[-1] for v in b.column("_d").to_pylist()])
            home, groups = b.column("_b").to_numpy(), np.array(b.column("_g").to_pylist(), object)
            for g in set(groups):
                mine = np.flatnonzero((groups == g) & (radius > 0))
                for leaf, rows in forest.reached(x[mine], radius[mine], forest.root[g]):
                    rows = mine[rows]
                    rows = rows[home[rows] != leaf]
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(rows)) for c in ["_id", "_g", *xs]], pa.array(np.full(len(rows), leaf), pa.int64())], wide_names)

    def other(q: pa.Table, t: pa.Table) -> pa.Table:
        _, x, ids, _, first = _sorted(t, xs, k)
        at = np.stack([q[c].to_numpy() for c in xs], axis=1)
        dist, near = _search(at, q["_id"].to_numpy(), x[first], ids[first], k) if len(at) else (np.zeros((0, k)), np.zeros((0, k), np.int64))
        return pa.table({"_id": q["_id"], "_d": pa.array(dist.tolist(), pa.list_(pa.float64())), "_n": pa.array(near.tolist(), pa.list_(pa.int64()))})

    asked = inside.mapInArrow(across, wide)
    outside = asked.groupBy("_b").cogroup(cells.groupBy("_b")).applyInArrow(other, "_id long, _d array<double>, _n array<long>")
    found = inside.select("_id", "_d", "_n").unionByName(outside).select("_id", F.explode(F.arrays_zip("_d", "_n")).alias("p")).where("p._n >= 0")
    if k == 1:
        return found.groupBy("_id").agg(F.array(F.min(F.struct("p._d", "p._n"))["_n"]).alias("near"))
    return found.groupBy("_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("p._d", "p._n"))), 1, k).alias("p")).select("_id", F.col("p._n").alias("near"))
