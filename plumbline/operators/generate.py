"""New features from old ones: arithmetic, products, projections, embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.dataset import CATEGORICAL, DISCRETE, Dataset, Stage, one_row
from plumbline.functions.scalar import BINARY, UNARY, text_tokens
from plumbline.session import map_arrow


@dataclass
class Arithmetic(Stage):
    """One scalar function on every number column, in place."""

    func: str = "sqrt"
    name: str = "arithmetic"

    def columns(self, targets: list[str]) -> dict[str, Column]:
        return {f: UNARY[self.func](F.col(f)) for f in targets}


@dataclass
class Pairwise(Stage):
    """An operation on every pair of distinct number columns, added."""

    func: str = "add"
    name: str = "pairwise"
    mode: str = "concatenate"

    def columns(self, targets: list[str]) -> dict[str, Column]:
        return {f"{a}_{self.func}_{b}": BINARY[self.func](F.col(a), F.col(b)) for a, b in combinations(targets, 2)}


@dataclass
class Cross(Stage):
    """Products of every pair of 0/1 columns that vary, added to them. More than ``most`` columns are an error."""

    takes: tuple[str, ...] = (CATEGORICAL, DISCRETE)
    name: str = "cross"
    mode: str = "concatenate"
    most: int = 200

    def learn(self, ds: Dataset, targets: list[str]) -> dict:
        if len(targets) > self.most:
            raise ValueError(f"{len(targets)} columns; name at most {self.most} as targets")
        pairs = list(combinations(targets, 2))
        var = one_row(ds.df, {f"{i}": F.var_pop(F.col(a) * F.col(b)) for i, (a, b) in enumerate(pairs)})
        return {"pairs": [p for i, p in enumerate(pairs) if (var[f"{i}"] or 0) > 0]}

    def columns(self, targets: list[str]) -> dict[str, Column]:
        return {f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in self.state["pairs"]}


def importances(ds: Dataset, targets: list[str], classify: bool, trees: int = 20, seed: int = 1) -> dict[str, float]:
    """Gain of each column in a random forest."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    data = VectorAssembler(inputCols=targets, outputCol="_v", handleInvalid="skip").transform(ds.df.select(*[F.col(t).cast("double").alias(t) for t in targets], F.col(ds.label).cast("double").alias("_y"))).select("_v", "_y")
    forest = (RandomForestClassifier if classify else RandomForestRegressor)(featuresCol="_v", labelCol="_y", numTrees=trees, seed=seed, maxDepth=5)
    return dict(zip(targets, forest.fit(data).featureImportances.toArray().tolist()))


@dataclass
class Polynomial(Stage):
    """Products of up to ``degree`` columns, added. ``top`` columns by importance are used (25, 10 and 6 for degree 2, 3, 4)."""

    degree: int = 2
    interaction_only: bool = False
    top: int | None = None
    classify: bool = True
    name: str = "polynomial"
    mode: str = "concatenate"

    def learn(self, ds: Dataset, targets: list[str]) -> dict:
        top = self.top or {2: 25, 3: 10, 4: 6}.get(self.degree, 6)
        if len(targets) > top:
            gain = importances(ds, targets, self.classify)
            targets = sorted(sorted(targets, key=lambda t: -gain[t])[:top], key=targets.index)
        return {"used": targets}

    def columns(self, targets: list[str]) -> dict[str, Column]:
        choose = combinations if self.interaction_only else combinations_with_replacement
        used = self.state["used"]
        return {"*".join(c): reduce(lambda a, b: a * b, [F.col(x) for x in c]) for k in range(2, self.degree + 1) for c in choose(used, k)}


#: Up to so many columns second moments are aggregate expressions; wider tables are summed in Arrow batches.
EXPRESSIONS = 12


def scatter(df: DataFrame, columns: list[str], shift: np.ndarray, group: str | None = None) -> dict:
    """group value (or None) -> sum of (x - shift)(x - shift)' over rows without nulls.

    Each task adds up its own batches and sends one number per pair of columns and group on, which are then added by key.
    """
    d = len(columns)
    upper = np.triu_indices(d)

    def run(batches):
        sums: dict = {}
        for b in batches:
            x = np.stack([np.asarray(b[f"x{i}"].to_numpy(zero_copy_only=False), float) for i in range(d)], axis=1) - shift
            g = np.array(b["g"].to_pylist(), dtype=object)
            ok = ~np.isnan(x).any(axis=1)
            for v in set(g[ok]):
                part = x[ok & (g == v)]
                sums[v] = sums.get(v, 0) + part.T @ part
        for v, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([v] * len(upper[0]), pa.string()), pa.array(np.arange(len(upper[0])), pa.int32()), pa.array(m[upper])], names=["g", "k", "v"])

    key = (F.col(group).cast("string") if group else F.lit("")).alias("g")
    parts = map_arrow(df.select(key, *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).where("g is not null"), run, "g string, k int, v double")
    out: dict = {}
    for r in parts.groupBy("g", "k").agg(F.sum("v").alias("v")).collect():
        m = out.setdefault(r["g"] if group else None, np.zeros((d, d)))
        i, j = upper[0][r["k"]], upper[1][r["k"]]
        m[i, j] = m[j, i] = r["v"]
    return out


def moments(df: DataFrame, columns: list[str], centred: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, covariance or second moment, n) of number columns: d x d numbers come to the driver, no rows."""
    d = len(columns)
    if d > EXPRESSIONS:
        clean = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
        got = one_row(clean, {"n": F.count(F.lit(1)), **{f"m{i}": F.avg(c) for i, c in enumerate(columns)}})
        mean = np.array([got[f"m{i}"] or 0.0 for i in range(d)])
        total = scatter(clean, columns, mean if centred else np.zeros(d)).get(None, np.zeros((d, d)))
        return mean, total / max(got["n"], 1), got["n"]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    exprs = [F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]]
    if centred:
        exprs += [F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]
    else:
        exprs += [F.avg(F.col(columns[i]) * F.col(columns[j])).alias(f"c{i}_{j}") for i, j in pairs]
    row = df.agg(*exprs).first()
    second = np.zeros((d, d))
    for i, j in pairs:
        second[i, j] = second[j, i] = row[f"c{i}_{j}"] or 0.0
    return np.array([row[f"m{i}"] or 0.0 for i in range(d)]), second, row["n"]


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Columns with the entry of the largest size positive, so that signs don't depend on the solver."""
    top = np.abs(vectors).argmax(axis=0)
    return vectors * np.where(vectors[top, range(vectors.shape[1])] < 0, -1, 1)


def linear(columns: list[str], weights: np.ndarray, shift: np.ndarray | None = None) -> Column:
    return reduce(lambda a, b: a + b, [(F.col(c) - float(shift[i]) if shift is not None else F.col(c)) * float(weights[i]) for i, c in enumerate(columns)])


@dataclass
class PCA(Stage):
    """Centred projection to the leading principal axes that keep a share of the variance."""

    keep: float = 0.95
    whiten: bool = False
    name: str = "pca"
    mode: str = "only_new"

    def learn(self, ds: Dataset, targets: list[str]) -> dict:
        mean, cov, n = moments(ds.df, targets)
        values, vectors = np.linalg.eigh(cov)
        values, vectors = np.maximum(values[::-1], 0), _signed(vectors[:, ::-1])
        k = min(len(values), int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), self.keep) + 1))
        scale = 1 / np.sqrt(np.maximum(values * n / max(n - 1, 1), 1e-300)) if self.whiten else np.ones(len(values))
        return {"mean": mean, "axes": vectors[:, :k] * scale[:k], "variance": values}

    def columns(self, targets: list[str]) -> dict[str, Column]:
        return {f"pc{k}": linear(targets, self.state["axes"][:, k], self.state["mean"]) for k in range(self.state["axes"].shape[1])}


@dataclass
class SVD(Stage):
    """Projection to the leading right singular vectors, uncentred."""

    target_dim: int = 10
    name: str = "svd"
    mode: str = "only_new"

    def learn(self, ds: Dataset, targets: list[str]) -> dict:
        _, second, _ = moments(ds.df, targets, centred=False)
        values, vectors = np.linalg.eigh(second)
        k = max(1, min(self.target_dim, len(targets) - 1))
        return {"axes": _signed(vectors[:, ::-1])[:, :k], "values": values[::-1][:k]}

    def columns(self, targets: list[str]) -> dict[str, Column]:
        return {f"sv{k}": linear(targets, self.state["axes"][:, k]) for k in range(self.state["axes"].shape[1])}


NONLINEAR = {
    "logcosh": (lambda u: F.tanh(u), lambda u: 1 - F.tanh(u) * F.tanh(u)),
    "exp": (lambda u: u * F.exp(-u * u / 2), lambda u: (1 - u * u) * F.exp(-u * u / 2)),
    "cube": (lambda u: u * u * u, lambda u: 3 * u * u),
}


@dataclass
class FastICA(Stage):
    """Independent components by the fixed-point iteration; each step is one aggregate over the whitened data.

    ``parallel`` updates all components together, ``deflation`` one after the other.
    """

    n_components: int = 2
    algorithm: str = "parallel"
    fun: str = "logcosh"
    max_iter: int = 30
    tol: float = 1e-4
    seed: int = 1
    name: str = "fast_ica"
    mode: str = "only_new"

    def learn(self, ds: Dataset, targets: list[str]) -> dict:
        mean, cov, _ = moments(ds.df, targets)
        values, vectors = np.linalg.eigh(cov)
        k = min(self.n_components, int((values > 1e-12 * values.max()).sum()))
        values, vectors = values[::-1][:k], _signed(vectors[:, ::-1])[:, :k]
        white = vectors / np.sqrt(values)
        z = ds.df.select(*[linear(targets, white[:, i], mean).alias(f"z{i}") for i in range(k)])
        names = [f"z{i}" for i in range(k)]
        g, dg = NONLINEAR[self.fun]

        def updated(w: np.ndarray) -> np.ndarray:
            exprs = {}
            for r in range(len(w)):
                u = linear(names, w[r])
                exprs |= {f"d{r}": F.avg(dg(u)), **{f"g{r}_{i}": F.avg(F.col(n) * g(u)) for i, n in enumerate(names)}}
            got = one_row(z, exprs)
            return np.array([[got[f"g{r}_{i}"] for i in range(k)] for r in range(len(w))]) - np.array([got[f"d{r}"] for r in range(len(w))])[:, None] * w

        def orthogonal(w: np.ndarray) -> np.ndarray:
            s, u = np.linalg.eigh(w @ w.T)
            return u @ np.diag(1 / np.sqrt(np.maximum(s, 1e-300))) @ u.T @ w

        start = np.random.default_rng(self.seed).normal(size=(k, k))
        if self.algorithm == "parallel":
            w = orthogonal(start)
            for _ in range(self.max_iter):
                new = orthogonal(updated(w))
                done = np.abs(np.abs((new * w).sum(1)) - 1).max() < self.tol
                w = new
                if done:
                    break
        else:
            w = np.zeros((0, k))
            for r in range(k):
                v = start[r] - w.T @ (w @ start[r])
                v /= np.linalg.norm(v)
                for _ in range(self.max_iter):
                    new = updated(v[None])[0]
                    new -= w.T @ (w @ new)
                    new /= np.linalg.norm(new)
                    done = abs(abs(new @ v) - 1) < self.tol
                    v = new
                    if done:
                        break
                w = np.vstack([w, v])
        return {"mean": mean, "axes": (white @ w.T)}

    def columns(self, targets: list[str]) -> dict[str, Column]:
        return {f"ic{k}": linear(targets, self.state["axes"][:, k], self.state["mean"]) for k in range(self.state["axes"].shape[1])}


def agglomerate(distance: np.ndarray, n_clusters: int, linkage: str = "ward") -> list[list[int]]:
    """Clusters of a small distance matrix, merging the closest pair until ``n_clusters`` are left (Lance and Williams)."""
    d = distance.astype(float) ** 2 if linkage == "ward" else distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    groups = {i: [i] for i in range(len(d))}
    while len(groups) > n_clusters:
        live = sorted(groups)
        sub = d[np.ix_(live, live)]
        a, b = (live[i] for i in np.unravel_index(sub.argmin(), sub.shape))
        a, b = min(a, b), max(a, b)
        na, nb = len(groups[a]), len(groups[b])
        for c in live:
            if c in (a, b):
                continue
            if linkage == "ward":
                nc = len(groups[c])
                new = ((na + nc) * d[a, c] + (nb + nc) * d[b, c] - nc * d[a, b]) / (na + nb + nc)
            elif linkage == "complete":
                new = max(d[a, c], d[b, c])
            elif linkage == "single":
                new = min(d[a, c], d[b, c])
            else:
                new = (na * d[a, c] + nb * d[b, c]) / (na + nb)
            d[a, c] = d[c, a] = new
        groups[a] += groups.pop(b)
    return [sorted(g) for _, g in sorted(groups.items())]


@dataclass
class FeatureAgglomeration(Stage):
    """Similar columns pooled into one: clusters of columns by their distances, which one pass of second moments gives."""

    n_clusters: int = 2
    affinity: str = "euclidean"
    linkage: str = "ward"
    pool: str = "mean"
    name: str = "feature_agglomeration"
    mode: str = "only_new"

    def learn(self, ds: Dataset, targets: list[str]) -> dict:
        _, second, n = moments(ds.df, targets, centred=False)
        sq = np.diag(second)
        if self.linkage == "ward" or self.affinity == "euclidean":
            dist = np.sqrt(np.maximum(sq[:, None] + sq[None] - 2 * second, 0) * n)
        elif self.affinity == "cosine":
            dist = 1 - second / np.sqrt(np.maximum(sq[:, None] * sq[None], 1e-300))
        else:
            got = one_row(ds.df, {f"{i}_{j}": F.sum(F.abs(F.col(targets[i]) - F.col(targets[j]))) for i, j in combinations(range(len(targets)), 2)})
            dist = np.zeros((len(targets),) * 2)
            for i, j in combinations(range(len(targets)), 2):
                dist[i, j] = dist[j, i] = got[f"{i}_{j}"]
        return {"clusters": [[targets[i] for i in g] for g in agglomerate(dist, min(self.n_clusters, len(targets)), self.linkage)]}

    def columns(self, targets: list[str]) -> dict[str, Column]:
        def pooled(group: list[str]) -> Column:
            cols = [F.col(c).cast("double") for c in group]
            if self.pool == "mean":
                return reduce(lambda a, b: a + b, cols) / len(cols)
            if self.pool == "max":
                return F.greatest(*cols) if len(cols) > 1 else cols[0]
            ordered = F.array_sort(F.array(*cols))
            return (F.get(ordered, F.lit((len(cols) - 1) // 2)) + F.get(ordered, F.lit(len(cols) // 2))) / 2

        return {f"cluster{k}": pooled(g) for k, g in enumerate(self.state["clusters"])}


@dataclass
class RandomFourier(Stage):
    """sqrt(2 / D) cos(w x + b): features whose products approximate the rbf kernel."""

    gamma: float = 1.0
    n_components: int = 50
    seed: int = 1
    name: str = "random_fourier"
    mode: str = "only_new"

    def learn(self, ds: Dataset, targets: list[str]) -> dict:
        rng = np.random.default_rng(self.seed)
        return {"w": rng.normal(size=(len(targets), self.n_components)) * np.sqrt(2 * self.gamma), "b": rng.uniform(0, 2 * np.pi, self.n_components)}

    def columns(self, targets: list[str]) -> dict[str, Column]:
        return {f"rf{k}": F.cos(linear(targets, self.state["w"][:, k]) + float(self.state["b"][k])) * float(np.sqrt(2 / self.n_components)) for k in range(self.n_components)}


def landmark_rows(df: DataFrame, columns: list[str], n: int, seed: int) -> np.ndarray:
    """``n`` distinct rows chosen by a hash of their values, the same on every run: a bounded sample on the driver."""
    key = F.xxhash64(F.lit(seed), *columns)
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns], key.alias("_k")).na.drop().distinct().orderBy("_k").limit(n).collect()
    return np.array([[r[c] for c in columns] for r in rows])


def kernel_matrix(a: np.ndarray, b: np.ndarray, kernel: str, gamma: float, degree: int, coef0: float) -> np.ndarray:
    if kernel == "rbf":
        return np.exp(-gamma * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))
    if kernel == "cosine":
        return (a @ b.T) / np.maximum(np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None], 1e-300)
    if kernel == "chi2":
        a, b = np.maximum(a, 0), np.maximum(b, 0)
        s, d = a[:, None] + b[None], a[:, None] - b[None]
        return np.exp(-gamma * np.where(s > 0, d * d / np.where(s > 0, s, 1), 0).sum(2))
    inner = gamma * a @ b.T + coef0
    return np.tanh(inner) if kernel == "sigmoid" else inner**degree


def kernel_rows(x: np.ndarray, points: np.ndarray, kernel: str, gamma: float, degree: int, coef0: float) -> np.ndarray:
    """As ``kernel_column``, for all rows and points: a point at a time, and distances from differences."""
    if kernel == "rbf":
        return np.stack([np.exp(-gamma * ((x - p) ** 2).sum(1)) for p in points], axis=1)
    return np.hstack([kernel_matrix(x, p[None], kernel, gamma, degree, coef0) for p in points])


def kernel_column(columns: list[str], point: np.ndarray, kernel: str, gamma: float, degree: int, coef0: float) -> Column:
    """The kernel of a row and a fixed point, as an expression."""
    total = lambda parts: reduce(lambda a, b: a + b, parts)
    cols = [F.col(c).cast("double") for c in columns]
    if kernel == "rbf":
        return F.exp(total([(c - float(p)) * (c - float(p)) for c, p in zip(cols, point)]) * -gamma)
    if kernel == "cosine":
        return total([c * float(p) for c, p in zip(cols, point)]) / F.greatest(F.sqrt(total([c * c for c in cols])) * float(np.linalg.norm(point)), F.lit(1e-300))
    if kernel == "chi2":
        pos = [F.greatest(c, F.lit(0.0)) for c in cols]
        return F.exp(total([F.when(c + max(float(p), 0) > 0, (c - max(float(p), 0)) * (c - max(float(p), 0)) / (c + max(float(p), 0))).otherwise(0.0) for c, p in zip(pos, point)]) * -gamma)
    inner = total([c * float(p) for c, p in zip(cols, point)]) * gamma + coef0
    return F.tanh(inner) if kernel == "sigmoid" else F.pow(inner, F.lit(degree))


@dataclass
class Nystroem(Stage):
    """Kernel features over a bounded sample of landmark rows."""

    kernel: str = "rbf"
    n_components: int = 20
    gamma: float = 0.1
    degree: int = 3
    coef0: float = 1.0
    seed: int = 1
    name: str = "nystroem"
    mode: str = "only_new"

    def learn(self, ds: Dataset, targets: list[str]) -> dict:
        points = landmark_rows(ds.df, targets, self.n_components, self.seed)
        u, s, _ = np.linalg.svd(kernel_matrix(points, points, self.kernel, self.gamma, self.degree, self.coef0))
        return {"points": points, "map": u @ np.diag(1 / np.sqrt(np.maximum(s, 1e-12))) @ u.T}

    def weights(self) -> tuple[str, np.ndarray, np.ndarray]:
        """(prefix of the new columns, weights of the landmarks' kernels for each of them, what is added)."""
        return "ny", self.state["map"].T, np.zeros(len(self.state["points"]))

    def transform(self, ds: Dataset) -> Dataset:
        """All new columns from one matrix of kernels a batch; as expressions each column would hold all kernels once more, and later steps would repeat them."""
        targets = self.state["targets"]
        if not targets:
            return ds
        _, w, add = self.weights()
        points, kernel = self.state["points"], (self.kernel, self.gamma, self.degree, self.coef0)
        rest = [*ds.keep, *([ds.label] if ds.label else []), *([ds.weight] if ds.weight else []), *(ds.features if self.mode != "only_new" else [])]
        fields = [T.StructField(f.name, f.dataType) for f in ds.df.select(*rest).schema.fields]
        new = [f"_new{i}" for i in range(w.shape[1])]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), np.float64) for c in b.columns[len(rest) :]], axis=1)
                gaps = np.stack([c.is_null().to_numpy(zero_copy_only=False) for c in b.columns[len(rest) :]], axis=1)
                if kernel[0] == "chi2":  # takes the larger of a cell and 0
                    x[gaps], gaps = 0.0, np.zeros_like(gaps)
                gap = gaps.any(axis=1)
                out = kernel_rows(x, points, *kernel) @ w + add
                yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], *[pa.array(out[:, i], mask=gap) for i in range(len(new))]], names=[*rest, *new])

        wide = ds.df.select(*rest, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(targets)])
        return super().transform(replace(ds, df=map_arrow(wide, run, T.StructType([*fields, *[T.StructField(n, T.DoubleType()) for n in new]]))))

    def columns(self, targets: list[str]) -> dict[str, Column]:
        prefix, w, _ = self.weights()
        return {f"{prefix}{i}": F.col(f"_new{i}") for i in range(w.shape[1])}


@dataclass
class KernelPCA(Nystroem):
    """Principal axes in kernel space, from a bounded sample of landmark rows, centred on it."""

    name: str = "kernel_pca"
    n_axes: int = 2

    def learn(self, ds: Dataset, targets: list[str]) -> dict:
        points = landmark_rows(ds.df, targets, self.n_components, self.seed)
        k = kernel_matrix(points, points, self.kernel, self.gamma, self.degree, self.coef0)
        rows = k.mean(axis=0)
        centred = k - rows[None] - rows[:, None] + k.mean()
        values, vectors = np.linalg.eigh(centred)
        axes = min(self.n_axes, len(points))
        values, vectors = np.maximum(values[::-1][:axes], 1e-12), _signed(vectors[:, ::-1])[:, :axes]
        return {"points": points, "axes": vectors / np.sqrt(values), "rows": rows, "mean": k.mean()}

    def weights(self) -> tuple[str, np.ndarray, np.ndarray]:
        s = self.state
        # (k - mean(k) - rows + mean) . w
        return "kp", s["axes"] - s["axes"].mean(axis=0), -(s["rows"] - s["mean"]) @ s["axes"]


@dataclass
class TreeEmbedding(Stage):
    """Leaves of totally random trees, one-hot. A split halves the range its node has left, at a random point of a random column."""

    n_trees: int = 10
    depth: int = 3
    seed: int = 1
    name: str = "tree_embedding"
    mode: str = "only_new"
    gives: str = DISCRETE

    def learn(self, ds: Dataset, targets: list[str]) -> dict:
        got = one_row(ds.df, {f"{a}|{f}": g(f) for f in targets for a, g in (("lo", F.min), ("hi", F.max))})
        rng = np.random.default_rng(self.seed)

        def grow(box: dict, depth: int):
            wide = [f for f in targets if box[f][0] is not None and box[f][1] > box[f][0]]
            if not depth or not wide:
                return None
            f = wide[rng.integers(len(wide))]
            at = float(rng.uniform(*map(float, box[f])))
            return (f, at, grow({**box, f: (box[f][0], at)}, depth - 1), grow({**box, f: (at, box[f][1])}, depth - 1))

        return {"trees": [grow({f: (got[f"lo|{f}"], got[f"hi|{f}"]) for f in targets}, self.depth) for _ in range(self.n_trees)]}

    def columns(self, targets: list[str]) -> dict[str, Column]:
        out = {}
        for t, tree in enumerate(self.state["trees"]):
            leaves: list[Column] = []

            def walk(node, so_far: Column, leaves=leaves) -> None:
                if node is None:
                    leaves.append(so_far)
                    return
                f, at, low, high = node
                walk(low, so_far & (F.col(f) <= at))
                walk(high, so_far & (F.col(f) > at))

            walk(tree, F.lit(True))
            out |= {f"t{t}_l{i}": F.coalesce(c.cast("double"), F.lit(0.0)) for i, c in enumerate(leaves)}
        return out


#: Words that one task of Word2Vec is fitted on, on average.
WORDS = 1_000_000


@dataclass
class TextVectors(Stage):
    """Texts as the mean of their words' vectors, plain or weighted by alpha / (alpha + tf) (tf: the word's count in its text).

    ``vectors`` is a frame (word, vector array<float>); words without a vector don't count, a text without known words is all zeros.
    Words are joined by hash. Without ``vectors``, Word2Vec is fitted on all texts: in one task up to ``WORDS`` words, beyond in more, each on
    its share of the texts from the same start, and a word's vector is the mean over the tasks that met it. ``options`` may name another ``numPartitions``.
    """

    vectors: DataFrame | None = None
    size: int = 50
    method: str = "mean"
    alpha: float = 1e-3
    key: str = "doc_id"
    name: str = "text_vectors"
    seed: int = 1
    options: dict = field(default_factory=dict)

    def embed(self, df: DataFrame, text: str) -> DataFrame:
        """(key, vector)."""
        words = df.select(self.key, text_tokens(F.col(text)).alias("_w"))
        vectors = self.vectors
        if vectors is None:
            from pyspark.ml.feature import Word2Vec

            parts = self.options.get("numPartitions") or max(1, -(-(words.where("_w is not null").agg(F.sum(F.size("_w").cast("long"))).first()[0] or 0) // WORDS))
            model = Word2Vec(vectorSize=self.size, inputCol="_w", outputCol="_v", seed=self.seed, **{"minCount": 2, "maxIter": 1, **self.options, "numPartitions": parts}).fit(words.where("_w is not null"))
            vectors = model.getVectors().select("word", vector_to_array("vector").alias("vector"))
        per = words.select(self.key, F.explode("_w").alias("word")).groupBy(self.key, "word").agg(F.count("*").alias("tf")).join(vectors, "word")
        weight = F.col("tf") * (F.lit(self.alpha) / (self.alpha + F.col("tf")) if self.method == "weighted" else F.lit(1.0))
        dims = [F.sum(weight * F.get("vector", F.lit(i))).alias(f"s{i}") for i in range(self.size)]
        sums = per.groupBy(self.key).agg(F.sum("tf").alias("_n"), *dims)
        mean = F.array(*[F.coalesce(F.col(f"s{i}") / F.col("_n"), F.lit(0.0)) for i in range(self.size)])
        return df.select(self.key).join(sums, self.key, "left").select(self.key, mean.alias("vector"))


@dataclass
class Embed(Stage):
    """Texts or images as vectors by one's own model: ``embed`` takes a pandas series of cells and gives one list of
    numbers for each. It runs in Arrow batches; a null cell stays null."""

    embed: object = None
    takes: tuple[str, ...] = ("text", "image", CATEGORICAL)
    gives: str = "embedding"
    mode: str = "replace"
    name: str = "embed"

    def columns(self, targets: list[str]) -> dict[str, Column]:
        made = F.pandas_udf(self.embed, "array<float>")
        return {f"{f}_vector": F.when(F.col(f).isNotNull(), made(F.coalesce(F.col(f), F.lit("")))) for f in targets}
