"""Tree and linear estimators on ``pyspark.ml``, boosting by reweighting, and bags of balanced samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.models.classic import Model, by_class, choose, normal
from plumbline.operators.generate import kernel_column, kernel_matrix, landmark_rows
from plumbline.session import map_arrow


def assembled(df: DataFrame, features: list[str], out: str = "_v") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(df)


@dataclass
class Wrapped(Model):
    """A ``pyspark.ml`` estimator under this package's contract; class models add ``probability`` as an array."""

    params: dict = field(default_factory=dict)
    weight: str | None = None

    def make(self):
        raise NotImplementedError

    def fit(self, df: DataFrame) -> Wrapped:
        data = assembled(df.select(*self.features, F.col(self.label).cast("double").alias("_y"), *([self.weight] if self.weight else [])).where("_y is not null"), self.features)
        est = self.make().setFeaturesCol("_v").setLabelCol("_y")
        if self.weight and est.hasParam("weightCol"):
            est = est.setWeightCol(self.weight)
        self.state = {"model": est.fit(data)}
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.state["model"].transform(assembled(df, self.features))
        if self.classify and "probability" not in out.columns and "rawPrediction" in out.columns:  # one against rest
            out = out.withColumn("probability", normal(F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))))
            return out.withColumn("prediction", F.col("prediction").cast("int")).drop("_v", "rawPrediction")
        drop = [c for c in ("_v", "rawPrediction") if c in out.columns]
        if "probability" in out.columns and self.classify:
            out = out.withColumn("probability", vector_to_array("probability"))
        return out.withColumn("prediction", F.col("prediction").cast("int") if self.classify else F.col("prediction")).drop(*drop)


def _wrapper(name: str, build, classify: bool) -> type[Wrapped]:
    return type(name, (Wrapped,), {"make": lambda self: build(self.params), "classify": classify, "__doc__": f"{name}: see ``pyspark.ml`` for its parameters."})


def _one_vs_rest(binary):
    """Models that ``pyspark.ml`` has for two classes only."""
    return C.OneVsRest(classifier=binary, parallelism=4)


RandomForestClassifier = _wrapper("RandomForestClassifier", lambda p: C.RandomForestClassifier(seed=1, **p), True)
RandomForestRegressor = _wrapper("RandomForestRegressor", lambda p: R.RandomForestRegressor(seed=1, **p), False)
GradientBoostingClassifier = _wrapper("GradientBoostingClassifier", lambda p: _one_vs_rest(C.GBTClassifier(seed=1, **p)), True)
GradientBoostingRegressor = _wrapper("GradientBoostingRegressor", lambda p: R.GBTRegressor(seed=1, **p), False)
LogisticRegression = _wrapper("LogisticRegression", lambda p: C.LogisticRegression(standardization=False, **p), True)
LinearSVC = _wrapper("LinearSVC", lambda p: _one_vs_rest(C.LinearSVC(standardization=False, **p)), True)


@dataclass
class Tree(Wrapped):
    depth: int = 5
    impurity: str = "gini"
    regress: bool = False

    def make(self):
        if self.regress:
            return R.DecisionTreeRegressor(maxDepth=self.depth, seed=1, **self.params)
        return C.DecisionTreeClassifier(maxDepth=self.depth, impurity=self.impurity, seed=1, **self.params)

    def predict(self, df: DataFrame) -> DataFrame:
        self.classify = not self.regress
        return super().predict(df)


@dataclass
class ExtraTrees(Model):
    """Extremely randomised trees: a node draws one threshold for each of a few features, evenly between the ends its ancestors left, and keeps the best.

    All trees grow together, a level at a time. A level is one pass over the rows in Arrow batches; what comes to the driver are the
    counts (or sums) on both sides of each drawn threshold: trees * 2^depth * candidates * classes numbers at most. Every tree sees all rows. ``weight`` counts rows.
    Nulls go with the small values.
    """

    trees: int = 10
    depth: int = 6
    candidates: int | None = None  # None: the root of the number of features for classes, all of them for numbers
    regress: bool = False
    weight: str | None = None
    seed: int = 1

    def fit(self, df: DataFrame) -> ExtraTrees:
        self.classify = not self.regress
        rng = np.random.default_rng(self.seed)
        d = len(self.features)
        rows = df.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(self.features)], F.col(self.label).cast("double").alias("_y"), (F.col(self.weight).cast("double") if self.weight else F.lit(1.0)).alias("_w")).where("_y is not null").persist()
        try:
            ends = rows.agg(F.count("*").alias("n"), F.max("_y").alias("top"), *[g(f"x{i}").alias(f"{n}{i}") for i in range(d) for n, g in (("lo", F.min), ("hi", F.max))]).first()
            if not ends["n"]:
                raise ValueError("no rows with a label")
            width = 3 if self.regress else int(ends["top"]) + 1
            k = min(d, self.candidates or (d if self.regress else max(1, round(d**0.5))))
            lo, hi = (np.array([0.0 if ends[f"{n}{i}"] is None else ends[f"{n}{i}"] for i in range(d)]) for n in ("lo", "hi"))
            splits = [{} for _ in range(self.trees)]  # node -> (feature, threshold); the children of node i are 2i and 2i + 1
            leaves = [{} for _ in range(self.trees)]
            gains = np.zeros(d)
            boxes = [{1: (lo, hi)} for _ in range(self.trees)]
            for level in range(self.depth):
                drawn = []
                for t in range(self.trees):
                    for node, (a, b) in boxes[t].items():
                        open_ = np.flatnonzero(b > a)
                        chosen = rng.permutation(open_)[:k]
                        cuts = [(int(f), float(rng.uniform(a[f], b[f]))) for f in chosen]
                        drawn.append((t, node, cuts + [(-1, 0.0)] * (k - len(cuts))))
                if not drawn:
                    break
                sums = self._counted(rows, splits, drawn, k, width)
                following = [{} for _ in range(self.trees)]
                for (t, node, cuts), got in zip(drawn, sums):
                    whole = got[0].sum(axis=0)
                    leaves[t][node] = whole
                    best = max(((self._loss(whole) - self._loss(g[0]) - self._loss(g[1]), -i) for i, (g, (f, _)) in enumerate(zip(got, cuts)) if f >= 0 and self._size(g[0]) > 0 and self._size(g[1]) > 0), default=(0.0, 0))
                    if best[0] <= 1e-12 * max(1.0, abs(self._loss(whole))):
                        continue
                    f, cut_at = cuts[-best[1]]
                    gains[f] += best[0]
                    splits[t][node] = (f, cut_at)
                    a, b = boxes[t][node]
                    for side in (0, 1):
                        leaves[t][2 * node + side] = got[-best[1]][side]
                        if level + 1 < self.depth and self._loss(got[-best[1]][side]) > 1e-12:
                            low, high = a.copy(), b.copy()
                            (high if side == 0 else low)[f] = cut_at
                            following[t][2 * node + side] = (low, high)
                boxes = following
        finally:
            rows.unpersist()
        self.state = {"splits": splits, "leaves": leaves, "width": width, "gains": gains / max(gains.sum(), 1e-300)}
        return self

    def importances(self) -> dict[str, float]:
        return dict(zip(self.features, self.state["gains"].tolist()))

    def _size(self, s: np.ndarray) -> float:
        return float(s[0] if self.regress else s.sum())

    def _loss(self, s: np.ndarray) -> float:
        """Rows times their variance, or times the Gini impurity."""
        n = self._size(s)
        if n <= 0:
            return 0.0
        return float(s[2] - s[1] * s[1] / n) if self.regress else float(n - (s * s).sum() / n)

    def _value(self, s: np.ndarray) -> list[float]:
        return [float(s[1] / s[0])] if self.regress else [float(x) for x in s / s.sum()]

    def _counted(self, rows: DataFrame, splits: list[dict], drawn: list, k: int, width: int) -> np.ndarray:
        """[drawn node, candidate, side, class or moment]."""
        regress, d, trees = self.regress, len(self.features), self.trees
        of_tree = [{node: at for at, (t, node, _) in enumerate(drawn) if t == tree} for tree in range(trees)]
        feature = np.array([[f for f, _ in cuts] for _, _, cuts in drawn])
        level_cut = np.array([[c for _, c in cuts] for _, _, cuts in drawn])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(drawn) * k * 2 * width)
            for b in batches:
                if not b.num_rows:
                    continue
                x = np.stack([b[f"x{i}"].to_numpy(zero_copy_only=False).astype(float) for i in range(d)], axis=1)
                y, w = (b[c].to_numpy(zero_copy_only=False).astype(float) for c in ("_y", "_w"))
                for t in range(trees):
                    if not of_tree[t]:
                        continue
                    node = np.ones(len(x), np.int64)
                    for parent, (f, cut_at) in sorted(splits[t].items()):
                        at = node == parent
                        node[at] = 2 * parent + (x[at, f] > cut_at)
                    at = np.array([of_tree[t].get(n, -1) for n in range(int(node.max()) + 1)])[node]
                    live = np.flatnonzero(at >= 0)
                    at = at[live]
                    for c in range(k):
                        side = x[live, feature[at, c]] > level_cut[at, c]
                        key = ((at * k + c) * 2 + side) * width
                        if regress:
                            for m, value in enumerate((w[live], w[live] * y[live], w[live] * y[live] ** 2)):
                                total += np.bincount(key + m, value, len(total))
                        else:
                            total += np.bincount(key + y[live].astype(np.int64), w[live], len(total))
            held = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int64)), pa.array(total[held])], names=["at", "value"])

        out = np.zeros(len(drawn) * k * 2 * width)
        for r in map_arrow(rows, run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("v")).collect():
            out[r["at"]] = r["v"]
        return out.reshape(len(drawn), k, 2, width)

    def _leaf(self, t: int, node: int, ends: list[int]) -> Column:
        if node not in self.state["splits"][t]:
            ends.append(node)
            return F.lit(len(ends) - 1)
        f, cut_at = self.state["splits"][t][node]
        low = self._leaf(t, 2 * node, ends)
        return F.when(F.col(self.features[f]).cast("double") > cut_at, self._leaf(t, 2 * node + 1, ends)).otherwise(low)

    def predict(self, df: DataFrame) -> DataFrame:
        out, votes = df, None
        for t in range(self.trees):
            ends: list[int] = []
            out = out.withColumn(f"_leaf{t}", self._leaf(t, 1, ends))
            values = [self._value(self.state["leaves"][t][e]) for e in ends]
            mine = [F.get(F.lit([v[c] for v in values]), F.col(f"_leaf{t}")) for c in range(len(values[0]))]
            votes = mine if votes is None else [a + b for a, b in zip(votes, mine)]
        gone = [f"_leaf{t}" for t in range(self.trees)]
        if self.regress:
            return out.withColumn("prediction", votes[0] / self.trees).drop(*gone)
        return out.withColumn("prediction", choose(dict(enumerate(votes)))).withColumn("probability", normal(by_class(dict(enumerate(votes))))).drop(*gone)


@dataclass
class AdaBoost(Model):
    """SAMME: trees on reweighted rows, weights as an expression over the rows, never collected."""

    n_estimators: int = 10
    learning_rate: float = 1.0
    depth: int = 1
    weight: str | None = None  # of rows at the start
    undersample: bool = False  # each tree learns from as many rows of each class as the smallest has, on average
    seed: int = 1

    def fit(self, df: DataFrame) -> AdaBoost:
        base = df.select(*self.features, F.col(self.label).cast("int").alias("_y"), (F.col(self.weight) if self.weight else F.lit(1.0)).alias("_w")).where("_y is not null").persist()
        sizes = {r["_y"]: r["count"] for r in base.groupBy("_y").count().collect()}
        k, least = len(sizes), min(sizes.values())
        self.state = {"trees": [], "classes": sorted(sizes)}
        frame = base
        try:
            for i in range(self.n_estimators):
                part = frame.sampleBy("_y", {c: min(1.0, least / n) for c, n in sizes.items()}, seed=self.seed + i) if self.undersample else frame
                tree = Tree(self.features, "_y", depth=self.depth, weight="_w").fit(part)
                seen = tree.predict(frame)
                got = seen.agg(F.sum("_w").alias("w"), F.sum(F.when(F.col("prediction") != F.col("_y"), F.col("_w")).otherwise(0.0)).alias("e")).first()
                error = got["e"] / got["w"]
                if error >= 1 - 1 / k:
                    if not self.state["trees"]:
                        self.state["trees"].append((tree, 1.0))
                    break
                say = self.learning_rate * (log((1 - error) / max(error, 1e-10)) + log(k - 1))
                self.state["trees"].append((tree, say))
                if error <= 1e-10:
                    break
                new = seen.withColumn("_w", F.col("_w") * F.when(F.col("prediction") != F.col("_y"), float(np.exp(say))).otherwise(1.0)).select(*self.features, "_y", "_w").persist()
                new.count()
                frame.unpersist()
                frame = new
        finally:
            frame.unpersist()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        votes: dict[int, Column] = {c: F.lit(0.0) for c in self.state["classes"]}
        out = df
        for i, (tree, say) in enumerate(self.state["trees"]):
            out = tree.predict(out).withColumnRenamed("prediction", f"_p{i}").drop("probability")
            votes = {c: v + F.when(F.col(f"_p{i}") == c, float(say)).otherwise(0.0) for c, v in votes.items()}
        return out.withColumn("prediction", choose(votes)).withColumn("probability", normal(by_class(votes))).drop(*[f"_p{i}" for i in range(len(self.state["trees"]))])


@dataclass
class AdaBoostR2(Model):
    """Boosted regression trees: rows weighted by their relative error, prediction by the weighted median of the trees."""

    n_estimators: int = 10
    learning_rate: float = 1.0
    depth: int = 3
    classify = False

    def fit(self, df: DataFrame) -> AdaBoostR2:
        frame = df.select(*self.features, F.col(self.label).cast("double").alias("_y")).where("_y is not null").withColumn("_w", F.lit(1.0)).persist()
        self.state = {"trees": []}
        try:
            for _ in range(self.n_estimators):
                tree = Tree(self.features, "_y", depth=self.depth, weight="_w", regress=True).fit(frame)
                seen = tree.predict(frame).withColumn("_e", F.abs(F.col("prediction") - F.col("_y")))
                worst = seen.agg(F.max("_e")).first()[0]
                if not worst:
                    self.state["trees"].append((tree, 1.0))
                    break
                loss = seen.agg((F.sum(F.col("_w") * F.col("_e") / worst) / F.sum("_w"))).first()[0]
                if loss >= 0.5:
                    if not self.state["trees"]:
                        self.state["trees"].append((tree, 1.0))
                    break
                beta = loss / (1 - loss)
                self.state["trees"].append((tree, self.learning_rate * log(1 / beta)))
                new = seen.withColumn("_w", F.col("_w") * F.pow(F.lit(beta), (1 - F.col("_e") / worst) * self.learning_rate)).select(*self.features, "_y", "_w").persist()
                new.count()
                frame.unpersist()
                frame = new
        finally:
            frame.unpersist()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        out = df
        for i, (tree, _) in enumerate(self.state["trees"]):
            out = tree.predict(out).withColumnRenamed("prediction", f"_p{i}")
        ordered = F.array_sort(F.array(*[F.struct(F.col(f"_p{i}").alias("p"), F.lit(float(s)).alias("s")) for i, (_, s) in enumerate(self.state["trees"])]))
        half = sum(s for _, s in self.state["trees"]) / 2
        pick = F.aggregate(ordered, F.struct(F.lit(0.0).alias("t"), F.lit(None).cast("double").alias("v")), lambda a, x: F.struct((a["t"] + x["s"]).alias("t"), F.when(a["v"].isNull() & (a["t"] + x["s"] >= half), x["p"]).otherwise(a["v"]).alias("v")), lambda a: a["v"])
        return out.withColumn("prediction", pick).drop(*[f"_p{i}" for i in range(len(self.state["trees"]))])


@dataclass
class BalancedBag(Model):
    """Models on samples that take as many rows of each class as the smallest has, on average; probabilities are averaged.

    ``base`` is "tree", "forest" or "boost": balanced bagging, balanced forests and easy ensembles. Boosting that samples before
    each round is ``RUSBoost``.
    """

    bags: int = 5
    base: str = "tree"
    depth: int = 5
    seed: int = 1

    def fit(self, df: DataFrame) -> BalancedBag:
        counts = {r["_y"]: r["n"] for r in df.select(F.col(self.label).cast("int").alias("_y")).where("_y is not null").groupBy("_y").agg(F.count("*").alias("n")).collect()}
        least = min(counts.values())
        made = []
        frame = df.select(*self.features, F.col(self.label).cast("int").alias("_y")).where("_y is not null").persist()
        try:
            for b in range(self.bags):
                part = frame.sampleBy("_y", {c: min(1.0, least / n) for c, n in counts.items()}, seed=self.seed + b)
                model = {"tree": lambda: Tree(self.features, "_y", depth=self.depth), "forest": lambda: RandomForestClassifier(self.features, "_y", params={"numTrees": 10, "maxDepth": self.depth}), "boost": lambda: AdaBoost(self.features, "_y", n_estimators=5)}[self.base]()
                made.append(model.fit(part))
        finally:
            frame.unpersist()
        self.state = {"models": made, "classes": sorted(counts)}
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        out = df
        votes: dict[int, Column] = {c: F.lit(0.0) for c in self.state["classes"]}
        for i, m in enumerate(self.state["models"]):
            out = m.predict(out).drop("prediction").withColumnRenamed("probability", f"_bag{i}")
            votes = {c: v + F.coalesce(F.get(f"_bag{i}", F.lit(c)), F.lit(0.0)) for c, v in votes.items()}
        return out.withColumn("prediction", choose(votes)).withColumn("probability", normal(by_class(votes))).drop(*[f"_bag{i}" for i in range(len(self.state["models"]))])


def RUSBoost(features: list[str], label: str, n_estimators: int = 10, depth: int = 3, seed: int = 1) -> AdaBoost:
    """Boosting whose trees learn from balanced samples, drawn anew in each round; weights go by all rows."""
    return AdaBoost(features, label, n_estimators=n_estimators, depth=depth, undersample=True, seed=seed)


def _sums(features: list[str], points: np.ndarray, kernel: tuple, planes: list[np.ndarray], targets: list, epsilon: float) -> Callable:
    """(plane, at, value) of each part of the table: loss, gradient and second derivatives of each plane, end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = np.stack([b[f].to_numpy(zero_copy_only=False) for f in features], axis=1).astype(float)
            y, w = (b[c].to_numpy(zero_copy_only=False).astype(float) for c in ("_y", "_w"))
            ok = np.isfinite(x).all(1) & np.isfinite(y)
            z = np.column_stack([kernel_matrix(x[ok], points, *kernel), np.ones(ok.sum())])
            y, w = y[ok], w[ok]
            rows = []
            for v, target in zip(planes, targets):
                f = z @ v
                if target is None:
                    over = np.maximum(np.abs(f - y) - epsilon, 0)
                    slope = 2 * np.sign(f - y) * over
                else:
                    sign = np.where(y == target, 1.0, -1.0)
                    over = np.maximum(1 - sign * f, 0)
                    slope = -2 * sign * over
                active = z[over > 0] * w[over > 0, None]
                rows.append(np.concatenate([[w.sum(), (w * over * over).sum()], z.T @ (w * slope), (2 * active.T @ z[over > 0]).ravel()]))
            total = np.stack(rows) if total is None else total + np.stack(rows)
        if total is not None:
            plane, at = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(plane.ravel().astype(np.int32)), pa.array(at.ravel().astype(np.int32)), pa.array(total.ravel())], names=["plane", "at", "value"])

    return run


@dataclass
class KernelMachine(Model):
    """A kernel machine over landmark features, for classes (squared hinge, one against rest) or numbers (squared loss beyond ``epsilon``).

    Landmarks are a bounded sample of rows. Each Newton step is one pass over the rows in Arrow batches; what comes to the driver are sums
    over n_components squared. The machine is one sum of kernels, so prediction is an expression.
    """

    kernel: str = "rbf"
    C: float = 1.0
    gamma: float = 0.1
    degree: int = 3
    coef0: float = 1.0
    n_components: int = 30
    loss: str = "squared_hinge"
    epsilon: float = 0.1
    steps: int = 20
    weight: str | None = None

    def __post_init__(self) -> None:
        if self.loss not in ("squared_hinge", "squared_epsilon"):
            raise ValueError(f"no loss {self.loss!r}")
        self.classify = self.loss == "squared_hinge"

    def fit(self, df: DataFrame) -> KernelMachine:
        rows = df.select(*[F.col(f).cast("double").alias(f) for f in self.features], F.col(self.label).cast("double").alias("_y"), (F.col(self.weight).cast("double") if self.weight else F.lit(1.0)).alias("_w")).where("_y is not null")
        rows = rows.persist()
        try:
            points = landmark_rows(rows, self.features, self.n_components, 1)
            kernel = (self.kernel, self.gamma, self.degree, self.coef0)
            # the penalty is the norm in the kernel's space
            norm = np.zeros((len(points) + 1, len(points) + 1))
            norm[:-1, :-1] = kernel_matrix(points, points, *kernel)
            classes = sorted(int(r[0]) for r in rows.select("_y").distinct().limit(1001).collect()) if self.classify else []
            if len(classes) > 1000:
                raise ValueError("more than 1,000 classes")
            targets = (classes[1:] if len(classes) == 2 else classes) if self.classify else [None]
            spread = rows.agg(F.stddev_pop("_y"), F.avg("_y")).first()
            scale, centre = (1.0, 0.0) if self.classify else (spread[0] or 1.0, spread[1] or 0.0)
            data = rows if self.classify else rows.withColumn("_y", (F.col("_y") - float(centre)) / float(scale))
            width = len(points) + 1
            planes = [np.zeros(width) for _ in targets]
            best = [np.inf] * len(targets)
            held = [p.copy() for p in planes]
            move = [np.zeros(width) for _ in targets]
            for _ in range(self.steps):
                got = map_arrow(data, _sums(self.features, points, kernel, planes, targets, self.epsilon / scale), "plane int, at int, value double").groupBy("plane", "at").agg(F.sum("value").alias("v")).collect()
                sums = np.zeros((len(targets), 2 + width + width * width))
                for r in got:
                    sums[r["plane"], r["at"]] = r["v"]
                done = True
                for i in range(len(targets)):
                    n, loss, slope, second = sums[i, 0], sums[i, 1], sums[i, 2 : 2 + width], sums[i, 2 + width :].reshape(width, width)
                    if not n:
                        continue
                    lam = 1.0 / (self.C * n)
                    value = loss / n + lam * planes[i] @ norm @ planes[i]
                    if value > best[i] + 1e-12:  # too far: half way back
                        move[i] = move[i] / 2
                        planes[i] = held[i] + move[i]
                        done = done and np.abs(move[i]).max() < 1e-9
                        continue
                    better = best[i] - value
                    best[i], held[i] = value, planes[i]
                    slope = slope / n + 2 * lam * norm @ planes[i]
                    move[i] = -np.linalg.lstsq(second / n + 2 * lam * norm + 1e-9 * np.eye(width), slope, rcond=None)[0]
                    planes[i] = held[i] + move[i]
                    done = done and better < 1e-7 * max(1.0, abs(value))
                if done:
                    break
        finally:
            rows.unpersist()
        self.state = {"points": points, "classes": classes, "planes": {t: (p[:-1] * scale, float(p[-1] * scale + centre)) for t, p in zip(targets, held)}}
        return self

    def margins(self) -> dict:
        k = [kernel_column(self.features, p, self.kernel, self.gamma, self.degree, self.coef0) for p in self.state["points"]]
        return {t: reduce(lambda a, x: a + x, [c * float(w) for c, w in zip(k, ws)], F.lit(b)) for t, (ws, b) in self.state["planes"].items()}

    def predict(self, df: DataFrame) -> DataFrame:
        margins = self.margins()
        if not self.classify:
            return df.withColumn("prediction", margins[None])
        classes = self.state["classes"]
        if len(classes) == 2:
            margins = {classes[0]: -margins[classes[1]], **margins}
        if not margins:
            return df.withColumn("prediction", F.lit(classes[0] if classes else None).cast("int")).withColumn("probability", by_class({classes[0]: F.lit(1.0)}) if classes else F.lit(None).cast("array<double>"))
        return df.withColumn("prediction", choose(margins)).withColumn("probability", normal(by_class({c: 1 / (1 + F.exp(-2 * m)) for c, m in margins.items()})))
