"""Estimators whose fit is one or a few aggregations: LDA, QDA, naive Bayes, ridge, lasso, nearest neighbours."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plumbline.dataset import one_row
from plumbline.operators.generate import EXPRESSIONS, moments, scatter
from plumbline.operators.neighbours import Forest, grown
from plumbline.session import cut, ship


@dataclass
class Model:
    """``features`` are number columns; ``label`` holds class codes from 0 or a number.

    ``predict`` adds ``prediction``, and for classes ``probability``, an array by class code.
    """

    features: list[str]
    label: str
    state: dict = field(default_factory=dict, kw_only=True)
    classify = True

    def fit(self, df: DataFrame) -> Model:
        raise NotImplementedError

    def predict(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


def _dot(cols: list[str], w: np.ndarray, b: float = 0.0) -> Column:
    return reduce(lambda a, c: a + c, [F.col(c).cast("double") * float(x) for c, x in zip(cols, w)], F.lit(float(b)))


def choose(scores: dict[int, Column]) -> Column:
    """The class of the largest score, the smallest of equal ones."""
    best = F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(-c).alias("c")) for c, s in scores.items()]))
    return (-best["c"]).cast("int")


def softmax(scores: dict[int, Column]) -> Column:
    """Shares by class code, from scores on the scale of a logarithm; an array in which classes that were never seen have 0."""
    s = [scores[c] if c in scores else F.lit(None).cast("double") for c in range(max(scores) + 1)]
    return normal(F.transform(F.array(*s), lambda x: F.coalesce(F.exp(x - F.array_max(F.array(*scores.values()))), F.lit(0.0))))


def normal(shares: Column) -> Column:
    """An array of shares, scaled to the sum 1; equal ones where all are 0."""
    total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(shares, lambda x: x / total)).otherwise(F.transform(shares, lambda x: F.lit(1.0) / F.size(shares)))


def by_class(values: dict[int, Column]) -> Column:
    """The values as an array by class code, 0 for classes that aren't among them."""
    return F.array(*[values[c] if c in values else F.lit(0.0) for c in range(max(values) + 1)])


def class_moments(df: DataFrame, features: list[str], label: str) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """class -> (n, mean, population covariance), in one pass."""
    if len(features) > EXPRESSIONS:
        clean = df.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("_y"), *[F.col(c).cast("double").alias(c) for c in features]).na.drop()
        rows = clean.groupBy("_y").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)]).collect()
        mean = {r["_y"]: np.array([r[f"m{i}"] for i in range(len(features))]) for r in rows}
        n = sum(r["n"] for r in rows)
        centre = sum(r["n"] * mean[r["_y"]] for r in rows) / max(n, 1)
        total = scatter(clean, features, centre, "_y")
        return {y: (k, mean[y], total[str(y)] / k - np.outer(mean[y] - centre, mean[y] - centre)) for y, k in sorted((r["_y"], r["n"]) for r in rows)}
    d = len(features)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.col(c).cast("double") for c in features]
    rows = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for r in rows:
        cov = np.zeros((d, d))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"c{i}_{j}"] or 0.0
        out[int(r[label])] = (r["n"], np.array([r[f"m{i}"] or 0.0 for i in range(d)]), cov)
    return dict(sorted(out.items()))


def class_mass(df: DataFrame, label: str, weight: str | None) -> dict[int, float]:
    """class -> mean weight of its rows, 1 without weights; a class's moments times it are weighted ones, for weights that go by class."""
    if not weight:
        return {}
    return {int(r[label]): float(r["w"]) for r in df.where(F.col(label).isNotNull()).groupBy(label).agg(F.avg(weight).alias("w")).collect()}


@dataclass
class LDA(Model):
    """Linear discriminant: pooled covariance, shrunk by ``shrinkage`` toward its mean variance; ``weight`` goes by class."""

    shrinkage: float | None = None
    weight: str | None = None

    def fit(self, df: DataFrame) -> LDA:
        mass = class_mass(df, self.label, self.weight)
        per = {c: (k * mass.get(c, 1), m, v) for c, (k, m, v) in class_moments(df, self.features, self.label).items()}
        n = sum(p[0] for p in per.values())
        pooled = sum(p[0] * p[2] for p in per.values()) / n
        if self.shrinkage:
            pooled = (1 - self.shrinkage) * pooled + self.shrinkage * np.trace(pooled) / len(pooled) * np.eye(len(pooled))
        inverse = np.linalg.pinv(pooled)
        self.state = {c: (inverse @ m, float(-0.5 * m @ inverse @ m + np.log(k / n))) for c, (k, m, _) in per.items()}
        between = sum(k * np.outer(m, m) for k, m, _ in per.values()) / n - np.outer(*[sum(k * m for k, m, _ in per.values()) / n] * 2)
        values, vectors = np.linalg.eig(inverse @ between)
        order = np.argsort(-values.real)[: max(1, len(per) - 1)]
        self.directions = vectors.real[:, order]
        return self

    def scores(self) -> dict[int, Column]:
        return {c: _dot(self.features, w, b) for c, (w, b) in self.state.items()}

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", choose(self.scores())).withColumn("probability", softmax(self.scores()))

    def project(self, df: DataFrame) -> DataFrame:
        """Coordinates along the discriminant directions."""
        return df.select("*", *[_dot(self.features, self.directions[:, k]).alias(f"ld{k}") for k in range(self.directions.shape[1])])


@dataclass
class QDA(Model):
    """Quadratic discriminant: one covariance for each class, mixed with the identity by ``reg``; ``weight`` goes by class."""

    reg: float = 0.0
    weight: str | None = None

    def fit(self, df: DataFrame) -> QDA:
        mass = class_mass(df, self.label, self.weight)
        per = {c: (k * mass.get(c, 1), m, v) for c, (k, m, v) in class_moments(df, self.features, self.label).items()}
        n = sum(p[0] for p in per.values())
        self.state = {}
        for c, (k, m, cov) in per.items():
            cov = (1 - self.reg) * cov + self.reg * np.eye(len(cov))
            values, vectors = np.linalg.eigh(cov)
            values = np.maximum(values, 1e-12)
            self.state[c] = (m, vectors / np.sqrt(values), float(-0.5 * np.log(values).sum() + np.log(k / n)))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        scores = {}
        for c, (m, white, b) in self.state.items():
            parts = [_dot(self.features, white[:, i], float(-m @ white[:, i])) for i in range(white.shape[1])]
            scores[c] = reduce(lambda a, p: a - 0.5 * p * p, parts, F.lit(b))
        return df.withColumn("prediction", choose(scores)).withColumn("probability", softmax(scores))


@dataclass
class GaussianNB(Model):
    smoothing: float = 1e-9
    weight: str | None = None  # goes by class, so it moves the priors only

    def fit(self, df: DataFrame) -> GaussianNB:
        x = [F.col(c).cast("double") for c in self.features]
        rows = df.where(F.col(self.label).isNotNull()).groupBy(self.label).agg(F.count("*").alias("n"), *[g(c).alias(f"{a}{i}") for i, c in enumerate(x) for a, g in (("m", F.avg), ("v", F.var_pop))]).collect()
        widest = one_row(df, {f"{i}": F.var_pop(c) for i, c in enumerate(x)})
        add = self.smoothing * max([v for v in widest.values() if v] or [1.0])
        mass = class_mass(df, self.label, self.weight)
        per = {int(r[self.label]): r["n"] * mass.get(int(r[self.label]), 1) for r in rows}
        n = sum(per.values())
        self.state = {int(r[self.label]): (np.log(per[int(r[self.label])] / n), [(r[f"m{i}"], r[f"v{i}"] + add) for i in range(len(x))]) for r in rows}
        return self

    def scores(self) -> dict[int, Column]:
        return {c: reduce(lambda a, p: a - 0.5 * float(np.log(2 * np.pi * p[1][1])) - (F.col(p[0]) - float(p[1][0])) * (F.col(p[0]) - float(p[1][0])) / float(2 * p[1][1]), zip(self.features, stats), F.lit(float(prior))) for c, (prior, stats) in self.state.items()}

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", choose(self.scores())).withColumn("probability", softmax(self.scores()))


def gram(df: DataFrame, features: list[str], label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
    """(covariance, covariance with the label, means, label mean, n)."""
    if len(features) > EXPRESSIONS:
        mean, second, n = moments(df, [*features, label])
        return second[:-1, :-1], second[:-1, -1], mean[:-1], float(mean[-1]), n
    d = len(features)
    x = [F.col(c).cast("double") for c in features]
    y = F.col(label).cast("double")
    got = one_row(df, {"n": F.count(y), "y": F.avg(y), **{f"m{i}": F.avg(c) for i, c in enumerate(x)}, **{f"y{i}": F.covar_pop(c, y) for i, c in enumerate(x)}, **{f"c{i}_{j}": F.covar_pop(x[i], x[j]) for i in range(d) for j in range(i, d)}})
    cov = np.array([[got[f"c{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)], float)
    return cov, np.array([got[f"y{i}"] for i in range(d)], float), np.array([got[f"m{i}"] for i in range(d)], float), got["y"], got["n"]


@dataclass
class Linear(Model):
    classify = False

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", _dot(self.features, self.state["w"], self.state["b"]))


@dataclass
class Ridge(Linear):
    """min |y - Xw|^2 + alpha |w|^2 with a free intercept, from one pass of covariances."""

    alpha: float = 1.0

    def fit(self, df: DataFrame) -> Ridge:
        cov, with_y, mean, y, n = gram(df, self.features, self.label)
        w = np.linalg.solve(cov * n + self.alpha * np.eye(len(cov)), with_y * n)
        self.state = {"w": w, "b": float(y - mean @ w)}
        return self


@dataclass
class Lasso(Linear):
    """min |y - Xw|^2 / (2n) + alpha |w|_1 with a free intercept, by coordinate descent on the covariances."""

    alpha: float = 1.0

    def fit(self, df: DataFrame) -> Lasso:
        cov, with_y, mean, y, _ = gram(df, self.features, self.label)
        w = np.zeros(len(cov))
        for _ in range(10_000):
            old = w.copy()
            for i in range(len(w)):
                if cov[i, i] > 0:
                    rest = with_y[i] - cov[i] @ w + cov[i, i] * w[i]
                    w[i] = np.sign(rest) * max(abs(rest) - self.alpha, 0) / cov[i, i]
            if np.abs(w - old).max() <= 1e-12 * max(1.0, np.abs(w).max()):
                break
        self.state = {"w": w, "b": float(y - mean @ w)}
        return self


def _numbers(t: pa.Table, cols: list[str]) -> np.ndarray:
    return np.stack([np.asarray(t[c].to_numpy(zero_copy_only=False), np.float64) for c in cols], axis=1) if t.num_rows else np.zeros((0, len(cols)))


#: Columns up to which a k-d tree leaves most rows out, and how many queries and rows a task then takes.
TREE, QUERIES, ROWS = 8, 50_000, 250_000


def _apart(q: np.ndarray, x: np.ndarray, p: int) -> np.ndarray:
    out = np.zeros((len(q), len(x)))
    for j in range(x.shape[1]):
        d = q[:, j, None] - x[None, :, j]
        out += d * d if p == 2 else np.abs(d)
    return out


def close_pairs(q: np.ndarray, x: np.ndarray, k: int, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all rows of ``x`` up to each query's k-th distance, by a k-d tree. Equal rows come in their order, and only the first ``k`` of them."""
    order = np.lexsort(x.T[::-1])
    s = x[order]
    start = np.maximum.accumulate(np.where(np.r_[True, (s[1:] != s[:-1]).any(axis=1)], np.arange(len(s)), 0))
    kept = order[np.arange(len(s)) - start < k]
    s, block = x[kept], max(256, 4 * k)
    tree = Forest([""])
    tree.split(0, s, len(s), block)
    of_rows, of_q = tree.leaves(s, [""] * len(s)), tree.leaves(q, [""] * len(q))
    by_leaf = np.argsort(of_rows, kind="stable")
    ends = np.searchsorted(of_rows[by_leaf], np.arange(len(tree.axis) + 1))
    held = {v: by_leaf[ends[v] : ends[v + 1]] for v in range(len(tree.axis)) if ends[v] < ends[v + 1]}
    d = x.shape[1]
    tree.boxes([{"_b": v, **{f"l{i}": lo for i, lo in enumerate(s[r].min(axis=0))}, **{f"h{i}": hi for i, hi in enumerate(s[r].max(axis=0))}} for v, r in held.items()], d)
    radius = np.full(len(q), np.inf)
    asked = np.argsort(of_q, kind="stable")
    for part in np.split(asked, np.flatnonzero(np.diff(of_q[asked])) + 1):
        r = held.get(int(of_q[part[0]]), []) if len(part) else []
        step = max(1, 2_000_000 // max(1, len(r)))
        for at in range(0, len(part) if len(r) >= k else 0, step):
            radius[part[at : at + step]] = np.partition(_apart(q[part[at : at + step]], s[r], p), k - 1, axis=1)[:, k - 1]
    rr, cc = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    limit = radius * (1 + 1e-9) + 1e-12
    for leaf, rows in tree.reached(q, limit if p == 2 else limit**2, 0):
        step = max(1, 2_000_000 // len(held[leaf]))
        for at in range(0, len(rows), step):
            i, j = np.nonzero(_apart(q[rows[at : at + step]], s[held[leaf]], p) <= limit[rows[at : at + step], None])
            rr.append(rows[at : at + step][i])
            cc.append(kept[held[leaf][j]])
    return np.concatenate(rr), np.concatenate(cc)


def nearest(queries: DataFrame, rows: DataFrame, columns: list[str], key: str, k: int, p: int = 2, carry: str | None = None, block: int | None = None, exclude_self: bool = False) -> DataFrame:
    """The exact ``k`` nearest rows of each query: (query, neighbour, dist, carried), by distance, then key.

    Both sides are dealt into blocks; each pair of blocks is one task, which sends on ``k`` rows per query. Up to ``TREE`` columns it
    searches a k-d tree over its rows; beyond, it looks at every pair. Each query meets each block, so the queries should be a stated,
    small part of the rows; for all against all use an index.
    """
    few = len(columns) <= TREE
    nq, nr = (max(1, -(-df.count() // (block or (many if few else 20_000)))) for df, many in ((queries, QUERIES), (rows, ROWS)))
    names = [f"_x{i}" for i in range(len(columns))]
    pick = lambda df, side: df.select(F.lit(side).alias("_side"), F.col(key).cast("string").alias("_key"), *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names)], (F.col(carry).cast("double") if carry and side else F.lit(None).cast("double")).alias("_c"))
    q = pick(queries, 0).withColumn("_q", F.pmod(F.xxhash64("_key"), F.lit(nq).cast("long"))).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(nr - 1))))
    r = pick(rows, 1).withColumn("_r", F.pmod(F.xxhash64("_key"), F.lit(nr)).cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))))
    key_type = queries.schema[key].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        side = t["_side"].to_numpy()
        key = t["_key"].combine_chunks()
        number = key_type in ("bigint", "int", "smallint", "tinyint")
        ids = key.cast(pa.int64()).to_numpy(zero_copy_only=False) if number else np.array(key.to_pylist(), dtype=object)
        carried = t["_c"].to_numpy(zero_copy_only=False)
        x = _numbers(t, names)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        b = b[np.argsort(ids[b] if number else ids[b].astype(str), kind="stable")]
        one = k + 9 * exclude_self  # a key may stand in several rows
        tree = few and len(names) > 0 and len(b) > max(1024, one) and bool(np.isfinite(x).all())
        at, of, dist = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        step = len(a) if tree else max(1, 4_000_000 // max(1, len(b) * (x.shape[1] if p == 1 else 1)))
        for s in range(0, len(a), max(1, step)):
            part = a[s : s + step]
            if not len(b):
                break
            if tree:
                rr, cc = close_pairs(x[part], x[b], one, p)
            else:
                if p == 1:
                    d = np.abs(x[part][:, None] - x[b][None]).sum(2)
                else:
                    d = np.maximum((x[part] ** 2).sum(1)[:, None] + (x[b] ** 2).sum(1)[None] - 2 * x[part] @ x[b].T, 0)
                want = min(len(b), k + 1 + 8)
                close = np.partition(d, want - 1, axis=1)[:, want - 1]
                rr, cc = np.nonzero(d <= close[:, None] * (1 + 1e-9) + 1e-12)
            exact = ((x[part[rr]] - x[b[cc]]) ** 2).sum(1) if p == 2 else np.abs(x[part[rr]] - x[b[cc]]).sum(1)
            order = np.lexsort((cc, exact, rr))
            rr, cc, exact = rr[order], cc[order], exact[order]
            if exclude_self:
                ok = ids[part[rr]] != ids[b[cc]]
                rr, cc, exact = rr[ok], cc[ok], exact[ok]
            rank = np.arange(len(rr)) - np.searchsorted(rr, rr, "left")
            top = rank < k
            at.append(part[rr[top]])
            of.append(b[cc[top]])
            dist.append(np.sqrt(exact[top]) if p == 2 else exact[top])
        at, of = np.concatenate(at), np.concatenate(of)
        return pa.table({"query": key.take(pa.array(at)), "neighbour": key.take(pa.array(of)), "dist": pa.array(np.concatenate(dist), pa.float64()), "carried": pa.array(carried[of], pa.float64())})

    from pyspark.sql import Window

    ship(queries.sparkSession)
    both = q.select("_q", "_r", "_side", "_key", *names, "_c").unionByName(r.select("_q", "_r", "_side", "_key", *names, "_c"))
    near = both.groupBy("_q", "_r").applyInArrow(run, "query string, neighbour string, dist double, carried double")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("dist", F.col("neighbour").cast(key_type)))).where(F.col("rank") <= k)
    return ranked.select(F.col("query").cast(key_type).alias("query"), F.col("neighbour").cast(key_type).alias("neighbour"), "dist", "carried", "rank")


def nearest_apart(rows: DataFrame, columns: list[str], part: str, key: str, carry: str, block: int = QUERIES) -> DataFrame:
    """(*columns, ``part``, ``carry``): for each distinct point of each part, ``carry`` of the nearest row of any other part, of the smallest key among equally near ones.

    All rows are asked for. ``columns`` are finite numbers, ``part`` is a small code, so a point has few entries. A point that another part
    has too is settled by that; the rest are searched in the blocks of a k-d tree, and again in each other block that the ball to the nearest row found reaches.
    """
    names = [f"_x{i}" for i in range(len(columns))]
    own = rows.select(*[F.col(c).cast("double").alias(n) for c, n in zip(columns, names)], F.col(part).cast("int").alias("_f"), F.col(key).alias("_k"), F.col(carry).cast("int").alias("_c"))
    entries = own.groupBy(*names, "_f").agg(F.min(F.struct("_k", "_c")).alias("e"))
    sites = entries.groupBy(*names).agg(F.collect_list(F.struct("_f", "e._k", "e._c")).alias("at")).select(*names, "at", F.explode("at").alias("e"))
    twin = F.array_min(F.transform(F.filter("at", lambda a: a["_f"] != F.col("e._f")), lambda a: F.struct(a["_k"], a["_c"])))
    points = cut(sites.select(*names, "e._f", "e._k", "e._c", twin.alias("t")).select(*names, "_f", "_k", "_c", F.col("t").isNull().alias("_asked"), F.col("t._c").alias("_found"), F.lit("").alias("_g")))
    answer = [*names, "_f", "_found"]
    forest, placed = grown(points.drop("_found"), names, block, names)
    cells = cut(placed)
    kind = {f.name: f for f in cells.schema.fields}
    wide = StructType([*[kind[c] for c in (*names, "_f", "_b")], StructField("_d", DoubleType())])
    short = StructType([*[kind[c] for c in (*names, "_f")], StructField("_d", DoubleType()), StructField("_k", kind["_k"].dataType), StructField("_c", kind["_c"].dataType)])
    both = StructType([*short.fields, kind["_b"]])

    def searched(q: pa.Table, t: pa.Table) -> pa.Table:
        at, x, mine = _numbers(q, names), _numbers(t, names), q["_f"].to_numpy()
        order = pc.sort_indices(t["_k"].combine_chunks(), null_placement="at_start").to_numpy()
        of = t["_f"].to_numpy()[order]
        dist, who = np.full(len(at), np.inf), np.full(len(at), -1, np.int64)
        for f in np.unique(mine):
            a, b = np.flatnonzero(mine == f), order[of != f]
            if not len(b):
                continue
            rr, cc = close_pairs(at[a], x[b], 1, 2)
            exact = ((at[a[rr]] - x[b[cc]]) ** 2).sum(1)
            by = np.lexsort((cc, exact, rr))
            rr, first = np.unique(rr[by], return_index=True)
            dist[a[rr]], who[a[rr]] = exact[by[first]], b[cc[by[first]]]
        take = pa.array(who, mask=who < 0)
        return pa.table({**{c: q[c] for c in (*names, "_f")}, "_d": pa.array(dist), "_k": t["_k"].take(take), "_c": t["_c"].take(take)})

    def inner(t: pa.Table) -> pa.Table:
        q = t.filter(t["_asked"])
        return searched(q, t).append_column("_b", q["_b"])

    def across(batches):
        for b in batches:
            x, home, d = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1), b.column("_b").to_numpy(), b.column("_d").to_numpy()
            for leaf, hit in forest.reached(x, d, forest.root.get("", 0)):
                hit = hit[home[hit] != leaf]
                if len(hit):
                    yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(hit)) for c in (*names, "_f")], pa.array(np.full(len(hit), leaf), pa.int64()), b.column("_d").take(pa.array(hit))], names=[*names, "_f", "_b", "_d"])

    inside = cut(cells.groupBy("_b").applyInArrow(inner, both))
    beyond = inside.select(*names, "_f", "_b", "_d").mapInArrow(across, wide)
    outside = beyond.groupBy("_b").cogroup(cells.groupBy("_b")).applyInArrow(searched, short)
    nearest_of = inside.drop("_b").unionByName(outside).groupBy(*names, "_f").agg(F.min(F.struct("_d", "_k", "_c"))["_c"].alias("_found"))
    out = points.where("not _asked").select(answer).unionByName(nearest_of.select(answer))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, columns)], F.col("_f").alias(part), F.col("_found").alias(carry))


@dataclass
class NearestNeighbours(Model):
    """Votes or means of the k nearest fitted rows; ``weights`` uniform or distance; ``p`` 1 or 2."""

    key: str = "id"
    k: int = 1
    weights: str = "uniform"
    p: int = 2
    regress: bool = False

    def fit(self, df: DataFrame) -> NearestNeighbours:
        rows = df.select(self.key, self.label, *self.features).where(F.col(self.label).isNotNull())
        self.state = {"rows": rows, "top": None if self.regress else int(rows.agg(F.max(self.label)).first()[0] or 0)}
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        near = nearest(df, self.state["rows"], self.features, self.key, self.k, self.p, self.label)
        w = F.lit(1.0) if self.weights == "uniform" else F.when(F.col("dist") == 0, 1e12).otherwise(1 / F.col("dist"))
        near = near.withColumn("w", w)
        if self.regress:
            out = near.groupBy("query").agg((F.sum(F.col("w") * F.col("carried")) / F.sum("w")).alias("prediction"))
        else:
            votes = near.groupBy("query", F.col("carried").cast("int").alias("carried")).agg(F.sum("w").alias("v"))
            found = votes.groupBy("query").agg(F.max(F.struct("v", (-F.col("carried")).alias("c"))).alias("b"), F.map_from_entries(F.collect_list(F.struct("carried", "v"))).alias("m"), F.sum("v").alias("t"))
            shares = F.transform(F.sequence(F.lit(0), F.lit(self.state["top"])), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0.0)) / F.col("t"))
            out = found.select("query", (-F.col("b.c")).cast("int").alias("prediction"), shares.alias("probability"))
        return df.join(out.withColumnRenamed("query", "_query"), F.col(self.key) == F.col("_query"), "left").drop("_query")


@dataclass
class Margin(Model):
    """Linear machines by accelerated gradient steps, each one aggregate over the data: hinge, squared hinge or logistic
    loss for classes (one against rest), epsilon-insensitive for numbers; L1 or L2 penalty."""

    C: float = 1.0
    loss: str = "squared_hinge"
    penalty: str = "l2"
    epsilon: float = 0.1
    steps: int = 60
    weight: str | None = None  # of rows, 1 on average

    def __post_init__(self) -> None:
        self.regress = self.loss.startswith("epsilon") or self.loss.startswith("squared_epsilon")

    def _solve(self, df: DataFrame, y: Column, mean: np.ndarray, scale: np.ndarray, n: int) -> tuple[np.ndarray, float]:
        d = len(self.features)
        z = [(F.col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(self.features, mean, scale)]
        w, b, vw, vb = np.zeros(d), 0.0, np.zeros(d), 0.0
        rate = 1.0 / ((d + 1) * (0.25 if self.loss == "logistic" else 2.0 if "squared" in self.loss else 1.0))
        lam = 1.0 / (self.C * n)
        for t in range(self.steps):
            f = reduce(lambda a, c: a + c, [zi * float(x) for zi, x in zip(z, vw)], F.lit(float(vb)))
            if self.regress:
                r = f - y
                g = F.when(F.abs(r) <= self.epsilon, 0.0).otherwise(F.signum(r) * (2 * (F.abs(r) - self.epsilon) if "squared" in self.loss else 1.0))
            else:
                m = y * f
                g = -y / (1 + F.exp(m)) if self.loss == "logistic" else F.when(m >= 1, 0.0).otherwise(-y * (2 * (1 - m) if self.loss == "squared_hinge" else 1.0))
            g = g * F.col(self.weight) if self.weight else g
            got = one_row(df, {"b": F.avg(g), **{f"{i}": F.avg(g * zi) for i, zi in enumerate(z)}})
            step = rate if ("squared" in self.loss or self.loss == "logistic") else 1.0 / (1 + t)
            grad = np.array([got[f"{i}"] or 0.0 for i in range(d)])
            new = vw - step * (grad + (lam * vw if self.penalty == "l2" else 0))
            if self.penalty == "l1":
                new = np.sign(new) * np.maximum(np.abs(new) - step * lam, 0)
            nb = vb - step * (got["b"] or 0.0)
            move = t / (t + 3) if ("squared" in self.loss or self.loss == "logistic") else 0.0
            vw, vb = new + move * (new - w), nb + move * (nb - b)
            done = np.abs(new - w).max() < 1e-7 and t > 5
            w, b = new, nb
            if done:
                break
        return w / scale, float(b - (w / scale) @ mean)

    def fit(self, df: DataFrame) -> Margin:
        x = {f"{a}{i}": g(F.col(c).cast("double")) for i, c in enumerate(self.features) for a, g in (("m", F.avg), ("s", F.stddev_pop))}
        got = one_row(df, {"n": F.count(F.lit(1)), "ys": F.stddev_pop(F.col(self.label).cast("double")), "ym": F.avg(F.col(self.label).cast("double")), **x})
        d = len(self.features)
        mean, scale = np.array([got[f"m{i}"] for i in range(d)]), np.array([got[f"s{i}"] or 1.0 for i in range(d)])
        frame = df.select(*self.features, self.label, *([self.weight] if self.weight else [])).persist()
        try:
            if self.regress:
                ys = got["ys"] or 1.0
                keep, self.epsilon = self.epsilon, self.epsilon / ys
                w, b = self._solve(frame, (F.col(self.label).cast("double") - got["ym"]) / ys, mean, scale, got["n"])
                self.epsilon = keep
                self.state = {"w": w * ys, "b": b * ys + got["ym"]}
            else:
                classes = sorted(int(r[0]) for r in frame.select(self.label).distinct().collect() if r[0] is not None)
                ones = classes[1:] if len(classes) == 2 else classes
                self.state = {"classes": classes, "planes": {c: self._solve(frame, F.when(F.col(self.label) == c, 1.0).otherwise(-1.0), mean, scale, got["n"]) for c in ones}}
        finally:
            frame.unpersist()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        if self.regress:
            return df.withColumn("prediction", _dot(self.features, self.state["w"], self.state["b"]))
        planes = {c: _dot(self.features, w, b) for c, (w, b) in self.state["planes"].items()}
        if len(self.state["classes"]) == 2:
            no, yes = self.state["classes"]
            planes = {no: -planes[yes], yes: planes[yes]}
        return df.withColumn("prediction", choose(planes)).withColumn("probability", normal(by_class({c: 1 / (1 + F.exp(-2 * m)) for c, m in planes.items()})))
