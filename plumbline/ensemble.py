"""Ensembles over a long table (row_id, model_id, label, prob) of validation predictions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.dataset import one_row
from plumbline.models.classic import Model, Ridge
from plumbline.operators.generate import agglomerate
from plumbline.operators.split import folds


def bagging(predictions: DataFrame) -> DataFrame:
    """The mean of all members."""
    return predictions.groupBy("row_id").agg(F.avg("prob").alias("prob"))


def weighted(predictions: DataFrame, weights: dict[int, float]) -> DataFrame:
    w = F.coalesce(reduce(lambda a, m: F.when(F.col("model_id") == m, float(weights[m])).otherwise(a), weights, F.lit(None).cast("double")), F.lit(0.0))
    return predictions.groupBy("row_id").agg(F.sum(F.col("prob") * w).alias("prob"))


def second_moments(predictions: DataFrame) -> tuple[list[int], np.ndarray, np.ndarray, float]:
    """(models, mean of p_i p_j, mean of p_i y, mean of y^2): all that squared-error selection needs, from one pass over the wide table."""
    models = sorted(r[0] for r in predictions.select("model_id").distinct().collect())
    wide = predictions.groupBy("row_id").agg(F.max("label").cast("double").alias("y"), *[F.max(F.when(F.col("model_id") == m, F.col("prob"))).alias(f"p{m}") for m in models])
    k = len(models)
    got = one_row(wide, {"yy": F.avg(F.col("y") * F.col("y")), **{f"y{i}": F.avg(F.col("y") * F.col(f"p{m}")) for i, m in enumerate(models)}, **{f"{i}_{j}": F.avg(F.col(f"p{models[i]}") * F.col(f"p{models[j]}")) for i in range(k) for j in range(i, k)}})
    pp = np.array([[got[f"{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    return models, pp, np.array([got[f"y{i}"] for i in range(k)]), got["yy"]


def greedy_selection(predictions: DataFrame, size: int = 50) -> dict[int, float]:
    """Greedy selection with replacement by squared error: weights of the members; equal candidates by the smaller id.

    The data are read once; every step works on the matrix of second moments.
    """
    models, pp, py, yy = second_moments(predictions)
    counts = np.zeros(len(models))
    best, best_counts = np.inf, counts
    for step in range(1, size + 1):
        errors = []
        for i in range(len(models)):
            w = (counts + np.eye(len(models))[i]) / step
            errors.append(float(w @ pp @ w - 2 * w @ py + yy))
        i = int(np.argmin(np.round(errors, 15)))
        counts = counts + np.eye(len(models))[i]
        if errors[i] < best - 1e-15:
            best, best_counts = errors[i], counts
    return {m: float(c / best_counts.sum()) for m, c in zip(models, best_counts) if c}


def _wide(predictions: DataFrame, models: list[int], label: bool) -> DataFrame:
    parts = [F.max(F.when(F.col("model_id") == m, F.col("prob"))).alias(f"p{m}") for m in models]
    return predictions.groupBy("row_id").agg(*([F.max("label").cast("double").alias("y")] if label else []), *parts)


def fit_meta(predictions: DataFrame, share: float = 1.0) -> tuple[list[int], Model]:
    """(models, a linear model over their predictions), fitted on a hashed share of the rows."""
    models = sorted(r[0] for r in predictions.select("model_id").distinct().collect())
    train = _wide(predictions, models, True).where(F.pmod(F.xxhash64("row_id"), F.lit(1000)) < int(share * 1000))
    return models, Ridge([f"p{m}" for m in models], "y", alpha=1.0).fit(train)


def apply_meta(meta: tuple[list[int], Model], predictions: DataFrame, clip: bool = True) -> DataFrame:
    out = meta[1].predict(_wide(predictions, meta[0], False))
    return out.select("row_id", (F.greatest(F.lit(0.0), F.least(F.lit(1.0), "prediction")) if clip else F.col("prediction")).alias("prob"))


def blend(predictions: DataFrame, share: float = 0.8) -> DataFrame:
    """A linear model over the members' predictions, fitted on a hashed share of the rows, clipped to [0, 1]."""
    return apply_meta(fit_meta(predictions, share), predictions)


def stack(df: DataFrame, key: str, features: list[str], label: str, makers: list[Callable[[], Model]], k: int = 5) -> DataFrame:
    """Members fitted on each k - 1 folds predict the fold left out; a linear model over those predictions decides for two classes."""
    parts = folds(df, key, k).persist()
    try:
        rows = None
        for f in range(k):
            train, test = parts.where(F.col("fold") != f), parts.where(F.col("fold") == f)
            out = test
            for i, make in enumerate(makers):
                out = make().fit(train).predict(out).withColumnRenamed("prediction", f"_m{i}")
            rows = out if rows is None else rows.unionByName(out)
        cols = [f"_m{i}" for i in range(len(makers))]
        meta = Ridge(cols, "_y", alpha=1.0).fit(rows.withColumn("_y", F.col(label).cast("double")))
        scored = meta.predict(rows)
        return scored.withColumn("prediction", (F.col("prediction") > 0.5).cast("int")).drop(*cols, "fold")
    finally:
        parts.unpersist()


def sign_distances(predictions: DataFrame) -> DataFrame:
    """(a, b, distance): the share of rows on which two members decide differently. Counted on the wide table, so rows are read once and never paired."""
    models = sorted(r[0] for r in predictions.select("model_id").distinct().collect())
    wide = predictions.groupBy("row_id").agg(*[F.max(F.when(F.col("model_id") == m, F.col("prob") > 0.5)).alias(f"s{m}") for m in models])
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    row = wide.agg(*[F.avg((F.col(f"s{a}") != F.col(f"s{b}")).cast("double")).alias(f"{a}_{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}").alias("distance")) for a, b in pairs])).alias("r")).select("r.*")


def diverse_members(predictions: DataFrame, n: int, bins: int = 20) -> list[int]:
    """``n`` members that differ: histograms of their probabilities, clustered, and of each cluster the one nearest to its centre."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("prob") * bins))
    rows = predictions.groupBy("model_id", "label", b.alias("b")).agg(F.count("*").alias("n")).collect()
    models = sorted({r["model_id"] for r in rows})
    labels = sorted({r["label"] for r in rows})
    h = np.zeros((len(models), len(labels), bins))
    for r in rows:
        h[models.index(r["model_id"]), labels.index(r["label"]), int(r["b"])] = r["n"]
    h = (h / np.maximum(h.sum(2, keepdims=True), 1)).reshape(len(models), -1)
    groups = agglomerate(np.linalg.norm(h[:, None] - h[None], axis=2), min(n, len(models)), "complete")
    return sorted(models[min(g, key=lambda i: (float(np.linalg.norm(h[i] - h[g].mean(axis=0))), i))] for g in groups)


def accuracy_odds(predictions: DataFrame) -> dict[int, float]:
    """Log-odds of each member's accuracy."""
    acc = predictions.groupBy("model_id").agg(F.avg(((F.col("prob") > 0.5).cast("int") == F.col("label")).cast("double")).alias("a"))
    return {r["model_id"]: float(np.log(max(r["a"], 1e-6) / max(1 - r["a"], 1e-6))) for r in acc.collect()}


def confidence_weighted(predictions: DataFrame, odds: dict[int, float] | None = None) -> DataFrame:
    """Members weighted by the log-odds of their accuracy, here or as given, and, row by row, by how certain they are."""
    odds = accuracy_odds(predictions) if odds is None else odds
    base = reduce(lambda a, m: F.when(F.col("model_id") == m, max(odds[m], 1e-6)).otherwise(a), odds, F.lit(0.0))
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), "prob"))
    certain = 1 + (p * F.log2(p) + (1 - p) * F.log2(1 - p)) + 1e-9
    return predictions.groupBy("row_id").agg((F.sum(F.col("prob") * base * certain) / F.sum(base * certain)).alias("prob"))


def count_weights(chosen: list[int]) -> dict[int, float]:
    return {m: c / len(chosen) for m, c in Counter(chosen).items()}
