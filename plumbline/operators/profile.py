"""Dataset meta-features: counts, missing values, class shares, symbols, shapes of distributions, landmarks."""

from __future__ import annotations

from math import inf, log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.dataset import CATEGORICAL, NUMBERS, Chain, Dataset, one_row
from plumbline.operators.clean import Impute, OneHot
from plumbline.operators.generate import _signed, linear, moments
from plumbline.operators.scale import Standard
from plumbline.session import cut


def missing(c: str, number: bool) -> Column:
    x = F.col(c).cast("double")
    return F.col(c).isNull() | (F.isnan(x) | (F.abs(x) == inf) if number else F.lit(False))


def _spread(values: list[float], name: str) -> dict[str, float]:
    v = np.array([x for x in values if x is not None and x == x], float)
    if not len(v):
        return {f"{name}{s}": 0.0 for s in ("Min", "Max", "Mean", "STD")}
    return {f"{name}Min": float(v.min()), f"{name}Max": float(v.max()), f"{name}Mean": float(v.mean()), f"{name}STD": float(v.std())}


def simple_features(ds: Dataset, classify: bool = True) -> dict[str, float]:
    """Everything that one pass over the rows (and one count of classes) gives."""
    numbers = [f for f in ds.features if ds.kinds[f] in NUMBERS]
    symbols = [f for f in ds.features if ds.kinds[f] == CATEGORICAL]
    # cells are judged once, in a projection: the moments repeat their argument many times
    gaps = [missing(f, f in numbers) for f in ds.features]
    any_gap = gaps[0] if gaps else F.lit(False)
    for g in gaps[1:]:
        any_gap = any_gap | g
    clean = ds.df.select(any_gap.alias("row"), *[g.alias(f"g{i}") for i, g in enumerate(gaps)], *[F.when(~missing(f, True), F.col(f).cast("double")).alias(f"x{i}") for i, f in enumerate(numbers)])
    exprs = {"n": F.count(F.lit(1)), "rows": F.count_if("row"), **{f"m{i}": F.count_if(f"g{i}") for i in range(len(gaps))}}
    for i, f in enumerate(numbers):
        exprs[f"k|{f}"], exprs[f"w|{f}"] = F.kurtosis(f"x{i}"), F.skewness(f"x{i}")
    got = one_row(clean, exprs)
    # apart from the rest: a distinct count makes Spark expand every row
    got |= one_row(ds.df, {f"s|{f}": F.count_distinct(f) for f in symbols})
    n, d = got["n"], len(ds.features)
    holes = [got[f"m{i}"] or 0 for i in range(d)]
    ln = lambda x: log(x) if x > 0 else -inf
    out: dict[str, float] = {
        "NumberOfInstances": n, "LogNumberOfInstances": ln(n), "NumberOfFeatures": d, "LogNumberOfFeatures": ln(d),
        "NumberOfInstancesWithMissingValues": got["rows"] or 0, "PercentageOfInstancesWithMissingValues": (got["rows"] or 0) / n if n else 0.0,
        "NumberOfFeaturesWithMissingValues": sum(h > 0 for h in holes), "PercentageOfFeaturesWithMissingValues": sum(h > 0 for h in holes) / d if d else 0.0,
        "NumberOfMissingValues": sum(holes), "PercentageOfMissingValues": sum(holes) / (n * d) if n and d else 0.0,
        "NumberOfNumericFeatures": len(numbers), "NumberOfCategoricalFeatures": len(symbols),
        "RatioNumericalToNominal": len(numbers) / len(symbols) if symbols else 0.0, "RatioNominalToNumerical": len(symbols) / len(numbers) if numbers else 0.0,
        "DatasetRatio": d / n if n else 0.0, "LogDatasetRatio": ln(d / n) if n and d else -inf,
        "InverseDatasetRatio": n / d if d else 0.0, "LogInverseDatasetRatio": ln(n / d) if d else -inf,
    }
    counts = [got[f"s|{f}"] for f in symbols]
    out |= _spread([c for c in counts if c > 0], "Symbols") | {"SymbolsSum": float(sum(counts))}
    out |= _spread([got[f"k|{f}"] for f in numbers], "Kurtosis") | _spread([got[f"w|{f}"] for f in numbers], "Skewness")
    if classify and ds.label:
        per = [r["n"] for r in ds.df.where(F.col(ds.label).isNotNull()).groupBy(ds.label).agg(F.count("*").alias("n")).collect()]
        p = np.array(per, float) / max(sum(per), 1)
        out |= {"NumberOfClasses": len(per), **_spread(list(p), "ClassProbability"), "ClassEntropy": float(-(p * np.log2(p)).sum())}
    return out


def prepared(ds: Dataset) -> Dataset:
    """Mode-imputed, one-hot, standardised: what the projections and landmarks look at."""
    return Chain(Impute(strategy="mode"), OneHot(), Standard()).fit_transform(ds)


def pca_features(ds: Dataset) -> dict[str, float]:
    """Share of components for 95 % of the variance, and the shape of the first."""
    p = prepared(ds)
    cols = p.of_kind(*NUMBERS)
    mean, cov, _ = moments(p.df, cols)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0), _signed(vectors[:, ::-1])
    k = int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), 0.95) + 1)
    first = linear(cols, vectors[:, 0], mean)
    got = one_row(p.df, {"k": F.kurtosis(first), "s": F.skewness(first)})
    return {"PCAFractionOfComponentsFor95PercentVariance": min(k, len(cols)) / len(cols), "PCAKurtosisFirstPC": got["k"], "PCASkewnessFirstPC": got["s"]}


def landmarks(ds: Dataset, key: str, k: int = 5, legacy_scale: bool = False) -> dict[str, float]:
    """Cross-validated accuracy of simple learners: LDA, naive Bayes, trees, stumps, nearest neighbour.

    All of them learn from all rows outside a fold and are tested on all rows of it. Trees look for thresholds between all values.
    """
    from plumbline.models.cart import Cart, grow, right
    from plumbline.models.classic import LDA, GaussianNB, nearest_apart
    from plumbline.operators.clean import encode_labels
    from plumbline.operators.split import folds

    p = prepared(ds)
    cols = p.of_kind(*NUMBERS)
    xs = [f"_x{i}" for i in range(len(cols))]
    frame = encode_labels(folds(p.df, key, k, ds.label), ds.label, "_y").where("_y is not null").persist()
    makers = {"LandmarkLDA": lambda: LDA(cols, "_y"), "LandmarkNaiveBayes": lambda: GaussianNB(cols, "_y")}
    out = {}
    try:
        for name, make in makers.items():
            total = 0.0
            for f in range(k):
                model = make().fit(frame.where(F.col("fold") != f))
                got = model.predict(frame.where(F.col("fold") == f)).agg(F.avg((F.col("prediction") == F.col("_y")).cast("double"))).first()[0]
                total += got or 0.0
            out[name] = total / k
        # equal rows of a fold and class are one cell
        numbers = [F.col(c).cast("double").alias(x) for c, x in zip(cols, xs)]
        cells = cut(frame.select(*numbers, F.col("fold").alias("_f"), "_y", F.col(key).alias("_k")).groupBy(*xs, "_f", "_y").agg(F.count("*").alias("_n"), F.min("_k").alias("_k")))
    finally:
        frame.unpersist()
    sizes = {r["_f"]: r["n"] for r in cells.groupBy("_f").agg(F.sum("_n").alias("n")).collect()}
    near = nearest_apart(cells, xs, "_f", "_k", "_y").withColumnRenamed("_y", "_said")
    hits = {r["_f"]: r["n"] for r in cells.join(near, [*xs, "_f"]).where("_said = _y").groupBy("_f").agg(F.sum("_n").alias("n")).collect()}
    trees = {"LandmarkDecisionTree": (len(cols), 10, True), "LandmarkDecisionNodeLearner": (len(cols), 1, False), "LandmarkRandomNodeLearner": (1, 1, False)}
    if len(cols) == 1:  # the same learner on the same column
        trees.pop("LandmarkRandomNodeLearner")
    grown = [Cart(f, d, depth, gini) for d, depth, gini in trees.values() for f in range(k)]
    grow(cells, xs, grown)
    good = right(cells, xs, grown)
    share = lambda n, f: n / sizes[f] if sizes.get(f) else 0.0
    out["Landmark1NN"] = sum(share(hits.get(f, 0), f) for f in range(k)) / k
    for i, name in enumerate(trees):
        out[name] = sum(share(n, f) for f, n in enumerate(good[i * k : i * k + k])) / k
    out.setdefault("LandmarkRandomNodeLearner", out["LandmarkDecisionNodeLearner"])
    return {name: v * (0.5 if legacy_scale else 1) for name, v in out.items()}


def as_frame(df: DataFrame, features: dict[str, float]) -> DataFrame:
    """One row for each meta-feature."""
    return df.sparkSession.createDataFrame([(k, float(v) if v is not None else None) for k, v in features.items()], "feature string, value double")
