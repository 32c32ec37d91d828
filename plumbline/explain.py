"""What a fitted model or pipeline looks at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.dataset import Dataset
from plumbline.models.classic import Margin, Ridge
from plumbline.operators.generate import importances
from plumbline.operators.select import linear_weights


def correlations(df: DataFrame, originals: list[str], others: list[str]) -> DataFrame:
    """(original, other, corr) of every original with every other column, from one pass."""
    pairs = [(a, b) for a in originals for b in others]
    row = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("original"), F.lit(b).alias("other"), F.col(f"{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")


def _frame(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.sparkSession.createDataFrame([(k, float(v)) for k, v in values.items()], "feature string, value double")


def tree_importance(df: DataFrame, features: list[str], label: str, classify: bool = True) -> DataFrame:
    return _frame(df, importances(Dataset.of(df, features, label), features, classify))


def linear_importance(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Sizes of the weights of a linear model, each times the deviation of its column."""
    w = linear_weights(Dataset.of(df, features, label), features, reg=0.001, l1=0.0)
    sd = df.agg(*[F.stddev_pop(f).alias(f) for f in features]).first()
    return _frame(df, {f: w[f] * (sd[f] or 0.0) for f in features})


def linear_impact(df: DataFrame, features: list[str], label: str, classify: bool = True, alpha: float = 1.0) -> DataFrame:
    """Signed weights of a linear model, each times the deviation of its column: for numbers of ridge regression, for two classes of a logistic machine towards the second."""
    model = (Margin(features, label, loss="logistic") if classify else Ridge(features, label, alpha=alpha)).fit(df)
    if classify and len(model.state["classes"]) != 2:
        raise ValueError("signs need two classes")
    w = next(iter(model.state["planes"].values()))[0] if classify else model.state["w"]
    sd = df.agg(*[F.stddev_pop(f).alias(f) for f in features]).first()
    return _frame(df, {f: float(x) * (sd[f] or 0.0) for f, x in zip(features, w)})


def origin(ds: Dataset) -> DataFrame:
    """The steps that a dataset went through, in order."""
    return ds.df.sparkSession.createDataFrame(list(enumerate(ds.history)), "step int, operator string")
