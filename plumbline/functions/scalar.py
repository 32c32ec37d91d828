"""Scalar functions on features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log(c: Column) -> Column:
    return F.ln(F.abs(c) + 1e-8)


def sqrt(c: Column) -> Column:
    return F.sqrt(F.abs(c))


def square(c: Column) -> Column:
    return c * c


def round_even(c: Column) -> Column:
    """Halves go to the even neighbour."""
    return F.bround(c, 0)


def tanh(c: Column) -> Column:
    return F.tanh(c)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


UNARY = {"log": log, "sqrt": sqrt, "square": square, "round": round_even, "tanh": tanh, "sigmoid": sigmoid}
BINARY = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),  # null on a zero divisor
}


def softmax(scores: list[Column]) -> list[Column]:
    """Probabilities of classes from their scores, shifted by the largest score."""
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    powers = [F.exp(s - top) for s in scores]
    total = reduce(lambda a, b: a + b, powers)
    return [p / total for p in powers]


def binary_softmax(score: Column) -> Column:
    """The probability of the second class: a sigmoid of the clipped score, snapped to 0 and 1 at the ends."""
    p = 1 / (1 + F.exp(-F.least(F.lit(20.0), F.greatest(F.lit(-20.0), score))))
    return F.when(p > 1 - 1e-6, 1.0).when(p < 1e-7, 0.0).otherwise(p)


#: Fixed value: the characters that separate words, beside white space.
SEPARATORS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n"


def text_tokens(c: Column) -> Column:
    """Lower-case words between separators; null gives null."""
    spaced = F.translate(F.lower(c), SEPARATORS, " " * len(SEPARATORS))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def with_frequency(df: DataFrame, column: str, fitted: DataFrame | None = None, out: str = "freq") -> DataFrame:
    """Relative frequency of each value in ``fitted``; values unseen there get 1 / n.

    The counts are joined by hash, so the number of distinct values doesn't matter.
    """
    base = fitted if fitted is not None else df
    counts = base.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    n = base.count()
    return df.join(counts, df[column].eqNullSafe(F.col("_v")), "left").select(*df.columns, (F.coalesce(F.col("_c"), F.lit(1)) / F.lit(n)).alias(out))


def with_running_max(df: DataFrame, value: str, order: Column, key: str, group: str, out: str = "best") -> DataFrame:
    """The largest value so far in each group, in the order of ``order`` (a number), then ``key``.

    A group may hold a third of all rows: the maximum runs inside ranges of the order, and each range starts with the largest value of
    the ranges before it. The ranges are 1/256 of each group's span of the order.
    """
    span = df.groupBy(F.col(group).alias("_g")).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    placed = df.join(span, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    block = F.when(F.col("_hi") > F.col("_lo"), F.floor((order - F.col("_lo")) * 256.0 / (F.col("_hi") - F.col("_lo")))).otherwise(0)
    placed = placed.withColumn("_b", F.coalesce(block, F.lit(-1))).withColumn("_o", order).drop("_lo", "_hi")
    tops = placed.groupBy(F.col(group).alias("_g"), F.col("_b").alias("_k")).agg(F.max(value).alias("_m"))
    tops = tops.select("_g", "_k", F.max("_m").over(Window.partitionBy("_g").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inner = Window.partitionBy(group, "_b").orderBy(F.col("_o").asc_nulls_first(), key).rowsBetween(Window.unboundedPreceding, 0)
    run = placed.withColumn("_run", F.max(value).over(inner))
    joined = run.join(tops, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_k")))
    return joined.withColumn(out, F.greatest("_run", "_before")).drop("_g", "_b", "_k", "_o", "_run", "_before")
