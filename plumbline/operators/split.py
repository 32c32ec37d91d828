"""Splits and folds. Rows are ordered by a hash of their key, so a split never depends on row order or engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: str) -> list[Column]:
    return [F.md5(F.col(key).cast("string")), F.col(key)]


def _ranked(df: DataFrame, key: str, by: str | None, ranges: int = 64) -> DataFrame:
    """``df`` with _rank from 1 in hash order, and _n, in each value of ``by``, or over all rows.

    The first byte of the hash cuts the rows into ``ranges`` ranges that are ranked apart and moved by
    the sizes of the ranges before, so neither all rows nor a large class stand in one task.
    """
    h = F.md5(F.col(key).cast("string"))
    cut = df.withColumn("_h", h).withColumn("_p", F.floor(F.conv(F.substring("_h", 1, 2), 16, 10).cast("int") * ranges / 256))
    part = ["_p", *([by] if by else [])]
    sizes = cut.groupBy(*part).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*([by] if by else [F.lit(0)]))
    sizes = sizes.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(part)], F.coalesce(F.sum("_c").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(w).alias("_n"))
    inner = cut.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy("_h", key)))
    on = [inner[c].eqNullSafe(sizes[f"_k{i}"]) for i, c in enumerate(part)]
    return inner.join(sizes, on).withColumn("_rank", F.col("_r") + F.col("_before")).drop("_h", "_p", "_r", "_before", *[f"_k{i}" for i in range(len(part))])


def holdout(df: DataFrame, key: str, share: float = 0.33, label: str | None = None, out: str = "is_test") -> DataFrame:
    """``df`` with a test flag for ``share`` of the rows, of each class if ``label`` is given."""
    r = _ranked(df, key, label)
    return r.withColumn(out, F.col("_rank") <= F.floor(F.col("_n") * share + 0.5)).drop("_rank", "_n")


def folds(df: DataFrame, key: str, k: int = 5, label: str | None = None, out: str = "fold") -> DataFrame:
    """``df`` with a fold from 0 to k - 1; with ``label``, each class is dealt out evenly."""
    return _ranked(df, key, label).withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_n")


def subsample(df: DataFrame, key: str, ratio: float, label: str | None = None) -> DataFrame:
    """A share of the rows, of each class if ``label`` is given. Smaller samples are parts of larger ones."""
    return _ranked(df, key, label).where(F.col("_rank") <= F.ceil(F.col("_n") * ratio)).drop("_rank", "_n")
