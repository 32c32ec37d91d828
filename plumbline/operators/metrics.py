"""Metrics as aggregations over (label, prediction, probability). Each gives one row, one column; no row is collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.quantiles import exact_quantiles

EPS = 1e-15


def _agg(sql: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.agg(F.expr(sql).alias("score"))


def _y() -> Column:
    return F.col("label")


def _p() -> Column:
    return F.col("prediction")


def _per_class(df: DataFrame) -> DataFrame:
    """(c, tp, fp, fn) over all labels and predictions."""
    both = df.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    sides = both.select(F.explode(F.array(F.struct(F.col("label").alias("c"), F.when(_y() == _p(), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(_y() == _p(), 0).otherwise(F.col("n")).alias("fn")),
                                          F.struct(F.col("prediction").alias("c"), F.lit(0).cast("long").alias("tp"), F.when(_y() == _p(), 0).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("long").alias("fn")))).alias("s"))
    return sides.groupBy("s.c").agg(F.sum("s.tp").alias("tp"), F.sum("s.fp").alias("fp"), F.sum("s.fn").alias("fn"))


def balanced_accuracy(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.avg((_y() == _p()).cast("double")).alias("r")).agg(F.avg("r").alias("score"))


def f1_macro(df: DataFrame) -> DataFrame:
    f1 = F.when(F.col("tp") == 0, 0.0).otherwise(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return _per_class(df).agg(F.avg(f1).alias("score"))


def legacy_balanced_accuracy(df: DataFrame) -> DataFrame:
    """Mean of the true positive and true negative rate for two classes, else of all true positive rates."""
    return balanced_accuracy(df)


def auc(df: DataFrame) -> DataFrame:
    """Area under the ROC curve of ``probability`` for label 1, ties by their average rank.

    Equal scores are counted before anything is ranked. Ranks are prefix sums in two levels, inside ranges of the score
    and over the ranges, so no task holds all scores.
    """
    counts = df.groupBy(F.col("probability").cast("double").alias("p")).agg(F.sum(F.when(_y() == 1, 1).otherwise(0)).alias("pos"), F.count("*").alias("n"))
    # a rising map of any score to at most 4,096 ranges
    ranged = counts.withColumn("b", F.floor(F.col("p") / (1 + F.abs("p")) * 2048))
    blocks = ranged.groupBy("b").agg(F.sum("n").alias("bn"))
    before = blocks.select("b", F.coalesce(F.sum("bn").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ob"))
    inner = ranged.withColumn("oi", F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.col("ob") + F.col("oi") + (F.col("n") + 1) / 2
    t = inner.join(before, "b").agg(F.sum(F.col("pos") * rank).alias("s"), F.sum("pos").alias("np"), F.sum(F.col("n") - F.col("pos")).alias("nn"))
    return t.select(F.try_divide(F.col("s") - F.col("np") * (F.col("np") + 1) / 2, (F.col("np") * F.col("nn")).cast("double")).alias("score"))


def auc_multiclass(df: DataFrame, classes: list) -> DataFrame:
    """Mean one-against-rest area; ``probability`` is an array in the order of ``classes``."""
    parts = [auc(df.select(F.when(_y() == F.lit(c), 1).otherwise(0).alias("label"), F.get("probability", F.lit(i)).alias("probability"))) for i, c in enumerate(classes)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.agg(F.avg("score").alias("score"))


def _is_array(df: DataFrame) -> bool:
    return df.schema["probability"].dataType.simpleString().startswith("array")


def _of_label(df: DataFrame) -> Column:
    """The probability given to a row's label: ``probability`` is that of label 1, or an array by class code."""
    p = F.coalesce(F.get("probability", _y().cast("int")), F.lit(0.0)) if _is_array(df) else F.when(_y() == 1, F.col("probability")).otherwise(1 - F.col("probability"))
    return F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))


def any_auc(df: DataFrame) -> DataFrame:
    """``auc`` for a number or an array for two classes, ``auc_multiclass`` for more; an array is by class code."""
    if not _is_array(df):
        return auc(df)
    most = df.agg(F.greatest(F.max(_y()), F.max(F.size("probability")) - 1)).first()[0]
    if most is None or most <= 1:
        return auc(df.select("label", F.get("probability", F.lit(1)).alias("probability")))
    return auc_multiclass(df, list(range(int(most) + 1)))


def log_loss(df: DataFrame) -> DataFrame:
    """``probability`` of label 1, or an array by class code."""
    return df.agg((-F.avg(F.ln(_of_label(df)))).alias("score"))


def median_absolute_error(df: DataFrame) -> DataFrame:
    got = exact_quantiles(df.select(F.abs(_y() - _p()).alias("e")), {"e": [0.5]})["e"]
    return df.sparkSession.createDataFrame([(got[0] if got else None,)], "score double")


def pac(df: DataFrame) -> DataFrame:
    """exp(-log loss), scaled so that predicting the class shares gives 0 and certainty 1."""
    each = df.groupBy("label").agg(F.count("*").alias("n"), F.sum(-F.ln(_of_label(df))).alias("loss"))
    total = each.agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"), F.sum(F.col("n") * F.ln("n")).alias("e"))
    prior = F.exp(F.col("e") / F.col("n") - F.ln("n"))
    return total.select(((F.exp(-F.col("loss") / F.col("n")) - prior) / F.when(prior == 1, 1.0).otherwise(1 - prior)).alias("score"))


#: name -> (metric, larger is better)
METRICS: dict[str, tuple[Callable[[DataFrame], DataFrame], bool]] = {
    "acc": (_agg("avg(double(label = prediction))"), True),
    "bal_acc": (balanced_accuracy, True),
    "f1": (f1_macro, True),
    "precision": (_agg("coalesce(try_divide(double(count_if(label = 1 and prediction = 1)), double(count_if(prediction = 1))), 0.0d)"), True),
    "recall": (_agg("coalesce(try_divide(double(count_if(label = 1 and prediction = 1)), double(count_if(label = 1))), 0.0d)"), True),
    "auc": (any_auc, True),
    "log_loss": (log_loss, False),
    "mse": (_agg("avg(pow(label - prediction, 2))"), False),
    "rmse": (_agg("sqrt(avg(pow(label - prediction, 2)))"), False),
    "msle": (_agg("avg(pow(log1p(label) - log1p(prediction), 2))"), False),
    "evs": (_agg("1 - var_pop(label - prediction) / var_pop(label)"), True),
    "r2": (_agg("1 - avg(pow(label - prediction, 2)) / var_pop(label)"), True),
    "max_error": (_agg("max(abs(label - prediction))"), False),
    "mae": (_agg("avg(abs(label - prediction))"), False),
    "median_absolute_error": (median_absolute_error, False),
    "balanced_accuracy": (legacy_balanced_accuracy, True),
    "pac_score": (pac, True),
}
ALIASES = {"accuracy": "acc", "cross_entropy": "log_loss", "balanced_acc": "bal_acc"}


def score(df: DataFrame, metric: str | Callable[[DataFrame], DataFrame]) -> float:
    """A metric with the sign that makes larger better; a callable of the frame is taken as it is."""
    if callable(metric):
        return float(metric(df).first()[0])
    fn, up = METRICS[ALIASES.get(metric, metric)]
    value = fn(df).first()[0]
    return float("nan") if value is None else float(value) * (1 if up else -1)
