"""Class imbalance: tests, weights, copies and synthetic rows."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.dataset import Dataset
from plumbline.operators.neighbours import nearest
from plumbline.operators.split import _ranked
from plumbline.session import cut


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))


def is_imbalanced(df: DataFrame, label: str) -> DataFrame:
    """One row: the smallest class has at most a quarter of the rows of the largest."""
    return class_counts(df, label).agg((F.min("n") * 4 <= F.max("n")).alias("imbalanced"))


def class_weights(df: DataFrame, label: str, rule: str = "tree") -> DataFrame:
    """(label, n, weight): "tree" n / (2 n_c), "balanced" n / (k n_c), "ridge" 1 / n_c divided by its mean."""
    c = class_counts(df, label)
    t = c.agg(F.sum("n").alias("t"), F.count("*").alias("k"), F.avg(1 / F.col("n")).alias("m"))
    total = t.first()
    rules = {"tree": lambda n: total["t"] / (2 * n), "balanced": lambda n: total["t"] / (total["k"] * n), "ridge": lambda n: 1 / n / total["m"]}
    return c.withColumn("weight", rules[rule](F.col("n")))


def with_weights(ds: Dataset, rule: str = "balanced") -> Dataset:
    """A weight column for estimators; classes are few, so their table is broadcast by its size."""
    w = class_weights(ds.df, ds.label, rule).select(F.col(ds.label).alias("_l"), F.col("weight").alias("_weight"))
    return replace(ds, df=ds.df.join(w, F.col(ds.label) == F.col("_l"), "left").drop("_l"), weight="_weight")


def oversample(df: DataFrame, label: str, key: str, share: float = 0.6) -> DataFrame:
    """Rows of classes smaller than ``share`` of the median class, repeated up to that size.

    Every row comes out whole times, and those first by a hash of ``key`` once more, so the target size is met exactly
    in each class. Ranks are counted in ranges of the hash, so no class is sorted in one task.
    """
    counts = class_counts(df, label)
    median = counts.agg(F.percentile("n", F.lit(0.5)).alias("m")).first()["m"] or 0
    goal = int(share * median)
    small = {r[label]: r["n"] for r in counts.where(F.col("n") < goal).collect()}
    if not small:
        return df
    plan = df.sparkSession.createDataFrame([(v, goal // n, goal % n) for v, n in small.items()], f"_l {df.schema[label].dataType.simpleString()}, _times int, _more int")
    joined = df.join(F.broadcast(plan), F.col(label) == F.col("_l"), "left")
    few = _ranked(joined.where("_more > 0"), key, label).where(F.col("_rank") <= F.col("_more")).select(*df.columns)
    whole = joined.withColumn("_c", F.explode(F.sequence(F.lit(1), F.coalesce("_times", F.lit(1))))).drop("_c", "_l", "_times", "_more")
    return whole.unionByName(few)


def _numbered(df: DataFrame, columns: list[str]) -> DataFrame:
    """A fixed copy with an _id that grows in the order of ``columns``."""
    return cut(df.orderBy(*columns, "label").withColumn("_id", F.monotonically_increasing_id()))


def smote(df: DataFrame, label: str, columns: list[str], k: int = 5, block: int = 4096, seed: int = 1, tomek: bool = True) -> DataFrame:
    """(label, columns, synthetic): rows with the smaller classes filled up to the largest by points between near rows of one class.

    A synthetic row lies between a row drawn from its class and one of that row's ``k`` nearest of the class. With ``tomek``, rows that are
    mutual nearest neighbours across classes, of all rows then there, are left out. Both searches are exact, in blocks of about
    ``block`` rows. Rows with a null label or a number that isn't finite don't take part; a class of one row has no neighbours and isn't filled up.
    """
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in columns]
    clean = df.select(F.col(label).cast("string").alias("label"), *[F.col(c).cast("double").alias(c) for c in columns]).where(reduce(lambda a, b: a & b, finite, F.col("label").isNotNull()))
    counts = {r["label"]: r["n"] for r in class_counts(clean, "label").collect()}
    if not counts:
        return clean.withColumn("synthetic", F.lit(False))
    top = max(counts.values())
    need = {c: top - n for c, n in counts.items() if n > 1 and n < top}
    rows = _numbered(clean, columns)
    grown = rows.select("label", *columns, F.lit(False).alias("synthetic"))
    if need:
        small = cut(rows.where(F.col("label").isin(list(need))))
        near = nearest(small, columns, k, "label", block)
        ranked = _ranked(small, "_id", "label").select(F.col("label").alias("_l"), F.col("_rank").cast("long").alias("_r"), "_id", *[F.col(c).alias(f"_a{i}") for i, c in enumerate(columns)]).join(near, "_id")
        spark = df.sparkSession
        draw = lambda salt: F.pmod(F.xxhash64("label", "id", F.lit(seed), F.lit(salt)), F.lit(1 << 52))
        draws = reduce(DataFrame.unionByName, [spark.range(m).select(F.lit(c).alias("label"), "id", F.lit(counts[c]).alias("_n")) for c, m in need.items()])
        draws = draws.select("label", (draw(1) % F.col("_n") + 1).alias("_r"), draw(2).alias("_which"), (draw(3) / float(1 << 52)).alias("_gap"))
        drawn = draws.join(ranked, (F.col("label") == F.col("_l")) & (draws["_r"] == ranked["_r"])).withColumn("_other", F.col("near")[(F.col("_which") % F.size("near")).cast("int")])
        ends = small.select(F.col("_id").alias("_other"), *[F.col(c).alias(f"_b{i}") for i, c in enumerate(columns)])
        made = drawn.join(ends, "_other").select("label", *[(F.col(f"_a{i}") + F.col("_gap") * (F.col(f"_b{i}") - F.col(f"_a{i}"))).alias(c) for i, c in enumerate(columns)], F.lit(True).alias("synthetic"))
        grown = grown.unionByName(made)
    if not tomek or len(counts) < 2:
        return grown
    return without_tomek_links(grown, columns, block)


def without_tomek_links(df: DataFrame, columns: list[str], block: int = 4096) -> DataFrame:
    """``df`` without the rows that are each other's nearest neighbour and differ in ``label``."""
    rows = _numbered(df, columns)
    near = nearest(rows, columns, 1, None, block).select("_id", F.col("near")[0].alias("_n"))
    pairs = near.join(rows.select("_id", "label"), "_id")
    back = pairs.select(F.col("_id").alias("_n"), F.col("_n").alias("_id"), F.col("label").alias("_l"))
    links = pairs.join(back, ["_id", "_n"]).where("label != _l").select("_id")
    return rows.join(links, "_id", "left_anti").select(*df.columns)
