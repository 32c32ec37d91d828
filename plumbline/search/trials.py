"""Tables of trials: best ones, ids of configurations, summaries, and advice from past runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalar import with_running_max


def finite(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def top_k(trials: DataFrame, k: int = 50, group: str = "algorithm", key: str = "trial_id") -> DataFrame:
    """The ``k`` best scores of each algorithm, equal ones by ``key``; scores that aren't finite don't count.

    Spark keeps ``k`` rows of each group before it shuffles them.
    """
    w = Window.partitionBy(group).orderBy(F.desc("score"), key)
    return trials.where(finite("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def config_ids(df: DataFrame, config: str = "config") -> DataFrame:
    """``df`` with config_sha1: the digest of a JSON configuration's sorted key-value pairs, numbers rounded to five places, so the order of keys doesn't matter. Null configurations have none."""
    pairs = F.map_entries(F.from_json(config, "map<string,string>"))
    value = lambda v: F.coalesce(F.when(v.contains("."), F.round(v.try_cast("double"), 5).cast("string")), v, F.lit("null"))
    return df.withColumn("config_sha1", F.sha1(F.array_join(F.array_sort(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("-"), value(e["value"])))), ",")))


def summary(trials: DataFrame, group: str = "session_id") -> DataFrame:
    """Trials, failures and the best score of each session."""
    ok = (F.col("state") == 0) & finite("perf")
    return trials.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.when(F.col("state") != 0, 1).otherwise(0)).alias("failed"), F.max(F.when(ok, F.col("perf"))).alias("best"))


def trajectory(trials: DataFrame, group: str = "session_id") -> DataFrame:
    """The best score so far at each trial of a session.

    Trials without a finite score or a time of their end: the former don't count, the latter come first.
    """
    t = trials.where(finite("perf"))
    return with_running_max(t, "perf", F.unix_micros(F.col("finished_at").cast("timestamp")), "trial_id", group).select(group, "trial_id", "best")


def median_scores(trials: DataFrame) -> DataFrame:
    """The median score of each data set and algorithm."""
    return trials.where(finite("score")).groupBy("dataset_id", "algorithm").agg(F.percentile("score", F.lit(0.5)).alias("score"))


def advise(trial_runs: DataFrame, task_vectors: DataFrame, n: int = 5, algorithms: int = 64, alpha: float = 1.0) -> DataFrame:
    """The ``n`` algorithms most likely to do well on each data set with a vector, by one model of wins for each pair of algorithms.

    For each pair a win is the sign of the difference of their median scores on a data set, and a ridge model of the wins, with a free intercept
    and the penalty ``alpha``, predicts it from the vector. The votes for an algorithm are the pairs it is predicted to win; a predicted draw is
    one for the first name. Pairs that were never compared are skipped; equal votes go by name.

    All pairs' moments come from one aggregation, k (k - 1) / 2 of d (d + 3) / 2 numbers, and the models are solved on the driver.
    """
    t = trial_runs.select("trial_id", "dataset_id", F.lower(F.trim("estimator_id", F.lit(" \t"))).alias("algorithm"), F.col("perf").alias("score")).distinct()
    med = median_scores(t).where("algorithm is not null")
    names = [r[0] for r in med.select("algorithm").distinct().orderBy("algorithm").limit(algorithms + 1).collect()]
    if len(names) > algorithms:
        raise ValueError(f"more than {algorithms} algorithms")
    d = 32
    good = task_vectors.where((F.size("dataset_embedding") == d) & F.forall("dataset_embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    good = good.select("task_id", "dataset_id", "dataset_embedding").distinct()
    vec = good.groupBy("dataset_id").agg(F.array(*[F.avg(F.get("dataset_embedding", F.lit(i)).cast("double")) for i in range(d)]).alias("v"))
    pairs = med.alias("a").join(med.alias("b"), "dataset_id").where(F.col("a.algorithm") < F.col("b.algorithm"))
    pairs = pairs.select("dataset_id", F.col("a.algorithm").alias("x"), F.col("b.algorithm").alias("y"), F.signum(F.col("a.score") - F.col("b.score")).alias("win"))
    at = [F.get("v", F.lit(i)) for i in range(d)]
    sums = [F.sum("win"), *[F.sum(c) for c in at], *[F.sum(c * F.col("win")) for c in at], *[F.sum(at[i] * at[j]) for i in range(d) for j in range(i, d)]]
    rows = pairs.join(vec, "dataset_id").groupBy("x", "y").agg(F.count("*").alias("n"), F.array(*sums).alias("s")).collect()
    models = []
    for r in sorted(rows, key=lambda r: (r["x"], r["y"])):
        k, s = r["n"], np.array(r["s"], float)
        mean, win = s[1 : 1 + d] / k, s[0] / k
        second = np.zeros((d, d))
        second[np.triu_indices(d)] = s[1 + 2 * d :]
        second = second + np.triu(second, 1).T - k * np.outer(mean, mean)
        w = np.linalg.solve(second + alpha * np.eye(d), s[1 + d : 1 + 2 * d] - k * win * mean)
        models.append((r["x"], r["y"], [float(x) for x in w], float(win - w @ mean)))
    if not models:
        return vec.select("dataset_id", F.lit(None).cast("string").alias("algorithm"), F.lit(0).cast("long").alias("votes"), F.lit(0).alias("rank")).limit(0)
    model = vec.sparkSession.createDataFrame(models, "x string, y string, w array<double>, b double")
    lean = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.col("b"), lambda a, x: a + x)
    votes = vec.join(F.broadcast(model)).select("dataset_id", F.when(F.round(lean, 9) >= 0, F.col("x")).otherwise(F.col("y")).alias("winner"), "x", "y")  # at most algorithms^2 / 2 models
    each = votes.select("dataset_id", F.explode(F.array(F.struct(F.col("x").alias("algorithm"), (F.col("winner") == F.col("x")).cast("int").alias("v")), F.struct(F.col("y").alias("algorithm"), (F.col("winner") == F.col("y")).cast("int").alias("v")))).alias("e"))
    total = each.groupBy("dataset_id", "e.algorithm").agg(F.sum("e.v").alias("votes"))
    w2 = Window.partitionBy("dataset_id").orderBy(F.desc("votes"), "algorithm")
    return total.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= n)


def nearest_datasets(task_vectors: DataFrame, target: list[float], k: int = 3) -> DataFrame:
    """The ``k`` past data sets whose scaled vectors are closest to a new one: where a search can start from their best configurations."""
    d = len(target)
    vec = task_vectors.where(F.size("dataset_embedding") == d).groupBy("dataset_id").agg(*[F.avg(F.get("dataset_embedding", F.lit(i))).alias(f"v{i}") for i in range(d)]).na.drop()
    ends = vec.agg(*[g(f"v{i}").alias(f"{n}{i}") for i in range(d) for n, g in (("lo", F.min), ("hi", F.max))]).first()
    dist = sum(((F.col(f"v{i}") - float(target[i])) / float((ends[f"hi{i}"] - ends[f"lo{i}"]) or 1.0)) ** 2 for i in range(d))
    return vec.select("dataset_id", F.sqrt(dist).alias("dist")).orderBy("dist", "dataset_id").limit(k)
