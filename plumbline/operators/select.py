"""Feature selection by scores of one aggregation, or by the weights of a fitted model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.dataset import NUMBERS, Dataset, Stage, one_row
from plumbline.operators.stats import chi2_tail, f_tail


def chi2_scores(df: DataFrame, columns: list[str], label: str) -> dict[str, tuple[float, float]]:
    """(statistic, p) of class sums against their expectation; negative values count as 0."""
    per = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"), *[F.sum(F.greatest(F.col(c).cast("double"), F.lit(0.0))).alias(f"s{i}") for i, c in enumerate(columns)]).collect()
    n = sum(r["n"] for r in per)
    out = {}
    for i, c in enumerate(columns):
        total = sum(r[f"s{i}"] or 0 for r in per)
        stat = sum(((r[f"s{i}"] or 0) - total * r["n"] / n) ** 2 / (total * r["n"] / n) for r in per) if n and total else float("nan")
        out[c] = (stat, chi2_tail(stat, len(per) - 1) if len(per) > 1 else 1.0)
    return out


def anova_scores(df: DataFrame, columns: list[str], label: str) -> dict[str, tuple[float, float]]:
    """(F, p) of class means."""
    per = df.where(F.col(label).isNotNull()).groupBy(label).agg(*[g(F.col(c).cast("double")).alias(f"{a}{i}") for i, c in enumerate(columns) for a, g in (("n", F.count), ("m", F.avg), ("v", F.var_pop))]).collect()
    out = {}
    for i, c in enumerate(columns):
        rows = [(r[f"n{i}"], r[f"m{i}"], r[f"v{i}"]) for r in per if r[f"n{i}"]]
        n, k = sum(r[0] for r in rows), len(rows)
        if k < 2 or n <= k:
            out[c] = (float("nan"), 1.0)
            continue
        mean = sum(m * w for w, m, _ in rows) / n
        between, within = sum(w * (m - mean) ** 2 for w, m, _ in rows) / (k - 1), sum(w * v for w, _, v in rows) / (n - k)
        stat = between / within if within else float("inf") if between else float("nan")
        out[c] = (stat, f_tail(stat, k - 1, n - k))
    return out


def regression_scores(df: DataFrame, columns: list[str], label: str) -> dict[str, tuple[float, float]]:
    """(F, p) of the correlation with a number label."""
    y = F.col(label).cast("double")
    got = one_row(df, {f"{a}{i}": e for i, c in enumerate(columns) for a, e in (("r", F.corr(F.col(c).cast("double"), y)), ("n", F.count(F.when(y.isNotNull(), F.col(c)))))})
    out = {}
    for i, c in enumerate(columns):
        r, n = got[f"r{i}"], got[f"n{i}"]
        if r is None or r != r or n < 3:
            out[c] = (float("nan"), 1.0)
            continue
        stat = r * r / (1 - r * r) * (n - 2) if r * r < 1 else float("inf")
        out[c] = (stat, f_tail(stat, 1, n - 2))
    return out


def mutual_information(df: DataFrame, columns: list[str], label: str, bins: int = 16, classify: bool = True) -> dict[str, float]:
    """Mutual information in nats between binned columns and the label (binned too for regression), from one count of cells for each column."""
    names = [*columns, *([] if classify else [label])]
    got = one_row(df, {f"{a}|{c}": g(F.col(c).cast("double")) for c in names for a, g in (("lo", F.min), ("hi", F.max))})

    def binned(c: str):
        lo, hi = got[f"lo|{c}"], got[f"hi|{c}"]
        if lo is None or lo == hi:
            return F.lit(0)
        return F.least(F.lit(bins - 1), F.floor((F.col(c).cast("double") - float(lo)) / float((hi - lo) / bins))).cast("int")

    y = (F.col(label) if classify else binned(label)).cast("string")
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("f"), binned(c).alias("x"), y.alias("y")) for i, c in enumerate(columns)])).alias("c")).select("c.*")
    cells = cells.where("x is not null and y is not null").groupBy("f", "x", "y").agg(F.count("*").cast("double").alias("n"))
    totals = cells.groupBy("f").agg(F.sum("n").alias("t"))
    px = cells.groupBy("f", "x").agg(F.sum("n").alias("nx"))
    py = cells.groupBy("f", "y").agg(F.sum("n").alias("ny"))
    joined = cells.join(px, ["f", "x"]).join(py, ["f", "y"]).join(totals, "f")
    mi = {r["f"]: r["m"] for r in joined.groupBy("f").agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("m")).collect()}
    return {c: max(0.0, mi.get(i, 0.0)) for i, c in enumerate(columns)}


SCORES = {"chi2": chi2_scores, "f_classif": anova_scores, "f_regression": regression_scores}


def rejected_null(pvalues: dict[str, float], mode: str, alpha: float) -> set[str]:
    """Columns whose p-value is significant: by false positive rate, by false discovery rate, or family-wise."""
    if mode == "fpr":
        return {c for c, p in pvalues.items() if p < alpha}
    if mode == "fwe":
        return {c for c, p in pvalues.items() if p < alpha / len(pvalues)}
    ranked = sorted(pvalues.items(), key=lambda x: x[1])
    top = max((p for k, (_, p) in enumerate(ranked, 1) if p <= alpha * k / len(ranked)), default=None)
    return set() if top is None else {c for c, p in pvalues.items() if p <= top}


@dataclass
class Selector(Stage):
    """Keeps some of the target columns and all others."""

    name: str = "select"

    def keep(self, ds: Dataset, targets: list[str]) -> set[str]:
        raise NotImplementedError

    def learn(self, ds: Dataset, targets: list[str]) -> dict:
        return {"drop": set(targets) - self.keep(ds, targets)}

    def transform(self, ds: Dataset) -> Dataset:
        kept = {f: k for f, k in ds.kinds.items() if f not in self.state.get("drop", ())}
        return ds.project({f: F.col(f) for f in kept}, kept, self.name)


@dataclass
class Variance(Selector):
    threshold: float = 1e-7
    name: str = "variance"

    def keep(self, ds: Dataset, targets: list[str]) -> set[str]:
        got = one_row(ds.df, {f: F.var_pop(f) for f in targets})
        return {f for f in targets if (got[f] or 0) > self.threshold}


@dataclass
class Univariate(Selector):
    score: str = "chi2"
    mode_of_test: str = "fpr"
    alpha: float = 0.05
    name: str = "univariate"

    def keep(self, ds: Dataset, targets: list[str]) -> set[str]:
        scores = SCORES[self.score](ds.df, targets, ds.label)
        return rejected_null({c: p for c, (_, p) in scores.items()}, self.mode_of_test, self.alpha)


@dataclass
class Percentile(Selector):
    """The best share of the columns by score; equal scores in column order."""

    score: str = "f_classif"
    percentile: float = 50
    name: str = "percentile"

    def keep(self, ds: Dataset, targets: list[str]) -> set[str]:
        if self.score.startswith("mutual"):
            got = mutual_information(ds.df, targets, ds.label, classify=not self.score.endswith("regression"))
        else:
            got = {c: s for c, (s, _) in SCORES[self.score](ds.df, targets, ds.label).items()}
        k = max(1, int(len(targets) * self.percentile / 100))
        value = lambda c: got[c] if got[c] == got[c] else float("-inf")
        return set(sorted(targets, key=lambda c: (-value(c), targets.index(c)))[:k])


@dataclass
class ForestSelector(Selector):
    """Columns whose importance in extremely randomised trees is at least the mean."""

    classify: bool = True
    trees: int = 100
    name: str = "forest"

    def keep(self, ds: Dataset, targets: list[str]) -> set[str]:
        from plumbline.models.trees import ExtraTrees

        gain = ExtraTrees(targets, ds.label, trees=self.trees, regress=not self.classify).fit(ds.df).importances()
        mean = sum(gain.values()) / len(gain)
        return {c for c, g in gain.items() if g >= mean}


def linear_weights(ds: Dataset, targets: list[str], reg: float = 0.01, l1: float = 1.0) -> dict[str, float]:
    """Summed sizes of the weights of a logistic model on standardised columns."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=targets, outputCol="_v", handleInvalid="skip").transform(ds.df.select(*[F.col(t).cast("double").alias(t) for t in targets], F.col(ds.label).cast("double").alias("_y"))).select("_v", "_y")
    model = LogisticRegression(featuresCol="_v", labelCol="_y", regParam=reg, elasticNetParam=l1, maxIter=50).fit(data)
    size = abs(model.coefficientMatrix.toArray()).sum(axis=0)
    return dict(zip(targets, size.tolist()))


@dataclass
class LinearSelector(Selector):
    """Columns whose weight in an L1 linear model is at least the mean weight, or nonzero where all are small."""

    reg: float = 0.01
    name: str = "linear"

    def keep(self, ds: Dataset, targets: list[str]) -> set[str]:
        w = linear_weights(ds, targets, self.reg)
        mean = sum(w.values()) / len(w)
        return {c for c, x in w.items() if x >= max(mean, 1e-5)} or set(targets)


@dataclass
class RecursiveElimination(Selector):
    """The weakest column by linear weight goes, again and again; the best cross-validated set is kept."""

    folds: int = 3
    least: int | None = None
    name: str = "rfe"

    def keep(self, ds: Dataset, targets: list[str]) -> set[str]:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.evaluation import MulticlassClassificationEvaluator
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

        least, best, left = self.least or max(1, len(targets) // 20), (-1.0, list(targets)), list(targets)
        frame = ds.df.select(*[F.col(t).cast("double").alias(t) for t in targets], F.col(ds.label).cast("double").alias("_y")).persist()
        try:
            while len(left) >= least:
                data = VectorAssembler(inputCols=left, outputCol="_v", handleInvalid="skip").transform(frame)
                model = LogisticRegression(featuresCol="_v", labelCol="_y", maxIter=20)
                cv = CrossValidator(estimator=model, estimatorParamMaps=ParamGridBuilder().build(), numFolds=self.folds, seed=1, evaluator=MulticlassClassificationEvaluator(labelCol="_y", metricName="accuracy"))
                score = cv.fit(data).avgMetrics[0]
                if score >= best[0]:
                    best = (score, list(left))
                if len(left) == least:
                    break
                w = linear_weights(Dataset(frame, dict.fromkeys(left, NUMBERS[0]), "_y"), left, reg=0.001, l1=0.0)
                left.remove(min(left, key=lambda c: (w[c], c)))
        finally:
            frame.unpersist()
        return set(best[1])
