"""Search for the best pipeline of feature steps, algorithm and parameters: ``Classifier`` and ``Regressor``."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import ensemble as E
from plumbline.dataset import NUMBERS, Chain, Dataset, Stage
from plumbline.models import classic as M
from plumbline.models import trees as T
from plumbline.operators import generate as G
from plumbline.operators import scale as R
from plumbline.operators import select as L
from plumbline.operators.balance import is_imbalanced, smote, with_weights
from plumbline.operators.clean import encode_labels, label_codes, preprocess
from plumbline.operators.metrics import score
from plumbline.operators.split import folds, holdout, subsample
from plumbline.search.blocks import plan
from plumbline.search.space import Config, SearchSpace, categorical, config_id, integer, uniform
from plumbline.session import cut



def _boosted(c: Config) -> dict:
    return {"maxIter": c["lightgbm:rounds"], "stepSize": c["lightgbm:rate"], "maxDepth": c["lightgbm:depth"], "subsamplingRate": c["lightgbm:subsample"]}


#: name -> (parameters of the search, maker of the model); users add their own.
CLASSIFIERS: dict[str, tuple[list, Callable]] = {
    "lda": ([uniform("lda:shrinkage", 0.0, 1.0, 0.0)], lambda f, y, c: M.LDA(f, y, shrinkage=c["lda:shrinkage"])),
    "qda": ([uniform("qda:reg", 0.0, 1.0, 0.0)], lambda f, y, c: M.QDA(f, y, reg=c["qda:reg"])),
    "gaussian_nb": ([], lambda f, y, c: M.GaussianNB(f, y)),
    "logistic_regression": ([uniform("logistic_regression:C", 0.03, 10, 1.0, log=True)], lambda f, y, c: T.LogisticRegression(f, y, params={"regParam": 1e-3 / c["logistic_regression:C"], "maxIter": 50})),
    "random_forest": ([integer("random_forest:trees", 5, 40, 10), integer("random_forest:depth", 3, 10, 5)], lambda f, y, c: T.RandomForestClassifier(f, y, params={"numTrees": c["random_forest:trees"], "maxDepth": c["random_forest:depth"]})),
    "extra_trees": ([integer("extra_trees:trees", 5, 40, 10)], lambda f, y, c: T.ExtraTrees(f, y, trees=c["extra_trees:trees"])),
    "gradient_boosting": ([integer("gradient_boosting:rounds", 5, 50, 10), uniform("gradient_boosting:rate", 0.01, 1.0, 0.1, log=True)], lambda f, y, c: T.GradientBoostingClassifier(f, y, params={"maxIter": c["gradient_boosting:rounds"], "stepSize": c["gradient_boosting:rate"]})),
    "adaboost": ([integer("adaboost:rounds", 3, 20, 5), integer("adaboost:depth", 1, 8, 3)], lambda f, y, c: T.AdaBoost(f, y, n_estimators=c["adaboost:rounds"], depth=c["adaboost:depth"])),
    "liblinear_svc": ([uniform("liblinear_svc:C", 0.03, 32768, 1.0, log=True), categorical("liblinear_svc:loss", ["squared_hinge", "hinge"])], lambda f, y, c: M.Margin(f, y, C=c["liblinear_svc:C"], loss=c["liblinear_svc:loss"])),
    "libsvm_svc": ([uniform("libsvm_svc:C", 0.03, 32768, 1.0, log=True), uniform("libsvm_svc:gamma", 3e-5, 8, 0.1, log=True)], lambda f, y, c: T.KernelMachine(f, y, C=c["libsvm_svc:C"], gamma=c["libsvm_svc:gamma"])),
    "knn": ([integer("knn:k", 1, 100, 1), categorical("knn:weights", ["uniform", "distance"]), categorical("knn:p", [1, 2], 2)], lambda f, y, c: M.NearestNeighbours(f, y, k=c["knn:k"], weights=c["knn:weights"], p=c["knn:p"])),
    "lightgbm": ([integer("lightgbm:rounds", 5, 50, 10), uniform("lightgbm:rate", 0.01, 1.0, 0.1, log=True), integer("lightgbm:depth", 3, 10, 5), uniform("lightgbm:subsample", 0.5, 1.0, 0.8)], lambda f, y, c: T.GradientBoostingClassifier(f, y, params=_boosted(c))),
}
#: for imbalanced classes; a search looks at them where they are named.
IMBALANCED: dict[str, tuple[list, Callable]] = {
    "balanced_bagging": ([integer("balanced_bagging:bags", 3, 20, 5), integer("balanced_bagging:depth", 2, 10, 5)], lambda f, y, c: T.BalancedBag(f, y, bags=c["balanced_bagging:bags"], depth=c["balanced_bagging:depth"])),
    "balanced_forest": ([integer("balanced_forest:bags", 3, 20, 5)], lambda f, y, c: T.BalancedBag(f, y, bags=c["balanced_forest:bags"], base="forest")),
    "easy_ensemble": ([integer("easy_ensemble:bags", 3, 20, 5)], lambda f, y, c: T.BalancedBag(f, y, bags=c["easy_ensemble:bags"], base="boost")),
    "rusboost": ([integer("rusboost:rounds", 5, 50, 10), integer("rusboost:depth", 1, 8, 3)], lambda f, y, c: T.RUSBoost(f, y, n_estimators=c["rusboost:rounds"], depth=c["rusboost:depth"])),
}
REGRESSORS: dict[str, tuple[list, Callable]] = {
    "ridge": ([uniform("ridge:alpha", 0.01, 32, 1.0, log=True)], lambda f, y, c: M.Ridge(f, y, alpha=c["ridge:alpha"])),
    "lasso": ([uniform("lasso:alpha", 0.01, 32, 1.0, log=True)], lambda f, y, c: M.Lasso(f, y, alpha=c["lasso:alpha"])),
    "random_forest": ([integer("random_forest:trees", 5, 40, 10), integer("random_forest:depth", 3, 10, 5)], lambda f, y, c: T.RandomForestRegressor(f, y, params={"numTrees": c["random_forest:trees"], "maxDepth": c["random_forest:depth"]})),
    "extra_trees": ([integer("extra_trees:trees", 5, 40, 10)], lambda f, y, c: T.ExtraTrees(f, y, trees=c["extra_trees:trees"], regress=True)),
    "gradient_boosting": ([integer("gradient_boosting:rounds", 5, 50, 10)], lambda f, y, c: T.GradientBoostingRegressor(f, y, params={"maxIter": c["gradient_boosting:rounds"]})),
    "adaboost": ([integer("adaboost:rounds", 3, 20, 5)], lambda f, y, c: T.AdaBoostR2(f, y, n_estimators=c["adaboost:rounds"])),
    "liblinear_svr": ([uniform("liblinear_svr:C", 0.03, 32768, 1.0, log=True)], lambda f, y, c: M.Margin(f, y, C=c["liblinear_svr:C"], loss="squared_epsilon")),
    "libsvm_svr": ([uniform("libsvm_svr:C", 0.03, 32768, 1.0, log=True), uniform("libsvm_svr:gamma", 3e-5, 8, 0.1, log=True)], lambda f, y, c: T.KernelMachine(f, y, C=c["libsvm_svr:C"], gamma=c["libsvm_svr:gamma"], loss="squared_epsilon")),
    "knn": ([integer("knn:k", 1, 100, 1), categorical("knn:weights", ["uniform", "distance"]), categorical("knn:p", [1, 2], 2)], lambda f, y, c: M.NearestNeighbours(f, y, k=c["knn:k"], weights=c["knn:weights"], p=c["knn:p"], regress=True)),
    "lightgbm": ([integer("lightgbm:rounds", 5, 50, 10), uniform("lightgbm:rate", 0.01, 1.0, 0.1, log=True), integer("lightgbm:depth", 3, 10, 5), uniform("lightgbm:subsample", 0.5, 1.0, 0.8)], lambda f, y, c: T.GradientBoostingRegressor(f, y, params=_boosted(c))),
}
#: stage of a pipeline -> name -> maker of the step.
STAGES: dict[str, dict[str, Callable[[bool], Stage | None]]] = {
    "balancer": {"empty": lambda c: None, "weight_balancer": lambda c: None, "data_balancer": lambda c: None, "smote_balancer": lambda c: None},  # no steps: ``pipeline`` weighs the training rows or fills them up
    "preprocessor": {"empty": lambda c: None, "pca": lambda c: G.PCA(), "polynomial": lambda c: G.Polynomial(top=5, classify=c), "percentile": lambda c: L.Percentile(score="f_classif" if c else "f_regression"), "forest": lambda c: L.ForestSelector(classify=c, trees=10), "kbins": lambda c: R.Bins(), "nystroem": lambda c: G.Nystroem(),
        "svd": lambda c: G.SVD(), "fast_ica": lambda c: G.FastICA(), "feature_agglomeration": lambda c: G.FeatureAgglomeration(), "random_fourier": lambda c: G.RandomFourier(), "tree_embedding": lambda c: G.TreeEmbedding(), "cross": lambda c: G.Cross(),
        "univariate": lambda c: L.Univariate(score="f_classif" if c else "f_regression"), "linear": lambda c: L.LinearSelector()},
    "rescaler": {"empty": lambda c: None, "minmax": lambda c: R.MinMax(), "standard": lambda c: R.Standard(), "robust": lambda c: R.Robust(), "normalize": lambda c: R.Normalize(), "quantile": lambda c: R.Quantile(n_quantiles=50)},
}
#: classifiers whose weights follow the rule "tree" of ``class_weights``; the others follow "balanced".
BY_TREE = {"adaboost", "random_forest", "extra_trees", "gradient_boosting", "lightgbm"}
#: classifiers that know no weights, so a search doesn't put them together with the weight balancer.
UNWEIGHTED = {"knn", "balanced_bagging", "balanced_forest", "easy_ensemble", "rusboost"}
#: balancers that fill up the smaller classes by SMOTE, the second only where the classes are imbalanced; a search tries them where they are named.
FILLING = ("data_balancer", "smote_balancer")
ENSEMBLES = ("ensemble_selection", "bagging", "blending", "stacking", "unnamed")


def add_classifier(name: str, parameters: list, make: Callable) -> None:
    """A user's algorithm: ``make(features, label, config)`` gives an object with ``fit`` and ``predict``."""
    CLASSIFIERS[name] = (parameters, make)


def add_regressor(name: str, parameters: list, make: Callable) -> None:
    REGRESSORS[name] = (parameters, make)


def add_step(stage: str, name: str, make: Callable[[bool], Stage | None]) -> None:
    """A user's step for the balancer, preprocessor or rescaler stage, or for a stage of a new name."""
    STAGES.setdefault(stage, {"empty": lambda c: None})[name] = make


def add_generator(name: str, make: Callable) -> None:
    add_step("preprocessor", name, make)


def add_selector(name: str, make: Callable) -> None:
    add_step("preprocessor", name, make)


def add_rescaler(name: str, make: Callable) -> None:
    add_step("rescaler", name, make)


def add_balancer(name: str, make: Callable) -> None:
    add_step("balancer", name, make)


def space_of(algorithms: dict[str, tuple[list, Callable]], steps: dict[str, list[str]]) -> SearchSpace:
    """Feature steps, the algorithm, and each algorithm's own parameters where it is chosen."""
    s = SearchSpace([categorical(f"fe:{stage}", names) for stage, names in steps.items()])
    s.add(categorical("algorithm", list(algorithms)))
    for name, (parameters, _) in algorithms.items():
        s.add(*[replace(p, when=("algorithm", (name,))) for p in parameters])
    s.forbidden.append(lambda c: c.get("fe:balancer") == "weight_balancer" and c.get("algorithm") in UNWEIGHTED)
    s.forbidden.append(lambda c: c.get("fe:balancer") in FILLING and c.get("algorithm") == "knn")  # synthetic rows have no key
    return s


@dataclass
class Pipeline:
    chain: Chain
    model: M.Model

    def predict(self, ds: Dataset) -> DataFrame:
        return self.model.predict(self.chain.transform(ds).df)


@dataclass
class AutoML:
    """``fit`` searches under a budget of trials; ``predict`` uses the best pipeline or an ensemble of the best.

    evaluation: holdout, cv or partial (shares of the data). Training data are prepared and cached once per search.

    ensemble_method: None or one of ENSEMBLES, over the best ``ensemble_members`` trials (None: all that succeeded on all data). It learns from
    predictions of rows that the members weren't fitted on: the hold-out, or all rows by folds under cv and for stacking, whose
    members are the means of their fold models.
    """

    key: str
    metric: str | Callable = "bal_acc"
    trials: int = 10
    evaluation: str = "holdout"
    optimizer: str = "smac"
    tree: int = 0
    include_algorithms: list[str] | None = None
    include_steps: dict[str, list[str]] | None = None
    ensemble_method: str | None = None
    ensemble_size: int = 50  # steps of ensemble selection
    parallel: int = 1
    seed: int = 1
    classify: bool = True
    state: dict = field(default_factory=dict)
    ensemble_members: int | None = None
    time_limit: float | None = None  # seconds for all trials
    per_run_time_limit: float | None = None  # seconds for one trial, which is cancelled then

    def __post_init__(self) -> None:
        if self.ensemble_method not in (None, *ENSEMBLES) or (self.ensemble_method == "unnamed" and not self.classify):
            raise ValueError(f"no ensemble method {self.ensemble_method!r} for {'classes' if self.classify else 'numbers'}")
        if not self.classify and set((self.include_steps or {}).get("balancer", [])) - {"empty"}:
            raise ValueError("balancers are for classes")

    def pipeline(self, config: Config, train: Dataset) -> Pipeline:
        steps = [STAGES[k.removeprefix("fe:")][v](self.classify) for k, v in config.items() if k.startswith("fe:")]
        chain = Chain(*[s for s in steps if s is not None])
        ready = train
        for stage in chain.stages:
            ready = stage.fit_transform(ready)
            if isinstance(stage, G.Nystroem):  # costly expressions, which later steps and the fit would evaluate in each of their passes
                ready = replace(ready, df=cut(ready.df))
        name = config["algorithm"]
        model = self.state["algorithms"][name][1](ready.of_kind(*NUMBERS), train.label, config)
        if isinstance(model, M.NearestNeighbours):
            model.key = self.key
        if config.get("fe:balancer") == "weight_balancer":
            if not hasattr(model, "weight"):
                raise ValueError(f"{name} takes no weights")
            ready = with_weights(ready, "tree" if name in BY_TREE else "balanced")
            model.weight = ready.weight
        if config.get("fe:balancer") in FILLING and (config["fe:balancer"] == "data_balancer" or is_imbalanced(ready.df, train.label).first()[0]):
            numbers = ready.of_kind(*NUMBERS)
            grown = smote(ready.df, train.label, numbers)
            ready = replace(ready, df=cut(grown.select(*numbers, F.col("label").cast("int").alias(train.label))))
        return Pipeline(chain, model.fit(ready.df))

    def evaluate(self, config: Config, share: float) -> float:
        ds: Dataset = self.state["data"]
        on = ds.label if self.classify else None
        if self.evaluation == "cv":
            fitted = self.by_folds(config)
            self.state["fitted"][config_id(config)] = fitted
            return sum(self.score_of(p, self.part("fold", f)) for f, p in enumerate(fitted)) / 5
        frame = self.state["split"]
        train = frame.where("not is_test").drop("is_test")
        if share < 1:
            train = subsample(train, self.key, share, on)
        fitted = self.pipeline(config, replace(ds, df=train))
        if share == 1:  # an ensemble weighs its members by these
            self.state["fitted"][config_id(config)] = fitted
        return self.score_of(fitted, replace(ds, df=frame.where("is_test").drop("is_test")))

    def part(self, column: str, value: int | bool, equal: bool = True) -> Dataset:
        """The rows of a fold, or of the hold-out, or the others."""
        is_it = F.col(column) == F.lit(value)
        return replace(self.state["data"], df=self.state["folds" if column == "fold" else "split"].where(is_it if equal else ~is_it).drop(column))

    def by_folds(self, config: Config) -> list[Pipeline]:
        """The pipeline fitted without each fold."""
        if "folds" not in self.state:
            ds = self.state["data"]
            self.state["folds"] = folds(ds.df, self.key, 5, ds.label if self.classify else None).persist()
        return [self.pipeline(config, self.part("fold", f, False)) for f in range(5)]

    def score_of(self, p: Pipeline, test: Dataset) -> float:
        out = p.predict(test).withColumnRenamed(test.label, "label")
        return score(out, self.metric)

    def fit(self, df: DataFrame, label: str, features: list[str] | None = None) -> AutoML:
        ds = Dataset.of(df.where(F.col(label).isNotNull()), features, label, keep=(self.key,))
        if self.classify:
            self.state["codes"] = cut(label_codes(ds.df, label))
            self.state["classes"] = sorted(r["code"] for r in self.state["codes"].collect())
        ds, prep = preprocess(ds, self.classify)
        ds = replace(ds, df=cut(ds.df))  # else each plan of each trial holds the plan of the preparation
        algorithms = {**CLASSIFIERS, **IMBALANCED} if self.classify else REGRESSORS
        names = self.include_algorithms or list(CLASSIFIERS if self.classify else REGRESSORS)
        steps = {stage: (self.include_steps or {}).get(stage, [o for o in options if o not in FILLING and (self.classify or o not in ("weight_balancer", "linear"))]) for stage, options in STAGES.items()}
        self.state |= {"fitted": {}, "algorithms": {n: algorithms[n] for n in names}, "prep": prep, "data": ds, "label": label}
        on = ds.label if self.classify else None
        if self.evaluation == "cv":
            self.state["folds"] = folds(ds.df, self.key, 5, on).persist()
        else:
            self.state["split"] = holdout(ds.df, self.key, 0.33, on).persist()
        space = space_of(self.state["algorithms"], steps)
        search = plan(self.tree, space, self.evaluate, names, "mfes" if self.evaluation == "partial" else self.optimizer, seed=self.seed, parallel=self.parallel, until=None if self.time_limit is None else time.time() + self.time_limit, per_run=self.per_run_time_limit)
        per = len(names) if self.tree in (1, 2) else 1
        search.iterate(1 if self.evaluation == "partial" else max(1, self.trials // per))
        self.state["search"] = search
        if search.best is None:
            raise RuntimeError("no trial succeeded: " + "; ".join(t.error for t in search.history[:3]))
        good = sorted([t for t in search.history if t.status == 0 and t.fidelity == 1.0], key=lambda t: -t.score)
        members = good[: self.ensemble_members] if self.ensemble_method and len(good) > 1 else [search.best]
        self.state["rule"] = None
        if len(members) > 1:
            self.combine([t.config for t in members])
        else:
            self.state["members"] = [[self.pipeline(members[0].config, ds)]]
        return self

    def combine(self, configs: list[Config]) -> None:
        """Members, and the rule (method, what it learnt) that puts them together."""
        by_folds = self.evaluation == "cv" or self.ensemble_method == "stacking"
        parts = []
        tried = [self.state["fitted"].get(config_id(c)) if self.evaluation == "cv" or not by_folds else None for c in configs]
        tried = [t if t is not None or not by_folds else self.by_folds(c) for t, c in zip(tried, configs)]
        if self.ensemble_method != "bagging":
            for i, t in enumerate(tried):
                pairs = [(p, self.part("fold", f)) for f, p in enumerate(t)] if by_folds else [(t, self.part("is_test", True))]
                parts += [self.votes([p], test).withColumn("model_id", F.lit(i)) for p, test in pairs]
        long = cut(reduce(DataFrame.unionByName, parts)) if parts else None
        learn = {
            "ensemble_selection": lambda: E.greedy_selection(long, self.ensemble_size), "bagging": lambda: {i: 1 / len(configs) for i in range(len(configs))},
            "blending": lambda: E.fit_meta(long), "stacking": lambda: E.fit_meta(long), "unnamed": lambda: E.accuracy_odds(long),
        }
        learnt = learn[self.ensemble_method]()
        self.state["rule"] = self.ensemble_method, learnt
        # members without a weight have no part in the result and aren't fitted again
        self.state["members"] = tried if self.ensemble_method == "stacking" else [[self.pipeline(c, self.state["data"])] if i in learnt or not isinstance(learnt, dict) else None for i, c in enumerate(configs)]

    def votes(self, fitted: list[Pipeline], ds: Dataset) -> DataFrame:
        """(row_id, label, prob): for classes one row per row and class, with the model's probability or else its vote; the mean of ``fitted``."""
        classes = self.state["classes"] if self.classify else []
        parts = []
        for p in fitted:
            out = p.predict(ds)
            label = F.col(ds.label) if ds.label else F.lit(None)
            if not self.classify:
                parts.append(out.select(F.struct(F.col(self.key).alias("key")).alias("row_id"), label.cast("double").alias("label"), F.col("prediction").cast("double").alias("prob")))
                continue
            c = F.col("_c")
            prob = F.coalesce(F.get("probability", c), F.lit(0.0)) if "probability" in out.columns else (F.col("prediction") == c).cast("double")
            each = out.withColumn("_c", F.explode(F.array(*[F.lit(int(x)) for x in classes])))
            parts.append(each.select(F.struct(F.col(self.key).alias("key"), c.alias("c")).alias("row_id"), (label == c).cast("int").alias("label"), prob.alias("prob")))
        long = reduce(DataFrame.unionByName, parts)
        return long if len(parts) == 1 else long.groupBy("row_id").agg(F.first("label").alias("label"), F.avg("prob").alias("prob"))

    def predict(self, df: DataFrame) -> DataFrame:
        """(key, prediction) in the label's own values."""
        ready = self._ready(df)
        if self.state["rule"] is None:
            out = self.state["members"][0][0].predict(ready).select(self.key, "prediction")
        else:
            joined = self._joined(ready)
            if self.classify:
                best = joined.groupBy(F.col("row_id.key").alias(self.key)).agg(F.max(F.struct("prob", (-F.col("row_id.c")).alias("c"))).alias("b"))
                out = best.select(self.key, (-F.col("b.c")).cast("int").alias("prediction"))
            else:
                out = joined.select(F.col("row_id.key").alias(self.key), F.col("prob").alias("prediction"))
        if self.classify:
            codes = self.state["codes"]
            out = out.join(F.broadcast(codes), F.col("prediction") == F.col("code"), "left").select(self.key, F.col("value").alias("prediction"))
        return out

    def classes(self) -> list:
        """The labels in the order of their codes, as in ``predict_proba``."""
        return [r["value"] for r in self.state["codes"].orderBy("code").collect()]

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """(key, probability): an array in the order of ``classes``, that adds up to 1."""
        if not self.classify:
            raise ValueError("numbers have no probabilities")
        long = self._joined(self._ready(df))
        each = long.groupBy(F.col("row_id.key").alias(self.key)).agg(F.array_sort(F.collect_list(F.struct(F.col("row_id.c").alias("c"), "prob"))).alias("p"))
        return each.select(self.key, M.normal(F.transform("p", lambda p: F.greatest(p["prob"], F.lit(0.0)))).alias("probability"))

    def _ready(self, df: DataFrame) -> Dataset:
        features = self.state["prep"].stages[0].state["keep"]
        given = Dataset.of(df.select(self.key, *features), features, None, keep=(self.key,), kinds=self.state["prep"].stages[0].state.get("kinds"))
        return self.state["prep"].transform(given)

    def _joined(self, ready: Dataset) -> DataFrame:
        """(row_id, prob) of the ensemble, or of the one member."""
        members, (method, learnt) = self.state["members"], self.state["rule"] or (None, None)
        if method is None:
            return self.votes(members[0], ready).select("row_id", "prob")
        used = sorted(learnt) if isinstance(learnt, dict) else range(len(members))
        long = reduce(DataFrame.unionByName, [self.votes(members[i], ready).withColumn("model_id", F.lit(i)) for i in used])
        return E.apply_meta(learnt, long, self.classify) if method in ("blending", "stacking") else E.confidence_weighted(long, learnt) if method == "unnamed" else E.weighted(long, learnt)

    def score(self, df: DataFrame, metric: str | None = None) -> float:
        label = self.state["label"]
        metric = metric or ("acc" if self.classify else "mse")
        truth = df.select(self.key, F.col(label).alias("label"))
        out = self.predict(df).join(truth, self.key)
        if metric in ("auc", "log_loss", "cross_entropy", "pac_score"):
            codes = self.state["codes"]
            out = self.predict_proba(df).join(truth.join(F.broadcast(codes), F.col("label") == F.col("value")).select(self.key, F.col("code").alias("label")), self.key)
        return score(out, metric)

    def refit(self, df: DataFrame) -> AutoML:
        """The chosen pipelines fitted again on all of ``df``."""
        label = self.state["label"]
        ds = Dataset.of(df.where(F.col(label).isNotNull()), None, label, keep=(self.key,))
        ready = self.state["prep"].transform(ds)
        if self.classify:
            coded = encode_labels(ready.df, label, "_code")
            ready = replace(ready, df=coded.drop(label).withColumnRenamed("_code", label))
        best = sorted([t for t in self.state["search"].history if t.status == 0 and t.fidelity == 1.0], key=lambda t: -t.score)
        best = best[: len(self.state["members"])] if self.state["rule"] else [self.state["search"].best]
        self.state["members"] = [[self.pipeline(t.config, ready)] if m else None for t, m in zip(best, self.state["members"])]
        return self

    def trials_frame(self, spark) -> DataFrame:
        search = self.state["search"]
        rows = [(i, str(t.config.get("algorithm")), float(t.score) if t.status == 0 else None, t.status, t.fidelity, t.seconds) for i, t in enumerate(search.history)]
        return spark.createDataFrame(rows, "trial_id int, algorithm string, score double, status int, fidelity double, seconds double")

    def close(self) -> None:
        for k in ("split", "folds"):
            if k in self.state:
                self.state[k].unpersist()


class Classifier(AutoML):
    def __init__(self, key: str, metric: str | Callable = "acc", **kw) -> None:
        super().__init__(key, metric, classify=True, **kw)


class Regressor(AutoML):
    def __init__(self, key: str, metric: str | Callable = "mse", **kw) -> None:
        super().__init__(key, metric, classify=False, **kw)
