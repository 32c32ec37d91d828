"""Probabilities, metrics by class, time limits, imbalanced boosting, kernel machines and the advisor."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import automl
from plumbline.models import classic, trees
from plumbline.operators import metrics
from plumbline.search import optimizers, trials
from plumbline.search.space import SearchSpace, uniform

X = ["a", "b"]
STEPS = {"balancer": ["empty"], "preprocessor": ["empty"], "rescaler": ["empty"]}


@pytest.fixture(scope="module")
def three(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(360, 2))
    y = np.where(x[:, 0] > 0.6, 2, np.where(x[:, 1] > 0, 1, 0))
    return spark.createDataFrame([(i, float(a), float(b), int(c), float(3 * np.sin(a) + b)) for i, ((a, b), c) in enumerate(zip(x, y))], "id long, a double, b double, y int, t double").persist()


MODELS = [
    lambda: classic.LDA(X, "y"), lambda: classic.QDA(X, "y"), lambda: classic.GaussianNB(X, "y"), lambda: classic.Margin(X, "y", steps=20), lambda: classic.NearestNeighbours(X, "y", key="id", k=5), lambda: trees.KernelMachine(X, "y", gamma=0.5),
    lambda: trees.AdaBoost(X, "y", n_estimators=4, depth=3), lambda: trees.BalancedBag(X, "y", bags=2), lambda: trees.RUSBoost(X, "y", n_estimators=4), lambda: trees.GradientBoostingClassifier(X, "y", params={"maxIter": 3}), lambda: trees.RandomForestClassifier(X, "y", params={"numTrees": 5}), lambda: trees.ExtraTrees(X, "y", trees=8, depth=6),
]


@pytest.mark.parametrize("make", MODELS)
def test_every_classifier_gives_probabilities_by_class(three, make):
    got = make().fit(three).predict(three).select("y", "prediction", "probability").collect()
    assert len(got) == 360
    for r in got:
        assert len(r.probability) == 3 and min(r.probability) >= 0 and sum(r.probability) == pytest.approx(1)
    assert np.mean([r.prediction == r.y for r in got]) > 0.8
    assert np.mean([np.argmax(r.probability) == r.prediction for r in got]) > 0.97


def test_metrics_of_arrays(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet(np.ones(3), size=200)
    y = np.array([rng.choice(3, p=q) for q in p])
    df = spark.createDataFrame([(int(a), [float(v) for v in q]) for a, q in zip(y, p)], "label int, probability array<double>")
    value = lambda n: metrics.METRICS[n][0](df).first()[0]
    loss = -np.mean(np.log(p[np.arange(200), y]))
    assert value("log_loss") == pytest.approx(loss)
    areas = []
    for c in range(3):
        s, other = p[y == c, c], p[y != c, c]
        areas.append(np.mean((s[:, None] > other[None]) + 0.5 * (s[:, None] == other[None])))
    assert value("auc") == pytest.approx(np.mean(areas))
    share = np.bincount(y) / 200
    prior = np.exp(np.sum(share * np.log(share)))
    assert value("pac_score") == pytest.approx((np.exp(-loss) - prior) / (1 - prior))
    two = df.select((F.col("label") == 1).cast("int").alias("label"), F.array(1 - F.get("probability", F.lit(1)), F.get("probability", F.lit(1))).alias("probability"))
    assert metrics.score(two, "auc") == pytest.approx(areas[1])
    assert metrics.score(two.select("label", F.get("probability", F.lit(1)).alias("probability")), "log_loss") == pytest.approx(metrics.score(two, "log_loss"))


@pytest.mark.parametrize("metric", ["auc", "log_loss", "pac_score", "f1"])
def test_a_search_by_each_metric_and_its_probabilities(three, metric):
    df = three.select("id", "a", "b", F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.col("y") + 1).alias("label"))
    a = automl.Classifier("id", metric=metric, trials=2, include_algorithms=["lda", "gaussian_nb"], include_steps=STEPS, ensemble_method="stacking" if metric == "auc" else "blending" if metric == "f1" else None).fit(df, "label")
    assert all(t.status == 0 for t in a.state["search"].history)
    assert a.classes() == ["x", "y", "z"]
    got = a.predict_proba(df).join(a.predict(df), "id").collect()
    assert len(got) == 360 and all(sum(r.probability) == pytest.approx(1) for r in got)
    assert np.mean([a.classes()[int(np.argmax(r.probability))] == r.prediction for r in got]) > 0.99
    assert np.isfinite(a.score(df, metric))


def test_time_limits(three):
    a = automl.Classifier("id", trials=50, include_algorithms=["lda"], include_steps=STEPS, time_limit=3.0).fit(three.select("id", "a", "b", "y"), "y")
    assert 0 < len(a.state["search"].history) < 50
    slow = three.select(F.pandas_udf(lambda s: time.sleep(60) or s, "double")("a").alias("s"))
    o = optimizers.RandomSearch(SearchSpace([uniform("u", 0, 1)]), lambda c, share: slow.agg(F.sum("s")).first()[0], per_run=1.5)
    began = time.time()
    o.iterate(1)
    assert o.history[0].status == optimizers.TIMEOUT and time.time() - began < 30
    assert three.count() == 360  # later jobs aren't cancelled


def test_rusboost_samples_before_each_round(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), int(a + 0.3 * b > 1.6)) for a, b in rng.normal(size=(3000, 2))]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    rus, easy = trees.RUSBoost(X, "y", n_estimators=6, depth=2).fit(df), trees.BalancedBag(X, "y", bags=2, base="boost").fit(df)
    assert len(rus.state["trees"]) >= 2 and "models" in easy.state
    seen = [t.state["model"].toDebugString for t, _ in rus.state["trees"]]
    assert len(set(seen)) == len(seen)
    got = rus.predict(df).groupBy("y").agg(F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("r")).collect()
    assert all(r.r > 0.8 for r in got)


def test_extra_trees_count_what_they_say(three):
    """Each leaf holds the shares of the rows that reach it, thresholds are drawn anew in each tree, and noise has little importance."""
    df = three.withColumn("noise", F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0)
    m = trees.ExtraTrees([*X, "noise"], "y", trees=6, depth=5, candidates=2).fit(df)
    assert len({s[1] for s in m.state["splits"]}) == 6
    rows = np.array(df.select(*X, "noise", "y").collect(), float)
    for splits, leaves in zip(m.state["splits"], m.state["leaves"]):
        node = np.ones(len(rows), int)
        for parent, (f, cut) in sorted(splits.items()):
            at = node == parent
            node[at] = 2 * parent + (rows[at, f] > cut)
        for n in set(node):
            assert list(leaves[n]) == list(np.bincount(rows[node == n, 3].astype(int), minlength=3))
    gain = m.importances()
    assert sum(gain.values()) == pytest.approx(1) and gain["noise"] < min(gain["a"], gain["b"])
    assert m.predict(df).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0] > 0.85
    r = trees.ExtraTrees(X, "t", trees=10, depth=7, regress=True).fit(df).predict(df)
    assert r.agg(1 - F.avg(F.pow(F.col("prediction") - F.col("t"), 2)) / F.var_pop("t")).first()[0] > 0.9


def test_kernel_machine_against_numpy(three):
    """At the solution the objective's slope is zero, and circles and waves are learnt."""
    m = trees.KernelMachine(X, "t", gamma=0.5, C=100.0, loss="squared_epsilon").fit(three)
    got = m.predict(three)
    assert got.agg(1 - F.avg(F.pow(F.col("prediction") - F.col("t"), 2)) / F.var_pop("t")).first()[0] > 0.95
    ring = three.withColumn("r", (F.col("a") * F.col("a") + F.col("b") * F.col("b") > 1).cast("int"))
    c = trees.KernelMachine(X, "r", gamma=0.5, C=10.0).fit(ring)
    rows = np.array(ring.select("a", "b", "r").collect(), float)
    w, b = c.state["planes"][1]
    points = c.state["points"]
    k = lambda p, q: np.exp(-0.5 * ((p[:, None] - q[None]) ** 2).sum(2))
    z, norm, sign = k(rows[:, :2], points), k(points, points), np.where(rows[:, 2] == 1, 1, -1)
    objective = lambda v: np.mean(np.maximum(1 - sign * (z @ v[:-1] + v[-1]), 0) ** 2) + v[:-1] @ norm @ v[:-1] / (10.0 * len(rows))
    at = np.r_[w, b]
    rng = np.random.default_rng(0)
    assert all(objective(at) <= objective(at + rng.normal(size=len(at)) * s) + 1e-6 for s in (1e-3, 1e-2, 0.1) for _ in range(30))
    assert c.predict(ring).agg(F.avg((F.col("prediction") == F.col("r")).cast("double"))).first()[0] > 0.93


def test_advice_follows_a_planted_rule(spark):
    """z does well where the first entry is large, b where it is small; y is always in between and a always last."""
    rng = np.random.default_rng(6)
    runs, vectors = [], []
    for i in range(40):
        v = rng.normal(size=32)
        v[0] = 1.0 if i % 2 else -1.0
        vectors.append((f"t{i}", f"d{i}", [float(x) for x in v]))
        for name, score in (("a", 0.1), ("b", 0.2 if i % 2 else 0.9), ("y", 0.5), ("z", 0.9 if i % 2 else 0.2)):
            runs.append((len(runs), f"d{i}", f" {name.upper()}", score))
    runs.append((999, None, "b", 1.0))
    got = trials.advise(spark.createDataFrame(runs, "trial_id long, dataset_id string, estimator_id string, perf double"), spark.createDataFrame(vectors, "task_id string, dataset_id string, dataset_embedding array<float>"), 4).collect()
    order = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        order.setdefault(r.dataset_id, []).append(r.algorithm)
    right = sum(order[f"d{i}"] == (["z", "y", "b", "a"] if i % 2 else ["b", "y", "z", "a"]) for i in range(40))
    assert right >= 38
    empty = spark.createDataFrame([], "trial_id long, dataset_id string, estimator_id string, perf double")
    assert trials.advise(empty, spark.createDataFrame(vectors, "task_id string, dataset_id string, dataset_embedding array<float>")).count() == 0


def test_filling_balancers_change_what_is_learnt(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(b), int(a + 0.5 * b > 1.9)) for i, (a, b) in enumerate(rng.normal(size=(900, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    recall = {}
    for name in ("empty", "data_balancer", "smote_balancer"):
        m = automl.Classifier("id", trials=1, include_algorithms=["lda"], include_steps={**STEPS, "balancer": [name]}).fit(df, "y")
        got = m.predict(df).join(df.where("y = 1"), "id")
        recall[name] = got.agg(F.avg((F.col("prediction") == 1).cast("double"))).first()[0]
    assert recall["data_balancer"] > recall["empty"] and recall["smote_balancer"] == recall["data_balancer"]
    with pytest.raises(ValueError):
        automl.Regressor("id", include_steps={"balancer": ["data_balancer"]})


def test_signed_impact(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(float(a), float(b), int(a - 2 * b + 0.3 * e > 0)) for a, b, e in rng.normal(size=(500, 3))], "a double, b double, y int")
    from plumbline.explain import linear_impact

    got = {r.feature: r.value for r in linear_impact(df, ["a", "b"], "y").collect()}
    assert got["a"] > 0 > got["b"] and abs(got["b"]) > abs(got["a"])
