import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import automl, ensemble
from plumbline.models import classic, trees
from plumbline.search import optimizers, surrogate
from plumbline.search.blocks import plan
from plumbline.search.space import SearchSpace, categorical, integer, uniform


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(int)
    t = 2 * x[:, 0] - x[:, 2] + 3
    return spark.createDataFrame([(i, *map(float, r), int(a), float(b)) for i, (r, a, b) in enumerate(zip(x, y, t))], "id long, a double, b double, c double, y int, t double").persist()


X = ["a", "b", "c"]


def arrays(df):
    rows = np.array(df.orderBy("id").select(*X, "y", "t").collect(), float)
    return rows[:, :3], rows[:, 3], rows[:, 4]


def test_ridge_and_lasso_solve_their_objectives(data):
    x, _, t = arrays(data)
    xc, tc = x - x.mean(0), t - t.mean()
    assert classic.Ridge(X, "t", alpha=5.0).fit(data).state["w"] == pytest.approx(np.linalg.solve(xc.T @ xc + 5 * np.eye(3), xc.T @ tc))
    w = classic.Lasso(X, "t", alpha=0.3).fit(data).state["w"]
    g = xc.T @ (xc @ w - tc) / len(x)
    assert all(abs(gi + 0.3 * np.sign(wi)) < 1e-8 if wi else abs(gi) <= 0.3 + 1e-8 for gi, wi in zip(g, w)) and w[1] == 0


@pytest.mark.parametrize("make", [lambda: classic.LDA(X, "y"), lambda: classic.QDA(X, "y"), lambda: classic.GaussianNB(X, "y"), lambda: classic.Margin(X, "y"), lambda: classic.Margin(X, "y", loss="logistic", penalty="l1"), lambda: trees.KernelMachine(X, "y"), lambda: trees.AdaBoost(X, "y", n_estimators=4, depth=2), lambda: trees.BalancedBag(X, "y", bags=2), lambda: trees.RandomForestClassifier(X, "y", params={"numTrees": 5})])
def test_classifiers_learn(data, make):
    got = make().fit(data).predict(data)
    assert set(data.columns) <= set(got.columns)
    assert got.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0] > 0.85


@pytest.mark.parametrize("make", [lambda: classic.Margin(X, "t", loss="squared_epsilon", C=10.0), lambda: trees.AdaBoostR2(X, "t", n_estimators=4, depth=5), lambda: trees.GradientBoostingRegressor(X, "t", params={"maxIter": 8})])
def test_regressors_learn(data, make):
    got = make().fit(data).predict(data)
    assert got.agg(1 - F.avg(F.pow(F.col("prediction") - F.col("t"), 2)) / F.var_pop("t")).first()[0] > 0.8


def test_nearest_against_brute_force(data):
    x, y, _ = arrays(data)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = classic.nearest(data.where("id < 20"), data, X, "id", 3, block=100).collect()
    for q in range(20):
        assert [r.neighbour for r in sorted((r for r in got if r.query == q), key=lambda r: r.rank)] == list(np.lexsort((range(400), d[q]))[:3])
    m = classic.NearestNeighbours(X, "y", key="id", k=1).fit(data)
    assert m.predict(data.where("id < 50")).where("prediction <> y").count() == 0
    man = classic.nearest(data.where("id < 3"), data, X, "id", 2, p=1, exclude_self=True).where("rank = 1").collect()
    l1 = np.abs(x[:, None] - x[None]).sum(2) + np.eye(400) * 99
    assert {r.query: r.neighbour for r in man} == {q: int(l1[q].argmin()) for q in range(3)}


def space():
    s = SearchSpace([categorical("algorithm", ["a", "b"]), uniform("x", 0, 1), integer("k", 1, 9, when=("algorithm", ("b",)))])
    s.forbidden.append(lambda c: c.get("k") == 5)
    return s


def test_space():
    s, rng = space(), np.random.default_rng(0)
    for c in s.distinct(50, rng):
        assert ("k" in c) == (c["algorithm"] == "b") and c.get("k") != 5
        assert len(s.vector(c)) == 3
        assert all(n != c for n in s.neighbours(c, rng))


def test_hyperband_brackets():
    h = optimizers.Hyperband(space(), lambda c, f: c["x"])
    b = h.brackets()
    assert [len(x) for x in b] == [5, 4, 3, 2, 1]
    assert b[0] == [(81, 1 / 81), (27, 1 / 27), (9, 1 / 9), (3, 1 / 3), (1, 1.0)] and b[-1] == [(5, 1.0)]


@pytest.mark.parametrize("name", ["random", "smac", "tpe", "hyperband", "bohb", "mfes"])
def test_optimizers_find_the_top(name):
    o = optimizers.build(name, space(), lambda c, f: 1 - (c["x"] - 0.3) ** 2 - (c["algorithm"] == "b") * 0.5)
    o.iterate(4 if name in ("hyperband", "bohb", "mfes") else 30)
    assert o.best.score > 0.98


def test_failures_are_trials():
    def f(c, share):
        raise ValueError("no")

    o = optimizers.build("random", space(), f)
    o.iterate(3)
    assert [t.status for t in o.history] == [optimizers.ERROR] * 3 and o.best is None


def test_arms_are_dropped():
    s = SearchSpace([categorical("algorithm", ["a", "b"]), uniform("x", 0, 1)])
    b = plan(1, s, lambda c, f: 0.9 if c["algorithm"] == "a" else 0.1, ["a", "b"])
    b.iterate(6)
    assert b.alive == ["a"]


def test_surrogates():
    rng = np.random.default_rng(0)
    x = rng.random((40, 2))
    y = np.sin(3 * x[:, 0]) + x[:, 1]
    for m in (surrogate.GaussianProcess(), surrogate.Forest()):
        mean, var = m.fit(x, y).predict(x)
        assert np.corrcoef(mean, y)[0, 1] > 0.9 and (var > 0).all()
    other = surrogate.GaussianProcess().fit(x, -y)
    e = surrogate.RankedEnsemble([other]).fit(x, y)
    assert e.weights[-1] > 0.9
    assert surrogate.acquisition("ei", np.array([0.0, 2.0]), np.array([1.0, 1.0]), 1.0)[1] == pytest.approx(1.0833, abs=1e-3)


def test_ensembles(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 300)
    rows = [(i, m, int(y[i]), float(np.clip(y[i] * 0.6 + 0.2 + rng.normal(0, 0.1 + 0.3 * m), 0, 1))) for i in range(300) for m in range(3)]
    p = spark.createDataFrame(rows, "row_id int, model_id int, label int, prob double")
    w = ensemble.greedy_selection(p, 10)
    assert sum(w.values()) == pytest.approx(1) and max(w, key=w.get) == 0
    assert ensemble.bagging(p).count() == 300 and len(ensemble.diverse_members(p, 2)) == 2
    assert ensemble.sign_distances(p).count() == 3


def test_classifier_end_to_end(spark, data):
    df = data.select("id", *X, F.when(F.col("y") == 1, "yes").otherwise("no").alias("label"))
    a = automl.Classifier("id", trials=3, include_algorithms=["lda", "gaussian_nb"], include_steps={"preprocessor": ["empty"], "rescaler": ["empty", "minmax"]}, ensemble_method="ensemble_selection").fit(df, "label")
    assert a.score(df) > 0.85
    assert {r[0] for r in a.predict(df.drop("label")).select("prediction").distinct().collect()} == {"yes", "no"}
    assert a.trials_frame(spark).count() == 3
    assert a.refit(df).score(df) > 0.85


def test_user_algorithm_and_cv(data):
    automl.add_regressor("mean_of_a", [], lambda f, y, c: classic.Ridge(["a"], y))
    r = automl.Regressor("id", trials=1, evaluation="cv", include_algorithms=["mean_of_a"], include_steps={"preprocessor": ["empty"], "rescaler": ["empty"]}).fit(data.select("id", "a", "t"), "t")
    assert -r.score(data.select("id", "a", "t")) < 2
    del automl.REGRESSORS["mean_of_a"]


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("d", [1, 3])
def test_nearest_looks_at_few_pairs(monkeypatch, d, p):
    rng = np.random.default_rng(d)
    x = np.round(rng.normal(size=(30_000, d)), 2)  # many equal rows and equal distances
    x[:9000] = x[0]
    q = np.vstack([x[8_999:9_400], rng.normal(size=(100, d)) * 5])
    seen = []
    monkeypatch.setattr(classic, "_apart", lambda a, b, p, real=classic._apart: seen.append(len(a) * len(b)) or real(a, b, p))
    r, c = classic.close_pairs(q, x, 5, p)
    assert sum(seen) < 0.25 * len(q) * len(x)
    far = np.abs(q[r] - x[c]).sum(1) if p == 1 else ((q[r] - x[c]) ** 2).sum(1)
    order = np.lexsort((c, far, r))
    for i in range(len(q)):
        gaps = np.abs(q[i] - x).sum(1) if p == 1 else ((q[i] - x) ** 2).sum(1)
        assert [c[j] for j in order if r[j] == i][:5] == np.lexsort((np.arange(len(x)), gaps))[:5].tolist() if i % 50 == 0 else True


def test_nearest_by_tree_gives_what_all_pairs_give(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(b), int(a > 0)) for i, (a, b) in enumerate(np.round(rng.normal(size=(4000, 2)), 1))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int").persist()
    made = []
    for few in (0, 8):
        monkeypatch.setattr(classic, "TREE", few)
        made.append([tuple(r) for r in classic.nearest(df.where("id % 50 = 0"), df, ["a", "b"], "id", 4, carry="y").orderBy("query", "rank").collect()])
    assert made[0] == made[1] and len(made[0]) == 320
