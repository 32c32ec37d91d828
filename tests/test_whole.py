"""Registered queries do the whole job: every row, step and option takes part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import automl, session
from plumbline.operators import balance, neighbours
from plumbline.plans import features, measure, searches
from plumbline.search import optimizers
from plumbline.search.space import SearchSpace, categorical, uniform


def test_streaming_profile_has_the_last_window(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i // 10:02d} 0{i % 10}:30:00", None if i % 7 == 0 else float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(3, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    w = df.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.avg(F.col("value").isNull().cast("double")).alias("missing"))
    want = sorted(tuple(r) for r in w.select("w.start", "w.end", "n", "mean", "missing").collect())
    assert sorted(tuple(r) for r in searches.streaming_profile(spark, str(tmp_path)).collect()) == want and len(want) == 4


def brute(x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def test_neighbours_and_tomek_links_across_blocks(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(1500, 2)) * [100, 1], 1)
    x[:40] = x[0]  # equal points
    x = x[np.lexsort(x.T[::-1])]
    y = rng.integers(0, 2, len(x))
    df = spark.createDataFrame([(i, str(b), float(a[0]), float(a[1])) for i, (a, b) in enumerate(zip(x, y))], "_id long, label string, a double, b double")
    for k, group in ((1, None), (5, None), (5, "label")):
        got = {r["_id"]: list(r["near"]) for r in neighbours.nearest(df, ["a", "b"], k, group, block=64).collect()}
        for part in [np.arange(len(x))] if group is None else [np.flatnonzero(y == c) for c in (0, 1)]:
            want = part[brute(x[part], k)]
            assert all(got[i] == list(w) for i, w in zip(part, want))
    near = brute(x, 1)[:, 0]
    linked = (near[near] == np.arange(len(x))) & (y != y[near])
    left = balance.without_tomek_links(df.select("label", "a", "b"), ["a", "b"], block=64)
    want = sorted((str(c), *map(float, r)) for c, r in zip(y[~linked], x[~linked]))
    assert linked.sum() > 100 and sorted(tuple(r) for r in left.collect()) == want


def test_smote_fills_up_and_cleans_across_blocks(spark):
    df = spark.range(900).select(F.when(F.col("id") % 5 == 0, 1).otherwise(0).alias("y"), F.rand(3).alias("a"), F.rand(4).alias("b"))
    df = spark.createDataFrame(df.collect(), df.schema)
    grown = balance.smote(df, "y", ["a", "b"], block=100, tomek=False)
    assert {r.label: r.n for r in grown.groupBy("label").agg(F.count("*").alias("n")).collect()} == {"0": 720, "1": 720}
    cleaned = sorted(tuple(r) for r in balance.smote(df, "y", ["a", "b"], block=100).collect())
    rows = sorted(tuple(r) for r in grown.collect())
    x, y = np.array([r[1:3] for r in rows]), np.array([r[0] for r in rows])
    near = brute(x, 1)[:, 0]
    linked = (near[near] == np.arange(len(x))) & (y != y[near])
    assert linked.sum() and cleaned == [r for r, out in zip(rows, linked) if not out]


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(600) < 0.1).astype(int)
    rows = [(i, float(rng.normal(1.2 * c)), float(rng.normal()), "rare" if c else "most", float(3 * c + rng.normal())) for i, c in enumerate(y)]
    return spark.createDataFrame(rows, "id int, a double, b double, y string, t double").repartition(2).persist()


@pytest.mark.parametrize("name", ["lda", "gaussian_nb", "random_forest", "liblinear_svc"])
def test_weight_balancer_reaches_the_model(skewed, name):
    rare = []
    for balancer in ("empty", "weight_balancer"):
        steps = {"balancer": [balancer], "preprocessor": ["empty"], "rescaler": ["empty"]}
        a = automl.Classifier("id", trials=1, include_algorithms=[name], include_steps=steps).fit(skewed.drop("t"), "y")
        rare.append(a.predict(skewed).where("prediction = 'rare'").count())
        a.close()
    assert rare[1] > 1.3 * rare[0] and rare[1] > 60


def test_ensembles_do_as_named(skewed):
    steps = {"balancer": ["empty"], "preprocessor": ["empty"], "rescaler": ["empty"]}
    for method, evaluation in (("blending", "holdout"), ("stacking", "holdout"), ("unnamed", "holdout"), ("ensemble_selection", "cv")):
        a = automl.Classifier("id", trials=2, evaluation=evaluation, include_algorithms=["gaussian_nb", "random_forest"], include_steps=steps, ensemble_method=method).fit(skewed.drop("t"), "y")
        assert a.state["rule"][0] == method and a.score(skewed) > 0.88 and a.predict(skewed).count() == 600
        assert method != "stacking" or [len(m) for m in a.state["members"]] == [5, 5]
        assert method != "ensemble_selection" or sum(a.state["rule"][1].values()) == pytest.approx(1)
        a.close()
    r = automl.Regressor("id", trials=3, include_algorithms=["ridge"], include_steps=steps, ensemble_method="blending", ensemble_members=2).fit(skewed.drop("y"), "t")
    assert len(r.state["members"]) == 2 and -r.score(skewed) < 2
    with pytest.raises(ValueError):
        automl.Classifier("id", ensemble_method="staking")
    assert {"knn", "lightgbm", "libsvm_svr"} <= set(automl.REGRESSORS)


def test_search_stops_at_1500_configurations():
    space = SearchSpace([uniform("x", 0, 1)])
    o = optimizers.build("random", space, lambda c, share: c["x"])
    assert o.limit == 1500 and o.iterate(600) and len(o.history) == 600
    assert optimizers.build("random", SearchSpace([categorical("a", [1, 2, 3])]), lambda c, share: 0.0).limit == 3


def test_members_without_a_weight_are_not_fitted_again(skewed, monkeypatch):
    steps = {"balancer": ["empty"], "preprocessor": ["empty"], "rescaler": ["empty", "standard"]}
    made = []
    real = automl.Classifier.pipeline
    monkeypatch.setattr(automl.Classifier, "pipeline", lambda self, c, train: made.append(c) or real(self, c, train))
    monkeypatch.setattr(automl.E, "greedy_selection", lambda long, size: {1: 1.0})
    a = automl.Classifier("id", trials=2, include_algorithms=["lda"], include_steps=steps, ensemble_method="ensemble_selection").fit(skewed.drop("t"), "y")
    assert len(made) == 3 and a.state["members"][0] is None and a.predict(skewed).count() == 600
    assert a.refit(skewed.drop("t")).predict(skewed).count() == 600 and len(made) == 4
    a.close()


def test_registered_with_the_operators_defaults(spark, tmp_path, monkeypatch):
    rows = [(i, i % 7, float(i), "12"[i % 2], "FOP"[i % 3]) for i in range(60)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    kept = []
    monkeypatch.setattr(session, "keep", lambda df, real=session.keep: kept.append(df.columns) or real(df))
    assert [tuple(r) for r in measure.snk_arff(spark, str(tmp_path)).collect()] == [(60,)] and kept == [["feature", "value"]]
    asked = []
    monkeypatch.setattr(measure.PR, "landmarks", lambda ds, key, k=5: asked.append(k) or {})
    monkeypatch.setattr(measure.PR, "as_frame", lambda df, got: df)
    measure.meta_landmarks(spark, str(tmp_path))
    assert asked == [5]
    made = []
    monkeypatch.setattr(features.G, "FastICA", lambda **kw: made.append(kw) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        features.fast_ica(spark, str(tmp_path))
    assert made == [{"n_components": 2}]
