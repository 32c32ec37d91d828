"""Feature operators on small arrays with results worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.dataset import Chain, Dataset
from plumbline.operators import balance, clean, generate, scale, select, split
from plumbline.operators.stats import beta_inc, chi2_tail, f_tail

F1 = [(0.0, 1.2, 2.0, 1.0, 1), (0.0, 1.0, 2.0, 1.0, 2), (0.0, 3.0, 2.0, 2.0, 3), (0.0, 5.0, 4.0, 5.0, 4)]


@pytest.fixture
def f1(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(F1)], "id int, a double, b double, c double, d double, y int")
    return Dataset.of(df, ["a", "b", "c", "d"], "y", keep=("id",))


def column(ds, name):
    return [r[0] for r in ds.df.orderBy("id").select(f"`{name}`").collect()]


def test_variance_and_minmax(f1):
    assert select.Variance().fit_transform(f1).features == ["b", "c", "d"]
    m = scale.MinMax().fit_transform(f1)
    assert column(m, "a") == [0, 0, 0, 0]
    assert column(m, "b") == pytest.approx([0.05, 0, 0.5, 1])
    assert column(m, "d") == pytest.approx([0, 0, 0.25, 1])
    assert m.history == ("minmax",) and m.label == "y"


def test_bins(f1):
    b = scale.Bins(n_bins=3).fit_transform(f1)
    assert [column(b, c) for c in "abcd"] == [[0, 0, 0, 0], [0, 0, 1, 2], [0, 0, 0, 2], [0, 0, 0, 2]]


def test_normalize(f1):
    n = scale.Normalize().fit_transform(f1)
    assert [column(n, c)[1] for c in "abcd"] == pytest.approx([0, 0.408248, 0.816497, 0.408248], abs=1e-6)


def test_standard_robust_quantile(f1):
    assert column(scale.Standard().fit_transform(f1), "c") == pytest.approx((np.array([2, 2, 2, 4]) - 2.5) / np.std([2, 2, 2, 4]))
    assert column(scale.Robust().fit_transform(f1), "b") == pytest.approx((np.array([1.2, 1, 3, 5]) - 2.1) / (3.5 - 1.15))
    q = scale.Quantile(n_quantiles=4).fit_transform(f1)
    assert column(q, "b") == pytest.approx([1 / 3, 0, 2 / 3, 1])
    assert column(q, "c") == pytest.approx([0, 0, 0, 1])  # the lower bound maps to 0
    g = column(scale.Quantile(n_quantiles=4, output="normal").fit_transform(f1), "b")
    assert g[0] == pytest.approx(-0.430727, abs=1e-5) and g[1] == pytest.approx(-5.199338, abs=1e-4)


def test_impute_onehot_chain(spark):
    df = spark.createDataFrame([(0, None, 2.0, "1", 1), (1, 1.0, 2.0, "2", 2), (2, 3.0, 4.0, "2", 3), (3, 5.0, None, "1", 4), (4, float("nan"), 2.0, None, 4)], "id int, a double, b double, c string, y int")
    ds = Dataset.of(df, ["a", "b", "c"], "y", keep=("id",))
    med = clean.Impute().fit_transform(ds)
    assert column(med, "a") == [3, 1, 3, 5, 3] and column(med, "b") == [2, 2, 4, 2, 2]
    assert column(med, "c")[4] == "1"  # of equally frequent values the smallest
    mean = clean.Impute(strategy="mean").fit_transform(ds)
    assert column(mean, "b")[3] == pytest.approx(2.5)
    chain = Chain(clean.Impute(), clean.OneHot())
    out = chain.fit_transform(ds)
    assert out.features == ["a", "b", "c_1", "c_2"]
    unseen = chain.transform(Dataset.of(spark.createDataFrame([(9, 1.0, 1.0, "zz", 1)], df.schema), ["a", "b", "c"], "y", keep=("id",)))
    assert [column(unseen, c)[0] for c in ("c_1", "c_2")] == [0, 0]


def test_discrete_categories(spark):
    df = spark.createDataFrame([(0.0, 1.2, 2, 1), (0.01, 1.0, 2, 1), (0.02, 3.0, 2, 2), (0.015, 5.0, 4, 5), (0.12, 3.0, 2, 2), (0.16, 5.0, 4, 5)], "a double, b double, c int, d int")
    out = clean.DiscreteCategories().fit_transform(Dataset.of(df))
    assert out.features == ["a", "b", "c_2", "c_4", "d_1", "d_2", "d_5"]


def test_kinds(spark):
    df = spark.createDataFrame([(str(i) if i else "bad", f"w{i}" if i else "7", float(i), i + 0.5, None) for i in range(40)], "a string, b string, c double, d double, e string")
    kinds = clean.infer_kinds(df)
    assert kinds == {"a": ("discrete", "numbers"), "b": ("categorical", "texts"), "c": ("discrete", "none"), "d": ("numerical", "none"), "e": ("categorical", "none")}
    t = clean.typed(df, kinds)
    assert t.agg(F.count("a"), F.count("b")).first()[:] == (39, 39)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "a double, b string, y int")
    ds = Dataset.of(df, label="y")
    for stage in (scale.MinMax(), scale.Standard(), scale.Robust(), scale.Bins(), scale.Quantile(), clean.Impute(), clean.OneHot(), select.Variance(), generate.Arithmetic()):
        assert stage.fit_transform(ds).df.count() == 0


def test_generators(f1):
    p = generate.Polynomial(targets=["b", "c"]).fit_transform(f1)
    assert p.features[4:] == ["b*b", "b*c", "c*c"] and column(p, "b*c") == pytest.approx([2.4, 2, 6, 20])
    x = np.array([r[1:4] for r in F1])
    pc = generate.PCA(targets=["b", "c", "d"], keep=0.9).fit_transform(f1)
    top = np.linalg.eigvalsh(np.cov(x.T, bias=True))[-1]
    assert np.var(column(pc, "pc0")) == pytest.approx(top)
    sv = generate.SVD(targets=["b", "c", "d"], target_dim=1).fit_transform(f1)
    assert np.sum(np.square(column(sv, "sv0"))) == pytest.approx(np.linalg.svd(x)[1][0] ** 2)
    rows = generate.TreeEmbedding(n_trees=5).fit_transform(f1)
    assert [sum(r[c] for c in rows.features) for r in rows.df.select(*[f"`{c}`" for c in rows.features]).collect()] == [5.0] * 4
    z = generate.agglomerate(np.array([[0, 1, 9], [1, 0, 9], [9, 9, 0.0]]), 2)
    assert z == [[0, 1], [2]]


def test_ica_separates(spark):
    rng = np.random.default_rng(0)
    s = np.stack([rng.uniform(-1, 1, 1500), np.sign(rng.normal(size=1500)) * rng.exponential(size=1500)], axis=1)
    x = s @ np.array([[1, 0.5], [0.3, 1]])
    ds = Dataset.of(spark.createDataFrame(x.tolist(), "a double, b double"))
    for algorithm in ("parallel", "deflation"):
        got = np.array(generate.FastICA(algorithm=algorithm).fit_transform(ds).df.collect())
        c = np.abs(np.corrcoef(got.T, s.T)[:2, 2:])
        assert c.max(axis=1).min() > 0.95


def test_kernels_follow_their_matrix(f1):
    x = np.array([r[1:4] for r in F1])
    for kernel in ("rbf", "poly", "sigmoid", "cosine", "chi2"):
        points = x[:2]
        want = generate.kernel_matrix(x, points, kernel, 0.1, 2, 1.0)
        got = np.array(f1.df.orderBy("id").select(*[generate.kernel_column(["b", "c", "d"], p, kernel, 0.1, 2, 1.0) for p in points]).collect())
        assert got == pytest.approx(want)


def test_tails():
    assert chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert chi2_tail(0.5, 3) == pytest.approx(0.918891, abs=1e-5)
    assert f_tail(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert f_tail(0.5, 5, 20) == pytest.approx(0.772494, abs=1e-3)
    assert beta_inc(2, 3, 0.4) == pytest.approx(0.5248)


def test_selection_rules():
    p = {"a": 0.001, "b": 0.02, "c": 0.04, "d": 0.5}
    assert select.rejected_null(p, "fpr", 0.05) == {"a", "b", "c"}
    assert select.rejected_null(p, "fwe", 0.05) == {"a"}
    assert select.rejected_null(p, "fdr", 0.05) == {"a", "b"}


def test_splits(spark):
    df = spark.range(1000).withColumn("y", F.when(F.col("id") % 10 == 0, "rare").otherwise("most"))
    h = split.holdout(df, "id", 0.33, "y").groupBy("y").agg(F.sum(F.col("is_test").cast("int")).alias("n")).collect()
    assert {r.y: r.n for r in h} == {"rare": 33, "most": 297}
    assert [r.n for r in split.folds(df, "id", 5).groupBy("fold").agg(F.count("*").alias("n")).collect()] == [200] * 5
    small, large = (split.subsample(df, "id", r).select("id") for r in (0.1, 0.3))
    assert small.count() == 100 and small.exceptAll(large).count() == 0


def test_oversample_and_smote(spark):
    df = spark.range(1100).select("id", F.when(F.col("id") < 100, 1).otherwise(0).alias("y"), F.rand(3).alias("a"), F.rand(4).alias("b"))
    n = {r.y: r.n for r in balance.oversample(df, "y", "id").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert n == {0: 1000, 1: 330}
    grown = balance.smote(df, "y", ["a", "b"], tomek=False)
    assert {r.label: r.n for r in grown.groupBy("label").agg(F.count("*").alias("n")).collect()} == {"0": 1000, "1": 1000}
    box = df.where("y = 1").agg(F.min("a"), F.max("a")).first()
    made = grown.where("synthetic").agg(F.min("a"), F.max("a")).first()
    assert box[0] <= made[0] and made[1] <= box[1]
    assert balance.smote(df, "y", ["a", "b"]).count() <= 2000


@pytest.mark.parametrize("kernel", ["rbf", "chi2"])
@pytest.mark.parametrize("kind", [generate.Nystroem, generate.KernelPCA])
def test_kernel_features_hold_each_kernel_once(spark, kernel, kind):
    rows = [(i, float(i % 7), None if i == 5 else float(i % 5) / 2, i % 2) for i in range(60)]
    ds = Dataset.of(spark.createDataFrame(rows, "id long, b double, c double, y int"), ["b", "c"], "y", keep=("id",))
    stage = kind(kernel=kernel, n_components=6)
    out = scale.MinMax().fit_transform(stage.fit_transform(ds))
    assert out.df.columns == ["id", "y", *out.features] and out.df.count() == 60
    plan = out.df._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and plan.count("EXP(") == 0
    new = stage.transform(ds)
    points, kernels = stage.state["points"], [generate.kernel_column(["b", "c"], p, kernel, 0.1, 3, 1.0).alias(f"k{i}") for i, p in enumerate(stage.state["points"])]
    assert len(points) == 6
    _, w, add = stage.weights()
    for r, k in zip(new.df.orderBy("id").collect(), ds.df.orderBy("id").select(*kernels).collect()):
        if None in list(k):
            assert r["id"] == 5 and all(r[f] is None for f in new.features)
        else:
            assert np.allclose([r[f] for f in new.features], np.array(k) @ w + add, rtol=1e-5, atol=1e-5)


def test_word_vectors_are_fitted_in_parts(spark, monkeypatch):
    from pyspark.ml.feature import Word2Vec

    asked = []
    monkeypatch.setattr(Word2Vec, "fit", lambda self, df, real=Word2Vec.fit: asked.append((self.getNumPartitions(), df.count())) or real(self, df))
    rows = [(i, f"alpha beta gamma w{i % 9}") for i in range(90)] + [(90, None), (91, "once")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for words, parts in ((1000, 1), (50, 8)):
        monkeypatch.setattr(generate, "WORDS", words, raising=False)
        got = {r[0]: r[1] for r in generate.TextVectors(size=4).embed(df, "text").collect()}
        assert asked.pop() == (parts, 91) and len(got) == 92
        assert all(any(got[i]) for i in range(90)) and got[90] == got[91] == [0.0] * 4
