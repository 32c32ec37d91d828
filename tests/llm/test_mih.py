import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import mih

SCHEMA = "task_id string, dataset_embedding array<float>, arrived_at timestamp"


def brute(vectors, k=5):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids])
    out = {}
    for i, a in enumerate(ids):
        d = ((x - x[i]) ** 2).sum(1)
        out[a] = [ids[j] for j in sorted(range(len(ids)), key=lambda j: (d[j], ids[j])) if j != i][:k]
    return out


def table(spark, vectors, extra=()):
    rows = [(t, [float(x) for x in v], None) for t, v in vectors.items()] + list(extra)
    return spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("clash")).withColumn("vec", F.lit(1))


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, 32)) * 3
    x = np.where(rng.random((n, 1)) < 0.6, centres[rng.integers(0, 40, n)] + rng.normal(size=(n, 32)) * 0.1, rng.normal(size=(n, 32)) * 3)
    return {f"t{i:05d}": np.round(v * 256).astype(np.float32).astype(np.float64) / 256 for i, v in enumerate(x)}


def test_copies_ties_and_unusable(spark):
    v = clustered(60, 1)
    names = list(v)
    for t in names[:25]:
        v[t] = v[names[0]]
    v[names[30]] = -v[names[31]] * 0.0
    v[names[32]] = v[names[30]] + np.eye(32)[0]
    v[names[33]] = v[names[30]] - np.eye(32)[0]
    inf, nan = float("inf"), float("nan")
    bad = [("b0", None, None), ("b1", [], None), ("b2", [1.0] * 31, None), ("b3", [None] + [1.0] * 31, None), ("b4", [nan] + [1.0] * 31, None), ("b5", [inf] + [1.0] * 31, None), (None, [1.0] * 32, None), (names[40], [float(x) for x in v[names[40]]], None)]
    df = table(spark, v, bad)
    got = {r.task_id: [n.id for n in r.near] for r in mih.nearest(mih.usable_vectors(df), per_value=1000).collect()}
    assert got == brute(v)
    pairs = {tuple(r) for r in mih.similar_pairs(df).collect()}
    assert pairs == {(min(a, b), max(a, b)) for a, bs in brute(v).items() for b in bs}


def test_recall_with_split_indexes(spark):
    v = clustered(3000, 2)
    names = list(v)
    centre = v[names[0]]
    rng = np.random.default_rng(5)
    for t in names[:1000]:  # a third of all lies close together
        v[t] = centre + np.round(rng.normal(size=32) * 4) / 256
    want = brute(v)
    got = {r.task_id: [n.id for n in r.near] for r in mih.nearest(mih.usable_vectors(table(spark, v)), per_value=64, per_task=300).collect()}
    assert set(got) == set(v) and all(len(x) == 5 and t not in x for t, x in got.items())
    assert sum(len(set(want[t]) & set(got[t])) for t in v) / (5 * len(v)) > 0.9


def test_every_code_within_the_radius_is_probed():
    rng = np.random.default_rng(3)
    code = mih.learn(rng.normal(size=(500, 32)), 6, 8)
    x = rng.normal(size=(300, 32)).astype(np.float32)
    whole, values = code.encode(x), code.values(x)
    assert whole.shape == (300, 48) and code.substrings == 8
    hamming = (whole[:, None] != whole[None]).sum(2)
    for radius in (7, 15, 23):
        masks = mih.ball(6, radius // 8)
        reached = np.isin(values[:, None] ^ values[None], masks).any(2)
        assert reached[hamming <= radius].all() and not reached.all()


def test_a_radius_of_all_bits_is_exact(spark):
    v = clustered(400, 9)
    got = {r.task_id: [n.id for n in r.near] for r in mih.nearest(mih.usable_vectors(table(spark, v)), per_value=20, per_task=40, radius=1000).collect()}
    assert got == brute(v)


def test_hot_classes_give_the_same(spark):
    v = clustered(90, 4)
    names = list(v)
    for t in names[:40]:
        v[t] = v[names[0]]
    got = {r.task_id: [n.id for n in r.near] for r in mih.nearest(mih.usable_vectors(table(spark, v)), per_value=1000, hot=20).collect()}
    assert got == brute(v)


def test_few(spark):
    assert mih.similar_pairs(table(spark, {}, [("x", None, None)])).count() == 0
    assert mih.similar_pairs(table(spark, {"a": np.ones(32)})).count() == 0
    assert [tuple(r) for r in mih.similar_pairs(table(spark, {"a": np.ones(32), "b": np.ones(32)})).collect()] == [("a", "b")]


def test_bound_is_never_under_the_smallest():
    rng = np.random.default_rng(2)
    for n in (7, 100, 256, 1001):
        d = np.round(rng.normal(size=(40, n)), 1)
        got, want = mih.not_under(d, 5), np.sort(d, axis=1)[:, 5]
        assert (got >= want).all() and ((d <= got[:, None]).sum(1) < max(60, n / 5)).all()
