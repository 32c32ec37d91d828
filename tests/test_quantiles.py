import numpy as np
import pytest

from plumbline.operators import quantiles


@pytest.mark.parametrize("rows", [1_000_000, 40])
def test_against_numpy(spark, monkeypatch, rows):
    monkeypatch.setattr(quantiles, "ROWS", rows)
    monkeypatch.setattr(quantiles, "BINS", 16)
    rng = np.random.default_rng(3)
    a = rng.lognormal(0, 3, 2000)  # nearly all in one bin
    b = rng.integers(0, 5, 2000).astype(float)
    c = np.where(rng.random(2000) < 0.3, np.nan, rng.normal(size=2000))
    d = np.full(2000, 7.0)
    df = spark.createDataFrame([(float(x), float(y), None if i % 9 == 0 else float(z), float(w), None, int(y)) for i, (x, y, z, w) in enumerate(zip(a, b, c, d))], "a double, b double, c double, d double, e double, f int")
    qs = [0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = quantiles.exact_quantiles(df, dict.fromkeys("abcdef", qs))
    cc = np.array([z for i, z in enumerate(c) if i % 9 and z == z])
    for name, x in (("a", a), ("b", b), ("c", cc), ("d", d), ("f", b)):
        assert got[name] == pytest.approx(np.quantile(x, qs), rel=1e-12), name
    assert got["e"] is None
    one = quantiles.exact_quantiles(df.limit(1), {"a": [0.5]})["a"]
    assert len(one) == 1
    assert quantiles.exact_quantiles(df.limit(0), {"a": [0.5]}) == {"a": None}


def test_far_outliers_leave_no_large_bin(spark, monkeypatch):
    """Values that equal widths can't tell apart are cut again on other scales; the number of cuts makes no difference."""
    monkeypatch.setattr(quantiles, "ROWS", 500)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=19_000), rng.normal(size=990) * 1e-30, [1e300, 1e150, -1e307, 1e307, 5e-324]])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    qs = [0.0, 0.01, 0.25, 0.5, 0.51, 0.975, 1.0]
    got = quantiles.exact_quantiles(df, {"v": qs})["v"]
    assert np.allclose(got, np.quantile(x, qs), rtol=1e-9, atol=0)
    monkeypatch.setattr(quantiles, "CUTS", 2)
    assert np.allclose(quantiles.exact_quantiles(df, {"v": qs})["v"], got, rtol=0, atol=0)
