import math

import numpy as np

from tidemark.functions import fits


def test_merton_prices_its_own_equity():
    v, s, d = fits.merton(40.0, 0.6, 70.0)
    d1 = (math.log(v / 70) + 0.05 + s * s / 2) / s
    assert math.isclose(v * fits.normal_cdf(d1) - 70 * math.exp(-0.05) * fits.normal_cdf(d1 - s), 40.0, rel_tol=1e-8)
    assert d < fits.merton(400.0, 0.6, 70.0)[2]


def test_garch_finds_clustering():
    rng = np.random.default_rng(1)
    h, r = 1e-4, []
    for _ in range(1500):
        r.append(math.sqrt(h) * rng.normal())
        h = 1e-5 + 0.2 * r[-1] ** 2 + 0.7 * h
    _, a, b = fits.garch(np.array(r))
    assert 0.1 < a < 0.3 and 0.55 < b < 0.85


def test_regimes_and_break():
    rng = np.random.default_rng(2)
    r = np.concatenate([rng.normal(0, 0.01, 300), rng.normal(0, 0.05, 100)])
    s1, s2, p = fits.regimes(r)
    assert 0.008 < s1 < 0.013 and 0.04 < s2 < 0.065 and p[300:].mean() > 4 * p[:300].mean()
    at, size = fits.cusum(np.concatenate([np.zeros(50), np.ones(50)]) + rng.normal(0, 0.1, 100))
    assert abs(at - 50) <= 2 and size > 3


def test_synthetic_recovers_weights():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 4))
    w = fits.synthetic(x @ np.array([0.5, 0.3, 0.2, 0.0]), x)
    assert np.allclose(w, [0.5, 0.3, 0.2, 0.0], atol=1e-3) and math.isclose(w.sum(), 1.0)


def test_fitted_handles_short_series(spark):
    rows = [("A", f"2024-01-{d:02d}", 0.01 * (-1) ** d * d) for d in range(1, 29)] + [("B", "2024-01-01", None)]
    got = {r.symbol: r for r in fits.fitted(spark.createDataFrame(rows, "symbol string, date string, ret double")).collect()}
    assert got["A"].alpha is not None and got["B"].alpha is None and got["B"].n == 0
