"""Iterative fits of one symbol's series, for ``applyInPandas``: a few hundred numbers a symbol, one task each."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def merton(equity: float, volatility: float, debt: float, rate: float = 0.05, years: float = 1.0) -> tuple[float, float, float]:
    """(asset value, asset volatility, distance to default): equity is a call on the assets with the debt as strike."""
    v, s = equity + debt, volatility * equity / (equity + debt)
    for _ in range(200):
        d1 = (math.log(v / debt) + (rate + s * s / 2) * years) / (s * math.sqrt(years))
        n1, n2 = normal_cdf(d1), normal_cdf(d1 - s * math.sqrt(years))
        new = (equity + debt * math.exp(-rate * years) * n2) / max(n1, 1e-12)
        sigma = volatility * equity / (new * max(n1, 1e-12))
        done = abs(new - v) < 1e-10 * v and abs(sigma - s) < 1e-12
        v, s = new, sigma
        if done:
            break
    return v, s, (math.log(v / debt) + (rate - s * s / 2) * years) / (s * math.sqrt(years))


def garch_path(r: np.ndarray, omega: float, alpha: float, beta: float) -> np.ndarray:
    h = np.empty(len(r))
    h[0] = r.var()
    for t in range(1, len(r)):
        h[t] = omega + alpha * r[t - 1] ** 2 + beta * h[t - 1]
    return h


def garch(r: np.ndarray) -> tuple[float, float, float]:
    """(omega, alpha, beta) of GARCH(1,1) by likelihood over a shrinking grid, the variance targeted at the sample's."""
    r = np.asarray(r, float) - np.mean(r)
    var = r.var()
    best = (-math.inf, 0.0, 0.0)
    a0, b0, width = 0.15, 0.7, 0.15
    for _ in range(6):
        for a in np.linspace(max(0.0, a0 - width), a0 + width, 7):
            for b in np.linspace(max(0.0, b0 - 2 * width), b0 + 2 * width, 9):
                if a + b < 0.999:
                    h = np.maximum(garch_path(r, var * (1 - a - b), a, b), 1e-18)
                    like = -0.5 * float(np.sum(np.log(h) + r * r / h))
                    if like > best[0]:
                        best = (like, float(a), float(b))
        (_, a0, b0), width = best, width / 2.5
    return var * (1 - a0 - b0), a0, b0


def cusum(r: np.ndarray) -> tuple[int, float]:
    """(position after which the mean most likely changed, size of the largest standardised deviation)."""
    x = np.cumsum(r - np.mean(r)) / (np.std(r, ddof=1) * math.sqrt(len(r)) or 1.0)
    k = int(np.abs(x).argmax())
    return k + 1, float(abs(x[k]))


def regimes(r: np.ndarray, rounds: int = 200) -> tuple[float, float, np.ndarray]:
    """(calm SD, turbulent SD, posterior of the turbulent state) of a mixture of two zero-mean normals, by EM."""
    r = np.asarray(r, float)
    s1, s2, w = r.std() * 0.7 + 1e-12, r.std() * 1.6 + 1e-12, 0.3
    p = np.full(len(r), w)
    for _ in range(rounds):
        a, b = (1 - w) * np.exp(-0.5 * (r / s1) ** 2) / s1, w * np.exp(-0.5 * (r / s2) ** 2) / s2
        p = b / np.maximum(a + b, 1e-300)
        w = float(p.mean())
        s1 = math.sqrt(float(np.sum((1 - p) * r * r) / max(np.sum(1 - p), 1e-12))) + 1e-12
        s2 = math.sqrt(float(np.sum(p * r * r) / max(np.sum(p), 1e-12))) + 1e-12
    return s1, s2, p


def simplex(v: np.ndarray) -> np.ndarray:
    """The nearest point with non-negative parts that sum to one."""
    u = np.sort(v)[::-1]
    c = np.cumsum(u) - 1
    k = np.nonzero(u - c / np.arange(1, len(u) + 1) > 0)[0][-1]
    return np.maximum(v - c[k] / (k + 1), 0)


def synthetic(target: np.ndarray, donors: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Weights on the simplex that bring the donors (columns) nearest to the target, by projected gradient."""
    w = np.full(donors.shape[1], 1 / donors.shape[1])
    step = 1 / max(np.linalg.norm(donors.T @ donors, 2), 1e-12)
    for _ in range(rounds):
        w = simplex(w - step * donors.T @ (donors @ w - target))
    return w


def fitted(returns: DataFrame) -> DataFrame:
    """(symbol, n, omega, alpha, beta, half_life, calm_sd, turbulent_sd, break_at, break_size) of each symbol's returns; null parts for
    fewer than 20."""
    columns = ["symbol", "n", "omega", "alpha", "beta", "half_life", "calm_sd", "turbulent_sd", "break_at", "break_size"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values("date")["ret"].dropna().to_numpy()
        if len(r) < 20 or r.std() == 0:
            return pd.DataFrame([(pdf["symbol"].iloc[0], len(r), *[None] * 8)], columns=columns)
        omega, a, b = garch(r)
        s1, s2, _ = regimes(r)
        half = math.log(0.5) / math.log(a + b) if 0 < a + b < 1 else None
        return pd.DataFrame([(pdf["symbol"].iloc[0], len(r), omega, a, b, half, s1, s2, *cusum(r))], columns=columns)

    return returns.select("symbol", "date", "ret").groupBy("symbol").applyInPandas(one, "symbol string, n int, omega double, alpha double, beta double, half_life double, calm_sd double, turbulent_sd double, break_at int, break_size double")
