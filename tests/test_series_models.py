"""Seasonal ARIMA and the trend with breaks: exact likelihood, planted coefficients, planted breaks, coverage of the bands."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from callstrata.operators import gram, models, sarima, trend

START = dt.date(2020, 1, 6)


def simulated(n, ar, ma, big_ar, big_ma, seed):
    """Differenced values of a (1,1,1)(1,1,1,7) model and the series itself."""
    rng = np.random.default_rng(seed)
    phi = sarima.Orders._times(np.array([[ar]]), np.array([[big_ar]]), -1.0)[0]
    theta = sarima.Orders._times(np.array([[ma]]), np.array([[big_ma]]), 1.0)[0]
    e, z = rng.normal(0, 1, n + 300), np.zeros(n + 300)
    for t in range(n + 300):
        k = min(t, 8)
        z[t] = e[t] + phi[:k] @ z[t - k:t][::-1] + theta[:k] @ e[t - k:t][::-1]
    w, y = np.cumsum(z[300:]), np.full(n + 7, 100.0)
    for t in range(n):
        y[t + 7] = y[t] + w[t]
    return z[300:], y


def dense_likelihood(z, ar, ma):
    """-2 log likelihood at unit noise, without its constant, from the whole covariance matrix of a short series."""
    psi = np.zeros(4000)
    for k in range(len(psi)):
        psi[k] = (k == 0) + (ma[k - 1] if 0 < k <= len(ma) else 0) + sum(ar[j] * psi[k - 1 - j] for j in range(min(k, len(ar))))
    n = len(z)
    acf = np.array([psi[:len(psi) - k] @ psi[k:] for k in range(n)])
    cov = acf[np.abs(np.subtract.outer(range(n), range(n)))]
    return z @ np.linalg.solve(cov, z) + np.linalg.slogdet(cov)[1]


@pytest.mark.parametrize("p,q,s", [(1, 1, 0), (2, 0, 0), (0, 2, 1), (2, 2, 1)])
def test_the_filter_gives_the_exact_likelihood(p, q, s):
    rng = np.random.default_rng(p * 10 + q)
    orders = sarima.Orders([p], [q], s)
    ar, ma = orders.lags(rng.normal(0, 0.5, (1, orders.size)), np.zeros(1, int))
    z = rng.normal(0, 1, 60)
    err, var, _ = sarima.innovations(z, ar, ma)
    assert abs((err**2 / var).sum() + np.log(var).sum() - dense_likelihood(z, ar[0], ma[0])) < 1e-6


@pytest.mark.parametrize("planted", [(0.5, -0.4, 0.3, -0.6), (-0.5, -0.3, 0.2, -0.7)])
def test_planted_coefficients_are_recovered(planted):
    """Within 0.12 on 1500 days."""
    z, _ = simulated(1500, *planted, seed=1)
    orders, u = sarima.fit(z - z.mean(), [1], [1], 1)
    got = np.tanh(u[0]) * np.array([1, -1, 1, -1])
    assert np.abs(got - planted).max() < 0.12, got


def test_the_fit_is_the_lowest_of_a_fine_grid():
    z = simulated(300, 0.6, -0.3, 0.0, 0.0, seed=2)[0]
    z = z - z.mean()
    orders, u = sarima.fit(z, [1], [1], 0)
    grid = np.linspace(-2.5, 2.5, 61)
    all_u = np.array([(a, b) for a in grid for b in grid])
    cost = (sarima.residuals(z, orders, all_u, np.zeros(len(all_u), int)) ** 2).sum(axis=1)
    best = (sarima.residuals(z, orders, u, np.zeros(1, int)) ** 2).sum()
    assert best <= cost.min() * (1 + 1e-9)


def test_orders_fitted_together_equal_single_fits():
    z = simulated(400, 0.5, -0.3, 0.2, -0.5, seed=3)[0]
    z = z - z.mean()
    pairs = [(p, q) for p in range(3) for q in range(3)]
    together = sarima.criteria(z, *sarima.fit(z, [p for p, _ in pairs], [q for _, q in pairs], 1), 390)
    for i in (0, 4, 7):
        one = sarima.criteria(z, *sarima.fit(z, [pairs[i][0]], [pairs[i][1]], 1), 390)
        assert abs(one[0] - together[i]) < 0.05, pairs[i]


def test_the_chosen_order_has_the_lowest_criterion(spark):
    y = simulated(500, 0.5, -0.4, 0.3, -0.6, seed=4)[1]
    df = spark.createDataFrame([("in", START + dt.timedelta(days=i), float(v)) for i, v in enumerate(y)], "serie string, ds date, y double")
    all_orders = models.ar_candidates(df).collect()
    assert len(all_orders) == 36
    best = models.best_ar(models.ar_candidates(df)).first()
    assert abs(best["aic"] - min(r["aic"] for r in all_orders)) < 1e-9 and best["s"] == 1


def test_the_weekly_model_forecasts_a_planted_series(spark):
    y = simulated(700, 0.5, -0.4, 0.3, -0.6, seed=5)[1]
    path = sarima.forecast(y[:-5], (1, 1, 1, 1), 5)
    naive = np.abs(y[-12:-7] - y[-5:]).mean()
    assert np.abs(path - y[-5:]).mean() < naive


# --- trend -------------------------------------------------------------------------------------


def line(n, breaks, noise, seed, level=100.0):
    """A piecewise line with weekly waves; breaks: (day, change of slope)."""
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    y = level + 0.05 * t + sum(c * np.maximum(t - d, 0) for d, c in breaks)
    return y + np.array([6, 3, 1, 0, -1, -4, -5])[t % 7] + rng.normal(0, noise, n)


def frame(spark, series):
    rows = [(name, START + dt.timedelta(days=i), float(v)) for name, y in series.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "serie string, ds date, y double")


def test_sparse_prior_matches_plain_descent():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 8))
    y = x[:, 2] * 2 + rng.normal(0, 0.1, 80)
    absolute = np.array([0, 0, 3, 3, 3, 3, 3, 3.0])
    w = trend.sparse(x.T @ x, x.T @ y, np.full(8, 0.5), absolute)

    def cost(v):
        return ((y - x @ v) ** 2).sum() / 2 + 0.25 * (v**2).sum() + (absolute * np.abs(v)).sum()

    for j in range(8):
        for step in (-1e-4, 1e-4):
            other = w.copy()
            other[j] += step
            assert cost(other) >= cost(w) - 1e-12
    assert (w[3:] == 0).sum() >= 3


def test_planted_breaks_are_found(spark):
    """Two breaks in two years: the slopes after them are met, and the changes of slope lie next to them."""
    y = line(730, [(220, 0.25), (450, -0.35)], 1.0, 3)
    df = frame(spark, {"in": y})
    ahead = spark.createDataFrame([("in", START + dt.timedelta(days=730 + i)) for i in range(28)], "serie string, ds date")
    got = {r["ds"]: r["yhat"] for r in models.trend_season(df, ahead).collect()}
    truth = line(758, [(220, 0.25), (450, -0.35)], 0.0, 3)[730:]
    assert np.abs(np.array([got[d] for d in sorted(got)]) - truth).mean() < 1.5
    span = df.selectExpr("*", f"DATE'{START}' AS _a", f"DATE'{START + dt.timedelta(days=729)}' AS _b")
    rows = trend.design(span)
    w, noise, _ = trend.solve(gram.merged(gram.moments(rows, "serie", z=F.concat("x", F.array("y"))).toPandas()), float(np.abs(y).max()))
    hinges = w[2:2 + trend.CHANGEPOINTS]
    at = trend.PAST * (np.arange(trend.CHANGEPOINTS) + 1) / (trend.CHANGEPOINTS + 1) * 729
    far = (np.abs(at - 220) > 60) & (np.abs(at - 450) > 60)
    assert 0.8 < noise < 1.3 and np.abs(hinges[far]).sum() < 0.1 * np.abs(hinges).sum() and (hinges == 0).sum() >= 5
    for day, change in ((220, 0.25), (450, -0.35)):
        near = np.abs(at - day) < 60
        assert abs(hinges[near].sum() / 729 - change) < 0.12, (day, hinges[near] / 729)


def test_bands_cover_their_share(spark):
    """95 % bands over 28 days of 60 series of the model's own kind hold between 90 and 99 % of the days."""
    rng = np.random.default_rng(8)
    series = {}
    for k in range(60):
        breaks = [(int(d), float(rng.laplace(0, 0.05))) for d in (*range(20, 320, 16), 404, 420)]
        series[f"s{k}"] = line(428, breaks, 2.0, 100 + k)
    full = frame(spark, series)
    cut = F.lit(START + dt.timedelta(days=400))
    got = models.trend_season(full.where(F.col("ds") < cut), full.where(F.col("ds") >= cut).select("serie", "ds"), level=0.95).join(full, ["serie", "ds"])
    inside = got.agg(F.avg(F.col("y").between(F.col("yhat_lower"), F.col("yhat_upper")).cast("int"))).first()[0]
    assert 0.90 <= inside <= 0.99, inside


def test_bands_widen_and_short_series_work(spark):
    none = np.zeros((2 + trend.CHANGEPOINTS, 2 + trend.CHANGEPOINTS))
    low, high = trend.bands(np.r_[0, 0, np.full(trend.CHANGEPOINTS, 40.0), np.zeros(9)], 1.0, none, 400, 60, 0.8, 1)
    assert (high - low)[-1] > 1.5 * (high - low)[0] and abs((high - low)[0] - 2.56) < 0.3
    tiny = frame(spark, {"a": [3.0], "b": [1.0, 2.0, 3.0]})
    ahead = spark.createDataFrame([(s, START + dt.timedelta(days=40)) for s in ("a", "b")], "serie string, ds date")
    rows = models.trend_season(tiny, ahead).collect()
    assert len(rows) == 2 and all(np.isfinite([r["yhat"], r["yhat_lower"], r["yhat_upper"]]).all() for r in rows)
