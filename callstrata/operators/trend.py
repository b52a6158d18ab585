"""Trend with breaks and weekly waves, fitted from moments under a sparse prior on the breaks.

Slope changes have a Laplace prior, all other coefficients a wide normal one, and the noise is found together with them:
each round solves a penalised least-squares problem on the moments of the design (proximal steps), then takes
the noise from its residuals. The bands hold simulated paths: the noise, trends that the history allows as well, and coming breaks as
frequent and as large as those of the past.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callstrata.operators import gram

# Breaks in the first part of the history, scale of the priors, weekly waves.
CHANGEPOINTS, PAST, CHANGE_SCALE, WIDE, WEEK_PAIRS = 25, 0.8, 0.05, 10.0, 3
PATHS, ROUNDS, STEPS = 1000, 6, 2000


def design(df: DataFrame, first: str = "_a", last: str = "_b") -> DataFrame:
    """Design columns ``x``: one, scaled time, hinges, weekly waves, weekday, start of month and week of month."""
    t = F.datediff("ds", first) / F.greatest(F.datediff(last, first), F.lit(1))
    hinges = [F.greatest(F.lit(0.0), t - F.lit(PAST * (i + 1) / (CHANGEPOINTS + 1))) for i in range(CHANGEPOINTS)]
    day = F.datediff("ds", F.lit("1970-01-01").cast("date"))
    waves = [fn(2 * F.pi() * k * day / 7) for k in range(1, WEEK_PAIRS + 1) for fn in (F.sin, F.cos)]
    more: list[Column] = [F.weekday("ds") + 1, (F.dayofmonth("ds") <= 5).cast("int"), F.floor((F.dayofmonth("ds") - 1) / 7) + 1]
    return df.withColumn("x", F.array(F.lit(1.0), t, *hinges, *waves, *[c.cast("double") for c in more]))


def sparse(square: np.ndarray, right: np.ndarray, ridge: np.ndarray, absolute: np.ndarray) -> np.ndarray:
    """Minimiser of w'Aw/2 - b'w + ridge w^2/2 + absolute |w|: alternating proximal steps, then an exact solve on what is not zero."""
    a = square + np.diag(ridge)
    rho = max(float(np.mean(np.diag(a)[absolute > 0])) * 0.1, 1e-12) if (absolute > 0).any() else 1.0
    inverse = np.linalg.inv(a + rho * np.eye(len(a)))
    z, u = np.zeros(len(right)), np.zeros(len(right))
    for _ in range(STEPS):
        w = inverse @ (right + rho * (z - u))
        new = np.sign(w + u) * np.maximum(np.abs(w + u) - absolute / rho, 0.0)
        u = u + w - new
        done = np.abs(new - z).max() < 1e-10 * (1 + np.abs(new).max()) and np.abs(w - new).max() < 1e-8 * (1 + np.abs(new).max())
        z = new
        if done:
            break
    on = (z != 0) | (absolute == 0)
    out = np.zeros(len(z))
    out[on] = np.linalg.solve(a[np.ix_(on, on)], right[on] - absolute[on] * np.sign(z[on]))
    return out if (out[on] * z[on] >= 0).all() else z


def solve(total: tuple, scale: float) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients and noise (in units of y) from the moments of (x, y) of a series, and the covariance of the trend's coefficients."""
    n, mean, cross = total
    raw = cross + n * np.outer(mean, mean)
    p = len(mean) - 1
    square, right, yy = raw[:p, :p], raw[:p, p] / scale, raw[p, p] / scale**2
    hinge = np.zeros(p, bool)
    hinge[2:2 + CHANGEPOINTS] = True
    noise = max(yy / n - (right[0] / n) ** 2, 1e-8)
    w = np.zeros(p)
    for _ in range(ROUNDS):
        w = sparse(square, right, np.where(hinge, 0.0, noise / WIDE**2) + 1e-9, np.where(hinge, noise / CHANGE_SCALE, 0.0))
        noise = max((yy - 2 * w @ right + w @ square @ w) / n, 1e-8)
    # around the solution, a normal prior of the Laplace prior's variance stands in for it
    tight = np.where(hinge, 1 / (2 * CHANGE_SCALE**2), 1 / WIDE**2)
    spread = np.linalg.inv(square / noise + np.diag(tight))[:2 + CHANGEPOINTS, :2 + CHANGEPOINTS]
    return w * scale, float(np.sqrt(noise)) * scale, spread * scale**2


def bands(w: np.ndarray, noise: float, spread: np.ndarray, days: int, ahead: int, level: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper offsets of the days 0 to ``ahead`` after a history of ``days`` days; coming breaks start to count on day 1."""
    rng = np.random.default_rng(seed)
    length = max(days, 1)
    size = np.abs(w[2:2 + CHANGEPOINTS]).mean() / length  # change of slope per day
    happens = rng.random((PATHS, ahead)) < min(CHANGEPOINTS / (PAST * length), 1.0)
    slope = np.cumsum(np.where(happens, rng.laplace(0.0, 1.0, (PATHS, ahead)) * size, 0.0), axis=1)
    t = 1.0 + np.arange(ahead + 1) / length
    shape = np.vstack([np.ones(ahead + 1), t, *(t - PAST * (i + 1) / (CHANGEPOINTS + 1) for i in range(CHANGEPOINTS))])
    shape -= shape[:, :1]  # from the end of the history on, whose level is known
    value, vector = np.linalg.eigh(spread)
    drawn = rng.normal(0, 1, (PATHS, len(value))) @ (vector * np.sqrt(np.maximum(value, 0.0))).T
    path = np.concatenate([np.zeros((PATHS, 1)), np.cumsum(slope, axis=1)], axis=1) + drawn @ shape + rng.normal(0, noise, (PATHS, ahead + 1))
    return np.quantile(path, (1 - level) / 2, axis=0), np.quantile(path, (1 + level) / 2, axis=0)


def trend_season(daily: DataFrame, days: DataFrame, by=("serie",), hol: DataFrame | None = None, level: float = 0.8) -> DataFrame:
    """(keys, ds, modelo, yhat, yhat_lower, yhat_upper) for the days asked for; the bands hold the share ``level``."""
    keys = list(by)
    last_asked = days.groupBy(*keys).agg(F.max("ds").alias("_c"))
    span = daily.groupBy(*keys).agg(F.min("ds").alias("_a"), F.max("ds").alias("_b"), F.greatest(F.max(F.abs("y")).cast("double"), F.lit(1.0)).alias("_s")).join(last_asked, keys)
    known = daily.select(*keys, "ds", F.col("y").cast("double").alias("y"), F.lit(False).alias("_new"))
    asked = days.select(*keys, "ds", F.lit(None).cast("double").alias("y"), F.lit(True).alias("_new"))
    rows = design(known.unionByName(asked).join(span, keys))
    if hol is not None:
        from callstrata.operators.calendar import mark_holidays
        rows = mark_holidays(rows, hol).withColumn("x", F.concat("x", F.array(F.col("es_feriado").cast("double"))))
    seen = gram.moments(rows.where(~F.col("_new")), *keys, z=F.concat("x", F.array("y"))).join(span, keys)
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in daily.select(*keys).schema)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        w, noise, spread = solve(gram.merged(pdf), float(pdf["_s"].iloc[0]))
        a, b, c = (pd.Timestamp(pdf[k].iloc[0]) for k in ("_a", "_b", "_c"))
        own = [pdf[k].iloc[0] for k in keys]
        low, high = bands(w, noise, spread, (b - a).days, max((c - b).days, 0), level, zlib.crc32("|".join(map(str, own)).encode()))
        return pd.DataFrame([(*own, w.tolist(), noise, low.tolist(), high.tolist())], columns=[*keys, "pesos", "ruido", "bajo", "alto"])

    models = gram.spread(seen, *keys).groupBy(*keys).applyInPandas(fit, f"{head}, pesos array<double>, ruido double, bajo array<double>, alto array<double>")
    yhat = F.aggregate(F.zip_with("pesos", "x", lambda w, x: w * x), F.lit(0.0), lambda a, v: a + v)
    at = F.greatest(F.datediff("ds", "_b"), F.lit(0))
    return rows.where("_new").join(models, keys).withColumn("yhat", yhat).select(
        *keys, "ds", F.lit("prophet").alias("modelo"), "yhat", (F.col("yhat") + F.col("bajo")[at]).alias("yhat_lower"), (F.col("yhat") + F.col("alto")[at]).alias("yhat_upper"))
