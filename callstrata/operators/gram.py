"""Linear models from additive moments: one aggregate of the rows serves every model, fold and penalty.

A segment of a series is reduced to its row count, means and centred cross products of the features and the
label. Moments of segments add up (without cancellation, as they are centred), so the training rows of every fold are
sums of segments, and both the fit and its squared error on any set of rows follow from moments alone; the rows
are read once. Ridge is a solve, lasso and elastic net are coordinate descent for many penalties at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callstrata.operators.features import TRAIN_COLS

#: Penalties that one task works on at a time.
BLOCK = 64
SWEEPS, TOLERANCE = 10_000, 1e-9


def vector(cols: Iterable[str] = TRAIN_COLS) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


# --- moments -----------------------------------------------------------------------------------


def moments(rows: DataFrame, *keys: str, z: Column | None = None) -> DataFrame:
    """(keys, n, mean, cross): partial moments of the vector ``z`` (the training features and y), one row per key and task; ``merged`` adds them up."""
    keys = list(keys)
    plain = rows.select(*keys, (F.concat(vector(), F.array(F.col("y").cast("double"))) if z is None else z).alias("z"))
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple] = {}
        for batch in batches:
            for key, own in batch.groupby(keys, dropna=False)["z"]:
                key, z = tuple(None if pd.isna(v) else v for v in key), np.vstack(own.to_numpy())
                mean = z.mean(axis=0)
                held[key] = add(held.get(key), (len(z), mean, (z - mean).T @ (z - mean)))
        out = [(*key, n, mean.tolist(), cross.ravel().tolist()) for key, (n, mean, cross) in held.items()]
        yield pd.DataFrame(out, columns=[*keys, "n", "mean", "cross"])

    return plain.mapInPandas(reduce, f"{head}, n bigint, mean array<double>, cross array<double>")


def add(a: tuple | None, b: tuple | None) -> tuple | None:
    """Moments of two sets of rows together."""
    if a is None or b is None:
        return a if b is None else b
    n = a[0] + b[0]
    d = b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def merged(pdf: pd.DataFrame) -> tuple | None:
    """The moments of all rows of a frame of partial moments."""
    total = None
    for n, mean, cross in zip(pdf["n"], pdf["mean"], pdf["cross"], strict=True):
        mean = np.asarray(mean, dtype=float)
        total = add(total, (int(n), mean, np.asarray(cross, dtype=float).reshape(len(mean), len(mean))))
    return total


# --- fits --------------------------------------------------------------------------------------


def penalties(kind: str, combo: Mapping) -> tuple[float, float, int]:
    """(absolute, square, sweeps) of a combination. Ridge's penalty is stated for the summed squared error (its square part is per row, see ``solve``)."""
    alpha, l1 = float(combo.get("alpha", 1.0)), float(combo.get("l1_ratio", 0.5))
    absolute, square = {"linear": (0.0, 0.0), "ridge": (0.0, alpha), "lasso": (alpha, 0.0), "elastic_net": (alpha * l1, alpha * (1 - l1))}[kind]
    return absolute, square, int(combo.get("maxIter", SWEEPS))


def descend(gram: np.ndarray, c: np.ndarray, absolute: np.ndarray, square: np.ndarray, sweeps: np.ndarray) -> np.ndarray:
    """Minimisers of w'Gw/2 - c'w + absolute |w|_1 + square |w|^2/2, a row per penalty; all descend together, coordinate by coordinate."""
    w = np.zeros((len(absolute), len(c)))
    moving = np.ones(len(absolute), bool)
    used = np.flatnonzero(np.diag(gram) > 0)
    for sweep in range(int(sweeps.max(initial=0))):
        moving &= sweep < sweeps
        if not moving.any():
            break
        old = w[moving]
        new = old.copy()
        for j in used:
            r = c[j] - new @ gram[:, j] + gram[j, j] * new[:, j]
            new[:, j] = np.sign(r) * np.maximum(np.abs(r) - absolute[moving], 0.0) / (gram[j, j] + square[moving])
        w[moving] = new
        moving[moving] = np.abs(new - old).max(axis=1) > TOLERANCE * (1.0 + np.abs(new).max(axis=1))
    return w


def solve(train: tuple, kind: str, combos: list[Mapping]) -> tuple[np.ndarray, np.ndarray]:
    """(intercepts, weights of the raw features) of the combinations, from the moments of the training rows. The
    features are scaled to a sample deviation of one for the penalty; a constant feature gets no weight."""
    n, mean, cross = train
    p = len(mean) - 1
    dev = np.sqrt(np.diag(cross)[:p] / max(n - 1, 1))
    real = dev > 1e-12 * (1.0 + np.abs(mean[:p]))
    scale = np.where(real, 1.0 / np.where(real, dev, 1.0), 0.0)
    gram = cross[:p, :p] * scale[:, None] * scale[None, :] / n
    c = cross[:p, p] * scale / n
    parts = [penalties(kind, combo) for combo in combos]
    if kind in ("linear", "ridge"):
        w = np.array([np.linalg.lstsq(gram + np.eye(p) * square / n, c, rcond=1e-12)[0] for _, square, _ in parts])
    else:
        absolute, square, sweeps = (np.array([x[k] for x in parts]) for k in range(3))
        w = descend(gram, c, absolute, square, sweeps)
    w = w * scale
    return mean[p] - w @ mean[:p], w


def mse(rows: tuple, intercept: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Mean squared error of each model over the rows that the moments stand for."""
    n, mean, cross = rows
    v = np.column_stack([-w, np.ones(len(w))])
    return np.maximum(np.einsum("ij,jk,ik->i", v, cross, v), 0.0) / n + (v @ mean - intercept) ** 2


# --- as Spark jobs -----------------------------------------------------------------------------


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by key over as many tasks as the session shuffles to; few bytes would otherwise be put into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def coefficients(rows: DataFrame, kind: str, by: Iterable[str] = ("serie",), **params) -> DataFrame:
    """(keys, modelo, n, corte, pesos): one fitted model per key, for every key in one job."""
    keys = list(by)
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        total = merged(pdf)
        b, w = solve(total, kind, [params])
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "modelo": kind, "n": total[0], "corte": float(b[0]), "pesos": w[0].tolist()}])

    return spread(moments(rows, *keys), *keys).groupBy(*keys).applyInPandas(fit, f"{head}, modelo string, n bigint, corte double, pesos array<double>")


def apply(models: DataFrame, rows: DataFrame, by: Iterable[str] = ("serie",)) -> DataFrame:
    """``rows`` with the model's name and its prediction ``yhat``; rows of a key without model are left out."""
    terms = F.zip_with(F.col("pesos"), vector(), lambda w, x: w * x)
    yhat = F.aggregate(terms, F.col("corte"), lambda a, v: a + v)
    return rows.join(models.drop("n"), list(by)).withColumn("yhat", yhat).drop("corte", "pesos")


def segments(feat: DataFrame, k: int) -> DataFrame:
    """Rows with ``tramo``: of the expanding folds 0 to k-1, fold f trains on the segments up to f and is tested on segment f + 1."""
    from callstrata.operators.ensemble import numbered

    size = F.floor(F.col("_n") / (k + 1))
    first = F.col("_n") - k * size
    later = F.col("_r") - first
    return numbered(feat).where(size > 0).withColumn(
        "tramo", F.when(later <= 0, 0).otherwise(F.floor((later - 1) / size) + 1).cast("int")).drop("_n", "_r")


def search(feat: DataFrame, combos: Mapping[str, list[Mapping]], k: int = 5) -> DataFrame:
    """(serie, modelo, combinacion, fold, n, mse_train, mse_test) of every combination of every kind on every expanding fold.

    The moments of a segment go to the folds that use it; a group is one series, fold and block of combinations.
    """
    parts = moments(segments(feat.select("serie", "ds", "y", *TRAIN_COLS), k), "serie", "tramo")
    blocks = [(kind, lo) for kind, own in combos.items() for lo in range(0, len(own), BLOCK)]
    if not blocks:
        return feat.sparkSession.createDataFrame([], "serie string, modelo string, combinacion int, fold int, n bigint, mse_train double, mse_test double")
    folds = F.sequence(F.greatest(F.col("tramo") - 1, F.lit(0)), F.lit(k - 1))
    jobs = parts.withColumn("fold", F.explode(folds)).withColumn("bloque", F.explode(F.array(*[F.lit(i) for i in range(len(blocks))])))
    out = "serie string, modelo string, combinacion int, fold int, n bigint, mse_train double, mse_test double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fold = int(pdf["fold"].iloc[0])
        kind, lo = blocks[int(pdf["bloque"].iloc[0])]
        own = combos[kind][lo:lo + BLOCK]
        train, test = merged(pdf[pdf["tramo"] <= fold]), merged(pdf[pdf["tramo"] == fold + 1])
        if train is None or test is None:
            return pd.DataFrame(columns=["serie", "modelo", "combinacion", "fold", "n", "mse_train", "mse_test"])
        b, w = solve(train, kind, own)
        return pd.DataFrame({"serie": pdf["serie"].iloc[0], "modelo": kind, "combinacion": np.arange(lo, lo + len(own)), "fold": fold,
                             "n": train[0], "mse_train": mse(train, b, w), "mse_test": mse(test, b, w)})

    keys = ["serie", "fold", "bloque"]
    return spread(jobs, *keys).groupBy(*keys).applyInPandas(run, out)
