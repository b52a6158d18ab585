"""Forecast models: regressors over the feature table, and per-series time-series models.

Linear models come from additive moments and trees from grouped rows, all series and folds in one job
(``gram``, ``trees``). ``estimator`` builds the same kinds as ``pyspark.ml`` pipelines, for one large table and for
models that are saved. Seasonal ARIMA (``sarima``) and the trend with breaks (``trend``) are fitted per series; Spark spreads
them by series, fold and differencing.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Mapping

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import MinMaxScaler, RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callstrata.operators import ensemble, gram, sarima, trees
from callstrata.operators.trend import trend_season
from callstrata.operators.features import TRAIN_COLS, training_features

SEED = 42
LINEAR_KINDS = ("linear", "ridge", "lasso", "elastic_net")
TREE_KINDS = ("random_forest", "gradient_boosting", "decision_tree")

# --- pyspark.ml regressors ---------------------------------------------------------------------


def estimator(kind: str, n: int = 1, y_std: float = 1.0, alpha: float = 1.0, l1_ratio: float = 0.5, **params) -> Pipeline:
    """Unfitted pipeline of a model kind over the training columns.

    ``n`` and ``y_std`` are the rows and the population deviation of the label in
    the training set. Penalties are stated for a summed squared error (ridge) or
    half the mean squared error (lasso, elastic net). Spark uses the mean form
    and divides the squared part of the penalty by the label's deviation, so the
    two parts are restated here.
    """
    vec = VectorAssembler(inputCols=TRAIN_COLS, outputCol="x")
    trees = {"featuresCol": "x", "labelCol": "y", "seed": SEED}
    if kind == "random_forest":
        reg = RandomForestRegressor(**{**trees, "numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 2,
                                       "featureSubsetStrategy": "all", "cacheNodeIds": True, **params})
    elif kind == "gradient_boosting":
        reg = GBTRegressor(**{**trees, "maxIter": 100, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8, **params})
    elif kind == "decision_tree":
        reg = DecisionTreeRegressor(**{**trees, "maxDepth": 10, **params})
    else:
        square, absolute = {"linear": (0.0, 0.0), "ridge": (alpha / max(n, 1), 0.0), "lasso": (0.0, alpha),
                            "elastic_net": (alpha * (1 - l1_ratio), alpha * l1_ratio)}[kind]
        reg_param = absolute + square * (y_std or 1.0)
        mix = absolute / reg_param if reg_param else 0.0
        scale = StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=True)
        reg = LinearRegression(featuresCol="z", labelCol="y", elasticNetParam=mix, regParam=reg_param,
                               standardization=False, **params)
        return Pipeline(stages=[vec, scale, reg])
    return Pipeline(stages=[vec, reg])


def scaler(kind: str) -> Pipeline:
    """Feature vector scaled to unit deviation, to [0, 1], or by median and quartile range."""
    cls = {"standard": StandardScaler, "minmax": MinMaxScaler, "robust": RobustScaler}[kind]
    more = {"standard": {"withMean": True}, "minmax": {}, "robust": {"withCentering": True}}[kind]
    return Pipeline(stages=[VectorAssembler(inputCols=TRAIN_COLS, outputCol="x"),
                            cls(inputCol="x", outputCol="z", **more)])


def fit(train: DataFrame, kind: str, **params) -> PipelineModel:
    if kind in LINEAR_KINDS:
        n, y_std = train.agg(F.count(F.lit(1)), F.stddev_pop("y")).first()
        params = {"n": n, "y_std": y_std, **params}
    return estimator(kind, **params).fit(train)


def predict(model: PipelineModel, rows: DataFrame, name: str, keep: Iterable[str] = ("serie", "ds", "y")) -> DataFrame:
    return model.transform(rows).select(*keep, F.lit(name).alias("modelo"), F.col("prediction").alias("yhat"))


def by_key(seen: DataFrame, ahead: DataFrame, kind: str, by: Iterable[str] = ("serie",), **params) -> DataFrame:
    """(keys, ds, modelo, yhat): one model of the kind per key, fitted on ``seen`` and applied to ``ahead``, all keys in one job."""
    if kind in TREE_KINDS:
        return trees.by_series(seen, ahead, kind, by, **params)
    return gram.apply(gram.coefficients(seen, kind, by, **params), ahead, by).select(*by, "ds", "modelo", "yhat")


def train_and_score(feat: DataFrame, kind: str, types: Iterable[str] | None = None, share: float = 0.8, **params) -> DataFrame:
    """Fit on the first part of each call type and predict the rest: (serie, ds, y, modelo, yhat)."""
    from callstrata.session import checkpointed

    if types is not None:
        feat = feat.where(F.col("serie").isin(*types))
    parts = checkpointed(ensemble.time_split(feat, share))
    test = parts.where("parte = 'test'")
    got = by_key(parts.where("parte = 'train'"), test, kind, **params)
    return got.join(test.select("serie", "ds", "y"), ["serie", "ds"]).select("serie", "ds", "y", "modelo", "yhat")


MASK = "entrena"


def usable(df: DataFrame) -> DataFrame:
    """Rows that may train or test a model: all, where the series carries no mask."""
    return df.where(F.col(MASK)) if MASK in df.columns else df


# --- features of days to come ------------------------------------------------------------------


def features_through(daily: DataFrame, days: DataFrame) -> DataFrame:
    """Feature rows of the history and of coming days in one pass; ``futuro`` marks the latter.

    The history is extended by the weekday mean of its series; the window
    features are then taken over the extended series, so a lag that reaches back
    into history is the known value and a later one is the expected value. The
    frames only look back, so history rows are what they are without the extension.
    """
    may = F.col(MASK) if MASK in daily.columns else F.lit(True)
    ahead = ensemble.weekday_baseline(days, usable(daily)).select(
        "serie", "ds", F.col("base").alias("y"), F.lit(True).alias("futuro"), F.lit(True).alias(MASK))
    known = daily.select("serie", "ds", F.col("y").cast("double").alias("y"), F.lit(False).alias("futuro"), may.alias(MASK))
    return training_features(known.unionByName(ahead), "futuro", MASK)


def future_features(daily: DataFrame, days: DataFrame) -> DataFrame:
    """Feature rows of coming days."""
    return features_through(daily, days).where("futuro").drop("futuro", MASK)


def ridge_by_series(seen: DataFrame, ahead: DataFrame, alpha: float = 1.0, by=("serie",)) -> DataFrame:
    """(keys, ds, modelo, yhat): the scaled ridge of ``estimator`` for every series in one job."""
    return by_key(seen, ahead, "ridge", by, alpha=alpha)


# --- seasonal ARIMA per series -----------------------------------------------------------------

AR_ORDERS = [(p, d, q, s) for p in range(3) for d in range(2) for q in range(3) for s in (0, 1)]
_WEEK = sarima.WEEK


def _common_start(n: int) -> int:
    """Days left out of every order's criterion: what the differencings take, or half of a short series."""
    return min(_WEEK + 1, n // 2)


def ar_candidates(daily: DataFrame, by=("serie",), orders=tuple(AR_ORDERS)) -> DataFrame:
    """AIC of every order for every series, from the likelihood of the same days; each (series, differencing) is a group that
    fits its orders together. Null where a series is too short for an order."""
    keys = list(by)
    kinds = sorted({(d, s) for _, d, _, s in orders})
    spec = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(s).alias("s")) for d, s in kinds]))
    rows = daily.select(*keys, "ds", F.col("y").cast("double").alias("y"), spec.alias("k")).select(*keys, "ds", "y", "k.d", "k.s")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in daily.select(*keys).schema)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("ds")["y"].to_numpy()
        d, s = int(pdf["d"].iloc[0]), int(pdf["s"].iloc[0])
        row = {k: pdf[k].iloc[0] for k in keys}
        own = [(p, q) for p, d2, q, s2 in orders if (d2, s2) == (d, s)]
        long = [(p, q) for p, q in own if sarima.enough(len(y), p, d, q, s)]
        found = {}
        if long:
            z = sarima.difference(y, d, s)
            z = z - z.mean()
            fitted, u = sarima.fit(z, [p for p, _ in long], [q for _, q in long], s)
            found = dict(zip(long, sarima.criteria(z, fitted, u, len(y) - max(_common_start(len(y)), len(y) - len(z)))))
        return pd.DataFrame([{**row, "p": p, "d": d, "q": q, "s": s, "aic": float(found[p, q]) if (p, q) in found else None} for p, q in own])

    groups = [*keys, "d", "s"]
    return gram.spread(rows, *groups).groupBy(*groups).applyInPandas(score, f"{fields}, p int, d int, q int, s int, aic double")


def best_ar(candidates: DataFrame, by=("serie",)) -> DataFrame:
    """The order of smallest AIC; (0, 0, 0), the mean, where none could be fitted."""
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last("aic"), "p", "d", "q", "s")
    best = candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    none = F.col("aic").isNull()
    return best.select(*by, *[F.when(none, 0).otherwise(F.col(c)).alias(c) for c in "pdqs"], "aic")


def ar_forecast(daily: DataFrame, best: DataFrame, days: DataFrame, by=("serie",)) -> DataFrame:
    """(keys, ds, modelo, yhat): the best order of each series run forward over the days asked for."""
    keys = list(by)
    asked = days.select(*keys, "ds", F.lit(None).cast("double").alias("y"), F.lit(True).alias("_f"))
    known = daily.select(*keys, "ds", F.col("y").cast("double").alias("y"), F.lit(False).alias("_f"))
    rows = known.unionByName(asked).join(best.select(*keys, "p", "d", "q", "s"), keys)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in daily.select(*keys).schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        hist, want = pdf[~pdf["_f"]], pdf[pdf["_f"]]
        if hist.empty or want.empty:
            return pd.DataFrame({c: [] for c in [*keys, "ds", "modelo", "yhat"]})
        last = pd.Timestamp(hist["ds"].iloc[-1])
        steps = (pd.to_datetime(want["ds"]) - last).dt.days.to_numpy()
        spec = tuple(int(pdf[c].iloc[0]) for c in "pdqs")
        path = sarima.forecast(hist["y"].to_numpy(), spec, int(steps.max()))
        return want[[*keys, "ds"]].assign(modelo="arima", yhat=path[steps - 1])

    return gram.spread(rows, *keys).groupBy(*keys).applyInPandas(run, f"{fields}, ds date, modelo string, yhat double")


# --- cross-validation over time ----------------------------------------------------------------


def fold_pairs(daily: DataFrame, models: Iterable[str] = ("arima", "prophet", "ridge"), splits: int = 5, gap: int = 7,
               params: Mapping[str, dict] | None = None) -> DataFrame:
    """(serie, fold, ds, y, modelo, yhat) for the test rows of every fold.

    The per-series models run with the fold and the series as one key, so folds are
    fitted side by side; the fold stands first, so any name of a series can be
    taken back out. The regressors see features built from the training rows of
    their fold only. Days that the mask excludes neither train nor test.
    """
    from callstrata.session import checkpointed

    models, params = list(models), params or {}
    mask = [MASK] if MASK in daily.columns else []
    folds = checkpointed(ensemble.cv_folds(daily.select("serie", "ds", "y", *mask), splits, gap))
    key = F.concat_ws("#", F.col("fold").cast("string"), "serie")
    named = folds.withColumn("serie", key)
    train, test = named.where("parte = 'train'").drop("parte"), usable(named.where("parte = 'test'").drop("parte"))
    preds = []
    if "arima" in models:
        best = best_ar(ar_candidates(train))
        preds.append(ar_forecast(train, best, test).select("serie", "ds", "modelo", "yhat"))
    if "prophet" in models:
        preds.append(trend_season(usable(train), test).select("serie", "ds", "modelo", "yhat"))
    kinds = [m for m in models if m in (*LINEAR_KINDS, *TREE_KINDS)]
    if kinds:
        # The days between the end of training and the end of the test rows, so that lags are contiguous.
        span = train.groupBy("serie").agg(F.max("ds").alias("_a")).join(
            test.groupBy("serie").agg(F.max("ds").alias("_b")), "serie")
        days = span.select("serie", F.explode(F.sequence(F.date_add("_a", 1), "_b")).alias("ds"))
        rows = checkpointed(features_through(train, days))
        seen = usable(rows.where(~F.col("futuro")))
        ahead = rows.where("futuro").join(test.select("serie", "ds"), ["serie", "ds"], "left_semi")
        preds += [by_key(seen, ahead, kind, **params.get(kind, {})) for kind in kinds]
    out = functools.reduce(DataFrame.unionByName, preds)
    parts = F.split("serie", "#", 2)
    return out.join(test.select("serie", "ds", "y"), ["serie", "ds"]).select(
        parts[1].alias("serie"), parts[0].cast("int").alias("fold"), "ds", "y", "modelo", "yhat")


def temporal_cv(pairs: DataFrame) -> DataFrame:
    """Pooled error metrics of the folds per series and model."""
    return ensemble.evaluate_folds(pairs)


# --- the combined forecast ---------------------------------------------------------------------


def predictions(daily: DataFrame, days: DataFrame, types: Iterable[str] | None = None,
                models: Iterable[str] = ("arima", "prophet", "random_forest", "gradient_boosting", "ridge"),
                params: Mapping[str, dict] | None = None) -> DataFrame:
    """(serie, ds, modelo, yhat) of every model refitted on the whole history; of the call types given, or of all."""
    from callstrata.session import checkpointed

    models, params, preds = list(models), params or {}, []
    if types is not None:
        daily, days = (x.where(F.col("serie").isin(*types)) for x in (daily, days))
    if "arima" in models:
        preds.append(ar_forecast(daily, best_ar(ar_candidates(daily)), days))
    if "prophet" in models:
        preds.append(trend_season(usable(daily), days).select("serie", "ds", "modelo", "yhat"))
    kinds = [m for m in models if m in (*LINEAR_KINDS, *TREE_KINDS)]
    if kinds:
        rows = checkpointed(features_through(daily, days))
        seen, ahead = usable(rows.where(~F.col("futuro"))), rows.where("futuro")
        preds += [by_key(seen, ahead, kind, **params.get(kind, {})) for kind in kinds]
    return functools.reduce(DataFrame.unionByName, preds)
