"""Fitted models, cross-validation, the combined forecast and parameter search."""

from __future__ import annotations

import functools

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callstrata.functions import quantiles
from callstrata.operators import calendar, ensemble, features, gram, models, tuning
from callstrata.plans.fixtures import Views
from callstrata.plans.q_forecast import _NUM
from callstrata.plans.q_insight import _CAL, _CYC, _CYC_COLS, _LAGS, _ROLL_COLS, _roll
from callstrata.plans.registry import query
from callstrata.session import checkpointed, shared_dir
from callstrata.sources.sinks import save_model


def _feat(v: Views):
    return checkpointed(features.training_features(v.daily))


def _scored(v: Views, kind: str, **params):
    return ensemble.error_metrics(models.train_and_score(_feat(v), kind, **params))


def _win_sql(src: str) -> str:
    """Training features over a series table, as SQL."""
    rolls = ", ".join(f"{_roll('avg(y)', n, 1)} AS media_movil_{n}, {_roll('stddev_samp(y)', n, 1)} AS std_movil_{n}" for n in features.ROLLS)
    return f"""SELECT * FROM (SELECT serie, ds, CAST(y AS DOUBLE) AS y, {_CAL}, {_CYC}, {_LAGS}, {rolls}, {_roll('regr_slope(y,p)', 7, 1)} AS tendencia_7d,
      avg(y) OVER (PARTITION BY serie, isodow(ds) ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dow_previa
      FROM (SELECT *, row_number() OVER (PARTITION BY serie ORDER BY ds) AS p FROM {src})) WHERE lag_14 IS NOT NULL AND media_movil_14 IS NOT NULL AND dow_previa IS NOT NULL"""


_DBL = f"y {_CYC_COLS} {_ROLL_COLS} tendencia_7d dow_previa"
_LAG_DBL = " ".join(features.LAG_COLS)


@query("training_features", _win_sql("daily"), dbl=_DBL + " " + _LAG_DBL)
def _(v: Views):
    return features.training_features(v.daily)


_EXT = """(SELECT serie, ds, CAST(y AS DOUBLE) AS y FROM daily UNION ALL SELECT f.serie, f.ds, coalesce(w.m,o.m) FROM future f JOIN
  (SELECT serie, avg(y) m FROM daily GROUP BY 1) o USING (serie) LEFT JOIN (SELECT serie, isodow(ds) d, avg(y) m FROM daily GROUP BY 1,2) w
  ON w.serie=f.serie AND w.d=isodow(f.ds))"""


@query("future_features", f"SELECT * FROM ({_win_sql(_EXT)}) WHERE (serie, ds) IN (SELECT serie, ds FROM future)", dbl=_DBL + " " + _LAG_DBL)
def _(v: Views):
    return models.future_features(v.daily_table, calendar.future_days(v.daily_table, 28))


@query("train_rf")
def _(v: Views):
    return _scored(v, "random_forest")


@query("train_gbt")
def _(v: Views):
    return _scored(v, "gradient_boosting")


@query("train_ridge")
def _(v: Views):
    return _scored(v, "ridge")


@query("linear_family")
def _(v: Views):
    feat = _feat(v)
    out = None
    for kind, params in (("linear", {}), ("lasso", {"alpha": 0.1}), ("elastic_net", {"alpha": 0.1}), ("decision_tree", {})):
        part = models.train_and_score(feat, kind, **params)
        out = part if out is None else out.unionByName(part)
    return ensemble.error_metrics(out)


def _scaled(v: Views, kind: str):
    feat = _feat(v)
    z = vector_to_array("z")
    done = models.scaler(kind).fit(feat).transform(feat)
    cols = {c: models.TRAIN_COLS.index(c) for c in ("lag_1", "media_movil_7", "dia_mes")}
    return done.select("serie", "ds", *[z[i].alias(c) for c, i in cols.items()])


_SC = "lag_1 media_movil_7 dia_mes"


@query("scale_standard", "SELECT serie, ds, " + ", ".join(f"({c}-avg({c}) OVER ())/stddev_samp({c}) OVER () AS {c}" for c in _SC.split())
       + f" FROM ({_win_sql('daily')})", dbl=_SC)
def _(v: Views):
    return _scaled(v, "standard")


@query("scale_minmax", "SELECT serie, ds, " + ", ".join(f"({c}-min({c}) OVER ())/(max({c}) OVER ()-min({c}) OVER ()) AS {c}" for c in _SC.split())
       + f" FROM ({_win_sql('daily')})", dbl=_SC)
def _(v: Views):
    return _scaled(v, "minmax")


def _q(c: str, p: float) -> str:
    return f"quantile_cont({c}::DOUBLE, {p}) AS {c}_{int(p * 100)}"


_QUARTILES = "SELECT " + ", ".join(_q(c, p) for c in _SC.split() for p in (0.25, 0.5, 0.75)) + f" FROM ({_win_sql('daily')})"


@query("scale_robust", "SELECT serie, ds, " + ", ".join(f"({c}-{c}_50)/({c}_75-{c}_25) AS {c}" for c in _SC.split())
       + f" FROM ({_win_sql('daily')}), ({_QUARTILES})", dbl=_SC)
def _(v: Views):
    """By exact medians and quartiles."""
    return quantiles.robust_scaled(_feat(v), _SC.split()).select("serie", "ds", *_SC.split())


@query("exact_quantiles", "SELECT columna, prob, valor FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS columna, {p}::DOUBLE AS prob, quantile_cont({c}::DOUBLE, {p}) AS valor FROM {t}" for c, t in (("value", "events"), ("user_id", "events"))
    for p in (0.0, 0.01, 0.5, 0.9, 1.0)) + ")", dbl="prob valor")
def _(v: Views):
    return quantiles.exact_quantiles(v.events, ["value", "user_id"], (0.0, 0.01, 0.5, 0.9, 1.0))


@query("fit_ar")
def _(v: Views):
    """Best order per series and the 28 days it predicts."""
    best = checkpointed(models.best_ar(models.ar_candidates(v.daily_table)))
    fc = models.ar_forecast(v.daily_table, best, calendar.future_days(v.daily_table, 28))
    return fc.join(best, "serie")


@query("fit_trend_season")
def _(v: Views):
    return models.trend_season(v.daily_table, calendar.future_days(v.daily_table, 28), hol=v.hol_long)


ALL_MODELS = ("arima", "prophet", "random_forest", "gradient_boosting", "ridge")


def _cv(v: Views):
    return checkpointed(models.fold_pairs(v.daily_table, ALL_MODELS))


@query("fold_pairs")
def _(v: Views):
    return _cv(v)


@query("fold_days", f"""SELECT serie, fold, ds, CAST(y AS DOUBLE) AS y, 5 AS modelos FROM (SELECT *, n//6 AS sz, n-fold*(n//6) AS te FROM {_NUM},
  (VALUES (0),(1),(2),(3),(4)) f(fold)) WHERE r>te-sz AND r<=te AND te-sz-7>=sz""", dbl="y")
def _(v: Views):
    """Every test day of every fold with its actual value, and the number of models that predict it."""
    pairs = _cv(v).where(F.col("yhat").isNotNull() & ~F.isnan("yhat"))
    return pairs.groupBy("serie", "fold", "ds").agg(F.max(F.col("y").cast("double")).alias("y"), F.count_distinct("modelo").cast("int").alias("modelos"))


@query("temporal_cv")
def _(v: Views):
    return models.temporal_cv(_cv(v))


@query("forecast_ensemble")
def _(v: Views):
    """Cross-validated weights, every model refitted on the whole history, and their weighted 28 days."""
    weights = checkpointed(ensemble.ensemble_weights(ensemble.error_metrics(_cv(v))))
    days = calendar.future_days(v.daily_table, 28, business=True)
    preds = checkpointed(models.predictions(v.daily_table, days, models=ALL_MODELS))
    return ensemble.forecast_table(preds, weights, ALL_MODELS)


@query("forecast_ensemble_trees")
def _(v: Views):
    """All calendar days ahead by the per-series models and both tree models; weights from their own folds."""
    names = ["arima", "prophet", "random_forest", "gradient_boosting"]
    pairs = checkpointed(models.fold_pairs(v.daily_table, names))
    weights = checkpointed(ensemble.ensemble_weights(ensemble.error_metrics(pairs)))
    preds = checkpointed(models.predictions(v.daily_table, calendar.future_days(v.daily_table, 28), models=names))
    return ensemble.forecast_table(preds, weights, names)


@query("evaluate_model", """SELECT m.*, cv_rmse_mean, cv_rmse_std, folds FROM metrics m JOIN (SELECT serie, modelo, sqrt(avg(mse)) AS cv_rmse_mean,
  sqrt(stddev_pop(mse)) AS cv_rmse_std, count(*) AS folds FROM (SELECT serie, modelo, day(ds)%3 AS fold, avg((y-yhat)*(y-yhat)) AS mse FROM pairs GROUP BY 1,2,3)
  GROUP BY 1,2) USING (serie, modelo)""", dbl="mae rmse mape r2 cv_rmse_mean cv_rmse_std")
def _(v: Views):
    return ensemble.evaluate_folds(v.pairs.withColumn("fold", F.dayofmonth("ds") % 3))


@query("grid_search")
def _(v: Views):
    """The whole grid of every kind that has one."""
    feat = _feat(v)
    return functools.reduce(DataFrame.unionByName, [tuning.grid_search(feat, kind) for kind in tuning.GRID])


@query("random_search")
def _(v: Views):
    return tuning.random_search(_feat(v), "elastic_net")


@query("compare_models")
def _(v: Views):
    return tuning.compare_models(_feat(v))


@query("validation_curve")
def _(v: Views):
    """Error by penalty of the ridge and by depth of the forest."""
    feat = _feat(v)
    curves = [tuning.validation_curve(feat, "ridge", "alpha", tuning.SPACE["ridge"]["alpha"]).withColumn("modelo", F.lit("ridge")),
              tuning.validation_curve(feat, "random_forest", "maxDepth", tuning.GRID["random_forest"]["maxDepth"]).withColumn("modelo", F.lit("random_forest"))]
    return functools.reduce(DataFrame.unionByName, curves)


_FEATURES = f"({_win_sql('daily')})"


@query("sink_models", f"SELECT serie, count(*) AS filas, 0 AS distintas FROM {_FEATURES} GROUP BY serie")
def _(v: Views):
    """A ridge of every series, written as a table of coefficients, read back and applied: rows whose prediction differs from the unsaved model's."""
    feat = _feat(v)
    fitted = checkpointed(gram.coefficients(feat, "ridge"))
    path = shared_dir(v.spark, "model")
    fitted.write.parquet(path)
    both = gram.apply(fitted, feat).withColumnRenamed("yhat", "antes").join(
        gram.apply(v.spark.read.parquet(path), feat).select("serie", "ds", "yhat"), ["serie", "ds"])
    return both.groupBy("serie").agg(F.count("*").alias("filas"), F.count_if(~F.col("antes").eqNullSafe(F.col("yhat"))).cast("int").alias("distintas"))


@query("saved_pipelines", f"SELECT serie, count(*) AS filas, 0 AS distintas FROM {_FEATURES} GROUP BY serie")
def _(v: Views):
    """A pyspark.ml pipeline per series of the data, saved, loaded and applied beside the one in memory."""
    from pyspark.ml import PipelineModel

    feat, parts = _feat(v), []
    for serie in [r[0] for r in feat.select("serie").distinct().orderBy("serie").collect()]:  # call types
        own = feat.where(F.col("serie") == serie)
        model = models.fit(own, "ridge")
        loaded = PipelineModel.load(save_model(model, shared_dir(v.spark, "model")))
        pair = models.predict(model, own, "antes").join(models.predict(loaded, own, "luego").select("ds", F.col("yhat").alias("luego")), "ds")
        parts.append(pair.groupBy("serie").agg(F.count("*").alias("filas"), F.count_if(F.col("yhat") != F.col("luego")).cast("int").alias("distintas")))
    return functools.reduce(DataFrame.unionByName, parts)


@query("full_run")
def _(v: Views):
    """A landed text log taken through every stage with all models; the scores per call type."""
    from callstrata.plans import complete_run
    from callstrata.plans.fixtures import AS_OF_LONG
    from callstrata.sources import calls as src
    from callstrata.sources import runs, sinks

    log = v.calls_long.select(F.date_format("FECHA", "dd-MM-yyyy HH:mm:ss").alias("fecha_llamada"), F.col("TELEFONO").alias("numero"),
                              "SENTIDO", "ATENDIDA")
    raw = src.read_calls(v.spark, sinks.write_csv(log, shared_dir(v.spark, "log"), sep=";"))
    out = complete_run.analyse(raw, AS_OF_LONG, {"FECHA": "fecha_llamada", "TELEFONO": "numero"}, v.hol_long)
    root = shared_dir(v.spark, "run")
    complete_run.commit(out, root, AS_OF_LONG)
    return runs.read_run(v.spark, root, "performance", out.performance.schema)
