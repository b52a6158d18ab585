"""Planted signals: the fitted models must find them, and beat the weekday mean."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from callstrata.operators import calendar, ensemble, features, models, tuning
from callstrata.sources.sinks import save_model

START, N = dt.date(2021, 1, 4), 1092


@pytest.fixture(scope="module")
def planted(spark):
    """Weekly pattern, trend and noise (seed 42), one autoregressive series beside it."""
    rng = np.random.default_rng(42)
    t = np.arange(N)
    weekly = 60 + 0.02 * t + np.array([12, 6, 3, 0, -4, -20, -25])[t % 7] + rng.normal(0, 2, N)
    ar = np.zeros(N)
    for i in range(1, N):
        ar[i] = 0.8 * ar[i - 1] + rng.normal(0, 1)
    rows = [("in", START + dt.timedelta(days=int(i)), float(weekly[i])) for i in t]
    rows += [("out", START + dt.timedelta(days=int(i)), float(50 + ar[i])) for i in t]
    df = spark.createDataFrame(rows, "serie string, ds date, y double")
    df.cache().count()
    return df


@pytest.fixture(scope="module")
def split(planted):
    cut = START + dt.timedelta(days=N - 28)
    return planted.where(F.col("ds") < F.lit(cut)), planted.where(F.col("ds") >= F.lit(cut))


def mae(pred, test):
    return {r["serie"]: r["mae"] for r in ensemble.error_metrics(pred.join(test, ["serie", "ds"])).collect()}


@pytest.fixture(scope="module")
def base(split):
    train, test = split
    pred = ensemble.weekday_baseline(test.select("serie", "ds"), train).select("serie", "ds", F.lit("b").alias("modelo"), F.col("base").alias("yhat"))
    return mae(pred, test)


def test_trend_season_beats_the_weekday_mean(split, base):
    train, test = split
    pred = models.trend_season(train, test.select("serie", "ds"))
    assert mae(pred, test)["in"] < 0.5 * base["in"]
    inside = pred.join(test, ["serie", "ds"]).where("serie = 'in'").select(F.avg(F.col("y").between(F.col("yhat_lower"), F.col("yhat_upper")).cast("int"))).first()[0]
    assert inside > 0.6


def test_autoregression_beats_the_weekday_mean(split, base):
    train, test = split
    best = models.best_ar(models.ar_candidates(train))
    pred = models.ar_forecast(train, best, test.select("serie", "ds"))
    assert mae(pred, test)["in"] < 0.7 * base["in"]
    picked = {r["serie"]: r for r in best.collect()}
    assert picked["in"]["d"] + picked["in"]["s"] >= 1


def _line(spark, values, serie="in"):
    return spark.createDataFrame([(serie, START + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "serie string, ds date, y double")


def test_autoregression_on_short_series(spark):
    flat = _line(spark, [5.0] * 20)
    out = models.ar_forecast(flat, models.best_ar(models.ar_candidates(flat)), calendar.future_days(flat, 3)).collect()
    assert [round(r["yhat"], 4) for r in out] == [5.0] * 3
    rising = _line(spark, range(1, 31))
    best = models.best_ar(models.ar_candidates(rising))
    assert best.first()["aic"] is not None
    out = models.ar_forecast(rising, best, calendar.future_days(rising, 3)).orderBy("ds").collect()
    assert [round(r["yhat"], 2) for r in out] == [31.0, 32.0, 33.0]
    tiny = _line(spark, [3.0, 5.0])
    best = models.best_ar(models.ar_candidates(tiny))
    r = best.first()
    assert (r["p"], r["d"], r["q"], r["s"], r["aic"]) == (0, 0, 0, 0, None)
    assert [r["yhat"] for r in models.ar_forecast(tiny, best, calendar.future_days(tiny, 2)).collect()] == [4.0] * 2


def test_days_without_training_keep_their_place(spark):
    """Ten holidays a year with their neighbours left out of training cost little against the full series."""
    rng = np.random.default_rng(1)
    t = np.arange(1100)
    y = 60 + np.array([12, 6, 3, 0, -4, -20, -25])[t % 7] + rng.normal(0, 2, len(t))
    off = {d for year in range(3) for d in range(20, 360, 34) for d in (365 * year + d - 1, 365 * year + d, 365 * year + d + 1)}
    seen = [("full", START + dt.timedelta(days=int(i)), float(y[i]), True) for i in t[:-28]]
    usual = {k: float(np.mean([y[i] for i in t[:-28] if i % 7 == k and i not in off])) for k in range(7)}
    seen += [("mask", START + dt.timedelta(days=int(i)), usual[i % 7] if i in off else float(y[i]), i not in off) for i in t[:-28]]
    train = spark.createDataFrame(seen, "serie string, ds date, y double, entrena boolean")
    days = train.select("serie").distinct().crossJoin(spark.createDataFrame([(START + dt.timedelta(days=int(i)), float(y[i])) for i in t[-28:]], "ds date, real double"))
    got = models.predictions(train, days.select("serie", "ds"), ["full", "mask"], ["arima", "prophet", "ridge"]).join(days, ["serie", "ds"])
    e = {(r["serie"], r["modelo"]): r["e"] for r in got.groupBy("serie", "modelo").agg(F.avg(F.abs(F.col("yhat") - F.col("real"))).alias("e")).collect()}
    for m in ("arima", "prophet", "ridge"):
        assert e["mask", m] <= 1.2 * e["full", m] + 0.05, (m, e)


def test_the_mask_keeps_the_calendar(spark):
    from callstrata.sources.holidays import holiday_dim

    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=i), 10 + i % 7) for s in ("in", "out") for i in range(60)]
    daily = spark.createDataFrame(rows, "serie string, ds date, y bigint")
    masked = calendar.training_mask(daily, holiday_dim(spark))
    kept = {(r["serie"], r["ds"]) for r in calendar.training_filter(daily, holiday_dim(spark)).collect()}
    got = masked.collect()
    assert len(got) == 120 and {(r["serie"], r["ds"]) for r in got if r["entrena"]} == kept and len(kept) < 120
    assert all(r["y"] == 10 + (r["ds"] - dt.date(2024, 1, 1)).days % 7 for r in got)


def test_any_name_of_a_series_survives_the_folds(spark, planted):
    named = planted.withColumn("serie", F.when(F.col("serie") == "in", "a#1").otherwise("#b#"))
    pairs = models.fold_pairs(named, ("prophet", "ridge"))
    assert {(r["serie"], r["fold"]) for r in pairs.select("serie", "fold").distinct().collect()} == {(s, k) for s in ("a#1", "#b#") for k in range(4)}


def test_models_without_error_share_the_weight(spark):
    m = spark.createDataFrame([("in", "a", 0.0), ("in", "b", 0.0), ("in", "c", 2.0), ("out", "a", 0.0), ("out", "b", None)], "serie string, modelo string, mae double")
    w = {(r["serie"], r["modelo"]): r["peso"] for r in ensemble.ensemble_weights(m).collect()}
    assert w == {("in", "a"): 0.5, ("in", "b"): 0.5, ("in", "c"): 0.0, ("out", "a"): 1.0}


def test_folds_expand_at_every_size(spark):
    got = ensemble.expanding_folds(_line(spark, range(40)), 5, min_rows=0)
    ends = got.groupBy("fold").agg(F.max(F.when(F.col("parte") == "train", F.col("ds"))).alias("a"), F.min(F.when(F.col("parte") == "test", F.col("ds"))).alias("b")).collect()
    assert len(ends) == 5 and all(r["a"] < r["b"] for r in ends)


def test_ridge_equals_the_closed_form(spark, planted):
    feat = features.training_features(planted).where("serie = 'in'").orderBy("ds")
    model = models.fit(feat, "ridge", alpha=1.0)
    got = [r["yhat"] for r in models.predict(model, feat, "ridge").orderBy("ds").collect()]
    pdf = feat.toPandas()
    x = pdf[models.TRAIN_COLS].to_numpy(float)
    s = x.std(axis=0, ddof=1)
    keep = s > 0
    z = (x[:, keep] - x[:, keep].mean(axis=0)) / s[keep]
    y = pdf["y"].to_numpy()
    w = np.linalg.solve(z.T @ z + np.eye(z.shape[1]), z.T @ (y - y.mean()))
    np.testing.assert_allclose(got, z @ w + y.mean(), rtol=1e-5, atol=1e-4)


def test_ridge_by_series_equals_the_single_fits(planted, split):
    feat = features.training_features(split[0])
    days = split[1].select("serie", "ds")
    ahead = models.future_features(split[0], days)
    got = {(r["serie"], r["ds"]): r["yhat"] for r in models.ridge_by_series(feat, ahead).collect()}
    assert len(got) == 56
    for t in ("in", "out"):
        one = models.predict(models.fit(feat.where(F.col("serie") == t), "ridge"), ahead.where(F.col("serie") == t), "ridge", keep=("serie", "ds"))
        for r in one.collect():
            assert abs(got[(t, r["ds"])] - r["yhat"]) < 1e-3


def test_penalties_follow_their_objective(spark, planted):
    """Lasso and elastic net: no move along any axis lowers half the mean squared error plus the penalty."""
    feat = features.training_features(planted).where("serie = 'in'").orderBy("ds")
    pdf = feat.toPandas()
    x = pdf[models.TRAIN_COLS].to_numpy(float)
    s = x.std(axis=0, ddof=1)
    z = (x - x.mean(axis=0)) / np.where(s > 0, s, 1)
    y = pdf["y"].to_numpy()
    for kind, l1 in (("lasso", 1.0), ("elastic_net", 0.3)):
        w = models.fit(feat, kind, alpha=0.5, l1_ratio=l1, maxIter=2000, tol=1e-12).stages[-1].coefficients.toArray()

        def cost(w):
            r = y - y.mean() - z @ w
            return r @ r / (2 * len(y)) + 0.5 * (l1 * np.abs(w).sum() + (1 - l1) / 2 * w @ w)

        best = cost(w)
        for j in range(len(w)):
            for step in (-0.01, 0.01):
                other = w.copy()
                other[j] += step
                assert cost(other) > best - 1e-6, (kind, j)


def test_trees_and_ridge_learn_the_week(planted):
    feat = features.training_features(planted)
    for kind, params in (("ridge", {}), ("random_forest", {"numTrees": 20}), ("gradient_boosting", {"maxIter": 10, "maxDepth": 4}), ("decision_tree", {})):
        m = {r["serie"]: r for r in ensemble.error_metrics(models.train_and_score(feat, kind, ["in", "out"], **params)).collect()}
        assert m["in"]["mae"] < 10 and m["in"]["r2"] > 0.3, (kind, m["in"])


def test_training_features_never_see_the_day_itself(spark, planted):
    last = planted.agg(F.max("ds")).first()[0]
    other = planted.withColumn("y", F.when(F.col("ds") == last, F.lit(1e6)).otherwise(F.col("y")))
    cols = models.TRAIN_COLS
    a = features.training_features(planted).where(F.col("ds") == last).select("serie", *cols).orderBy("serie").collect()
    b = features.training_features(other).where(F.col("ds") == last).select("serie", *cols).orderBy("serie").collect()
    assert a == b


def test_folds_and_ensemble(spark, planted):
    pairs = models.fold_pairs(planted, ("arima", "prophet", "ridge"))
    folds = {(r["serie"], r["modelo"]): r for r in models.temporal_cv(pairs).collect()}
    assert len(folds) == 6
    assert all(r["n"] == r["folds"] * (N // 6) for r in folds.values())
    weights = ensemble.ensemble_weights(ensemble.error_metrics(pairs))
    total = {r["serie"]: r["s"] for r in weights.groupBy("serie").agg(F.sum("peso").alias("s"), F.min("peso").alias("m")).collect()}
    assert all(abs(s - 1) < 1e-9 for s in total.values())
    names = ["arima", "prophet", "ridge"]
    fc = ensemble.forecast_table(models.predictions(planted, calendar.future_days(planted, 28), ["in", "out"], names), weights, names)
    assert fc.count() == 56 and fc.where("yhat_ensemble is null or yhat_prophet is null").count() == 0
    assert ensemble.no_overlap(fc, planted).where("valido").count() == 2
    assert fc.where("yhat_lower > yhat_ensemble or yhat_upper < yhat_ensemble").count() == 0


def test_search_ranks_combinations(planted):
    feat = features.training_features(planted.where("serie = 'in'"))
    out = tuning.grid_search(feat, "ridge", ["in"], k=2, grid={"alpha": [0.1, 1e6]}).orderBy("puesto").collect()
    assert [r["parametros"]["alpha"] for r in out] == ["0.1", "1000000.0"] and out[0]["combinaciones"] == 2
    curve = tuning.validation_curve(feat, "ridge", "alpha", [0.1, 1e6], ["in"], k=2).collect()
    assert {r["mejor_valor"] for r in curve} == {0.1}
    assert all(r["train_rmse_std"] >= 0 for r in curve)


def test_random_draws_are_seeded_and_distinct():
    a = tuning.sampled(tuning.SPACE["random_forest"], 30)
    assert a == tuning.sampled(tuning.SPACE["random_forest"], 30)
    assert len({tuple(sorted((k, str(v)) for k, v in c.items())) for c in a}) == 30
    assert len(tuning.combinations(tuning.GRID["elastic_net"])) == 20


def test_compare_models_ranks_each_kind_once(planted):
    feat = features.training_features(planted.where("serie = 'in'"))
    out = tuning.compare_models(feat, ["ridge", "lasso", "not_a_model"], ["in"], n=1, k=2).orderBy("puesto").collect()
    assert sorted(r["modelo"] for r in out[:2]) == ["lasso", "ridge"] and all(r["error"] is None for r in out[:2])
    assert len(out) == 3 and out[2]["modelo"] == "not_a_model" and "not_a_model" in out[2]["error"] and out[2]["score"] is None


def test_model_survives_a_round_trip(spark, planted, tmp_path):
    from pyspark.ml import PipelineModel
    feat = features.training_features(planted.where("serie = 'in'"))
    model = models.fit(feat, "decision_tree", maxDepth=3)
    path = save_model(model, str(tmp_path / "m"))
    a = models.predict(model, feat, "t").agg(F.sum("yhat")).first()[0]
    assert a == models.predict(PipelineModel.load(path), feat, "t").agg(F.sum("yhat")).first()[0]


def test_time_split_share(planted):
    c = {(r["serie"], r["parte"]): r["count"] for r in ensemble.time_split(planted).groupBy("serie", "parte").count().collect()}
    assert c[("in", "train")] == int(N * 0.8) and c[("in", "test")] == N - int(N * 0.8)
