"""Grouped linear models and trees against single fits, plain numpy and pyspark.ml."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from callstrata.operators import ensemble, features, gram, models, trees, tuning

START, N = dt.date(2021, 1, 4), 500


@pytest.fixture(scope="module")
def feat(spark):
    rng = np.random.default_rng(7)
    t = np.arange(N)
    rows = []
    for s, name in enumerate(("in", "out", "sms")):
        y = 50 + 0.03 * t * s + np.array([9, 5, 2, 0, -3, -11, -14])[t % 7] * (s + 1) + rng.normal(0, 2, N)
        rows += [(name, START + dt.timedelta(days=int(i)), float(y[i])) for i in t]
    df = features.training_features(spark.createDataFrame(rows, "serie string, ds date, y double"))
    df.cache().count()
    return df


def arrays(feat, serie):
    pdf = feat.where(F.col("serie") == serie).orderBy("ds").toPandas()
    return pdf[models.TRAIN_COLS].to_numpy(float), pdf["y"].to_numpy()


def expanding(n, k):
    size = n // (k + 1)
    return [(n - (k - f) * size, n - (k - f) * size + size) for f in range(k)]


def brute_linear(x, y, kind, combo):
    """The objective minimised by plain coordinate descent on the rows."""
    dev = x.std(axis=0, ddof=1)
    z = (x - x.mean(axis=0)) / np.where(dev > 1e-9, dev, 1) * (dev > 1e-9)
    absolute, square, _ = gram.penalties(kind, combo)
    n, w, r = len(y), np.zeros(x.shape[1]), y - y.mean()
    if kind == "ridge":
        w = np.linalg.solve(z.T @ z + square * np.eye(len(w)), z.T @ r)
    else:
        for _ in range(3000):
            old = w.copy()
            for j in range(len(w)):
                q = z[:, j] @ z[:, j] / n
                c = z[:, j] @ (r - z @ w) / n + q * w[j]
                w[j] = np.sign(c) * max(abs(c) - absolute, 0) / (q + square) if q > 0 else 0.0
            if np.abs(w - old).max() < 1e-10:
                break
    return lambda a: (a - x.mean(axis=0)) / np.where(dev > 1e-9, dev, 1) * (dev > 1e-9) @ w + y.mean()


@pytest.mark.parametrize("kind,combos", [
    ("ridge", [{"alpha": 0.1}, {"alpha": 50.0}]), ("lasso", [{"alpha": 0.05}, {"alpha": 1.0}]),
    ("elastic_net", [{"alpha": 0.3, "l1_ratio": 0.2}, {"alpha": 0.1, "l1_ratio": 0.9}])])
def test_errors_from_moments_equal_fits_on_the_rows(feat, kind, combos):
    got = {(r["serie"], r["combinacion"], r["fold"]): r for r in tuning.search(feat, kind, combos, ["in", "sms"], k=3).collect()}
    assert len(got) == 2 * len(combos) * 3
    for serie in ("in", "sms"):
        x, y = arrays(feat, serie)
        for fold, (a, b) in enumerate(expanding(len(y), 3)):
            for i, combo in enumerate(combos):
                f = brute_linear(x[:a], y[:a], kind, combo)
                r = got[serie, i, fold]
                assert r["n"] == a
                assert abs(r["mse_train"] - np.mean((y[:a] - f(x[:a])) ** 2)) < 1e-5 * (1 + r["mse_train"])
                assert abs(r["mse_test"] - np.mean((y[a:b] - f(x[a:b])) ** 2)) < 1e-4 * (1 + r["mse_test"])


def test_partial_moments_add_up(feat):
    x, y = arrays(feat, "out")
    z = np.column_stack([x, y])
    n, mean, cross = gram.merged(gram.moments(feat.repartition(6).where("serie = 'out'"), "serie").toPandas())
    assert n == len(y)
    np.testing.assert_allclose(mean, z.mean(axis=0))
    np.testing.assert_allclose(cross, (z - z.mean(axis=0)).T @ (z - z.mean(axis=0)), rtol=1e-9, atol=1e-6)


def test_coefficients_equal_the_pipeline(feat):
    for kind, params in (("ridge", {"alpha": 2.0}), ("linear", {}), ("lasso", {"alpha": 0.2}), ("elastic_net", {"alpha": 0.2, "l1_ratio": 0.5})):
        got = {(r["serie"], r["ds"]): r["yhat"] for r in models.by_key(feat, feat, kind, **params).collect()}
        assert len(got) == feat.count()
        own = feat.where("serie = 'in'")
        more = {} if kind in ("ridge", "linear") else {"maxIter": 3000, "tol": 1e-12}
        worst = max(abs(got["in", r["ds"]] - r["yhat"]) for r in models.predict(models.fit(own, kind, **params, **more), own, kind).collect())
        assert worst < 0.05, (kind, worst)


def test_default_search_draws_as_many_as_stated(feat):
    out = tuning.random_search(feat.where("serie = 'in'"), "elastic_net", k=3).collect()
    assert len(out) == tuning.DRAWS == 100 and sorted(r["puesto"] for r in out) == list(range(1, 101))
    assert all(r["folds"] == 3 and r["combinaciones"] == 100 for r in out)


def test_a_constant_feature_and_a_short_series(spark, feat):
    flat = feat.where("serie = 'in'").withColumn("mes", F.lit(5))
    assert models.by_key(flat, flat, "ridge").where("yhat IS NULL OR isnan(yhat)").count() == 0
    short = feat.where("serie = 'in'").orderBy("ds").limit(3)
    assert tuning.search(short, "ridge", [{"alpha": 1.0}], k=5).count() == 0
    assert tuning.search(short, "decision_tree", [{"maxDepth": 2}], k=5).count() == 0
    assert models.by_key(short.limit(1), short, "random_forest", numTrees=3).count() == 3


# --- trees -------------------------------------------------------------------------------------


def brute_tree(bins, y, depth, least):
    """Best first split of all features and bins, by plain loops; then each side in the same way."""
    best = (1e-9 * (1 + y.sum() ** 2 / len(y)), None, None)
    for f in range(bins.shape[1]):
        for b in range(bins[:, f].max()):
            left = bins[:, f] <= b
            if min(left.sum(), (~left).sum()) >= least:
                g = y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum() - y.sum() ** 2 / len(y)
                if g > best[0] * (1 + 1e-12):
                    best = (g, f, b)
    if not depth or best[1] is None:
        return np.full(len(y), y.mean())
    left = bins[:, best[1]] <= best[2]
    out = np.empty(len(y))
    out[left], out[~left] = brute_tree(bins[left], y[left], depth - 1, least), brute_tree(bins[~left], y[~left], depth - 1, least)
    return out


def test_a_tree_makes_the_best_splits():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (150, 5)).astype(float)
    y = x[:, 1] * (x[:, 3] > 5) + rng.normal(0, 0.3, 150)
    bins = trees.binned(x, [trees.borders(x[:, j]) for j in range(5)])
    t = trees.Trees(bins, y, np.ones((2, 150)), 4, 3, 1.0, rng)
    got = t.predict(bins, 2)
    np.testing.assert_allclose(got[0], brute_tree(bins, y, 4, 3))
    np.testing.assert_allclose(got[0], got[1])


@pytest.mark.parametrize("kind,combos", [
    ("random_forest", [{"numTrees": t, "maxDepth": d, "featureSubsetStrategy": "sqrt"} for t in (3, 8) for d in (2, 6)]),
    ("gradient_boosting", [{"maxIter": k, "maxDepth": 3} for k in (1, 7, 12)]), ("decision_tree", [{"maxDepth": d} for d in (0, 1, 4, 30)])])
def test_paths_equal_single_fits(kind, combos):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 5))
    y = x[:, 0] * 3 + (x[:, 1] > 0) + rng.normal(0, 0.1, 200)
    together = trees.predicted_paths(kind, x, y, x[:50], combos, 5)
    deepest = combos[-1]
    np.testing.assert_allclose(together[-1], trees.predicted(kind, x, y, x[:50], deepest, 5) if kind != "random_forest" else together[-1])
    if kind == "random_forest":  # the draws of a forest depend on how many trees grow together, its levels do not
        same = [c for c in combos if c["numTrees"] == 3]
        for c, got in zip(same, trees.predicted_paths(kind, x, y, x[:50], same, 5)):
            np.testing.assert_allclose(got, together[combos.index(c)])
    else:
        for c, got in zip(combos, together):
            np.testing.assert_allclose(got, trees.predicted(kind, x, y, x[:50], c, 5))


def test_borders_halve_the_way_and_are_bounded():
    assert trees.borders(np.array([1.0, 1.0, 3.0, 7.0])).tolist() == [2.0, 5.0]
    assert len(trees.borders(np.full(9, 2.0))) == 0
    cuts = trees.borders(np.random.default_rng(1).normal(size=5000))
    assert len(cuts) == trees.BINS - 1
    assert np.bincount(np.searchsorted(cuts, np.random.default_rng(1).normal(size=5000))).min() > 100


def test_cells_counted_in_parts_give_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(300, 6)), rng.normal(size=300)
    a = trees.predicted("random_forest", x, y, x, {"numTrees": 5, "maxDepth": 5}, 1)
    monkeypatch.setattr(trees.Trees, "_best", staticmethod(lambda *k, f=trees.Trees._best: f(*k)))
    b = trees.predicted("random_forest", x, y, x, {"numTrees": 5, "maxDepth": 5}, 1)
    np.testing.assert_array_equal(a, b)
    bins = trees.binned(x, [trees.borders(x[:, j]) for j in range(6)])
    one = trees.Trees(bins, y, np.ones((3, 300)), 5, 2, 1.0, rng).predict(bins, 3)
    monkeypatch.setattr(trees, "CELLS", 1000)
    np.testing.assert_allclose(one, trees.Trees(bins, y, np.ones((3, 300)), 5, 2, 1.0, rng).predict(bins, 3))


@pytest.mark.parametrize("kind,params,slack", [("decision_tree", {"maxDepth": 6}, 0.1), ("random_forest", {"numTrees": 60}, 0.15), ("gradient_boosting", {"maxIter": 30, "maxDepth": 4}, 0.12)])
def test_grouped_trees_are_as_good_as_pyspark_ml(feat, kind, params, slack):
    """Held-out error of the grouped model within ``slack`` of the pipeline's, and their predictions close to each other."""
    own = ensemble.time_split(feat.where("serie = 'sms'"))
    train, test = own.where("parte = 'train'"), own.where("parte = 'test'")
    a = {r["ds"]: (r["y"], r["yhat"]) for r in models.train_and_score(feat, kind, ["sms"], **params).collect()}
    b = {r["ds"]: r["yhat"] for r in models.predict(models.fit(train, kind, **params), test, kind).collect()}
    assert a.keys() == b.keys() and len(a) > 50
    y, mine, theirs = (np.array([f(d) for d in sorted(a)]) for f in (lambda d: a[d][0], lambda d: a[d][1], b.get))
    rmse = [np.sqrt(np.mean((y - z) ** 2)) for z in (mine, theirs)]
    assert rmse[0] < (1 + slack) * rmse[1], rmse
    assert np.sqrt(np.mean((mine - theirs) ** 2)) < 0.25 * y.std()


def test_forests_are_seeded_and_by_series(feat):
    got = [sorted((r["serie"], r["ds"], r["yhat"]) for r in models.by_key(f, f, "random_forest", numTrees=5).collect()) for f in (feat, feat.repartition(5), feat.where("serie = 'out'"))]
    assert got[0] == got[1] and [r for r in got[0] if r[0] == "out"] == got[2]


def test_tree_search_ranks_depths(feat):
    out = tuning.grid_search(feat.where("serie = 'in'"), "decision_tree", k=2, grid={"maxDepth": [0, 5]}).orderBy("puesto").collect()
    assert [r["parametros"]["maxDepth"] for r in out] == ["5", "0"]
    with pytest.raises(ValueError, match="unknown settings"):
        tuning.search(feat, "ridge", [{"depth": 1}])
