"""Hyper-parameter search over expanding time folds.

All combinations of all folds and series are fitted in one job per family: linear kinds from the moments of the
folds, tree kinds from grouped rows. Nothing but the list of combinations passes through the driver.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callstrata.operators import gram, models, trees

# Combinations drawn by a random search, and per kind by a comparison.
DRAWS, DRAWS_EACH = 100, 30
# Parameter grids; unlimited depth is Spark's largest, 30.
GRID = {
    "random_forest": {"numTrees": [50, 100, 200, 300], "maxDepth": [5, 10, 15, 20, 30], "minInstancesPerNode": [1, 2, 4],
                      "featureSubsetStrategy": ["sqrt", "log2", "all"]},
    "gradient_boosting": {"maxIter": [50, 100, 200], "stepSize": [0.01, 0.1, 0.2], "maxDepth": [3, 5, 7],
                          "subsamplingRate": [0.8, 0.9, 1.0]},
    "ridge": {"alpha": [0.1, 1.0, 10.0, 100.0]},
    "lasso": {"alpha": [0.001, 0.01, 0.1, 1.0, 10.0], "maxIter": [1000, 2000, 3000]},
    "elastic_net": {"alpha": [0.001, 0.01, 0.1, 1.0], "l1_ratio": [0.1, 0.3, 0.5, 0.7, 0.9]},
}


def _powers(lo: float, hi: float, n: int) -> list[float]:
    return [10 ** (lo + (hi - lo) * i / (n - 1)) for i in range(n)]


# Parameter ranges of the random search.
SPACE = {
    "random_forest": {"numTrees": [10, 50, 100, 200, 300, 500], "maxDepth": [3, 5, 10, 15, 20, 25, 30],
                      "minInstancesPerNode": [1, 2, 4, 6, 8], "featureSubsetStrategy": ["sqrt", "log2", "all"],
                      "bootstrap": [True, False]},
    "gradient_boosting": {"maxIter": [50, 100, 150, 200, 300], "stepSize": [0.01, 0.05, 0.1, 0.15, 0.2],
                          "maxDepth": [3, 4, 5, 6, 7, 8], "subsamplingRate": [0.7, 0.8, 0.9, 1.0],
                          "minInstancesPerNode": [1, 2, 4]},
    "ridge": {"alpha": _powers(-4, 4, 50)},
    "lasso": {"alpha": _powers(-4, 2, 50), "maxIter": [500, 1000, 2000, 3000, 5000]},
    "elastic_net": {"alpha": _powers(-4, 2, 30), "l1_ratio": [0.1 + 0.8 * i / 19 for i in range(20)],
                    "maxIter": [500, 1000, 2000, 3000]},
}


def combinations(space: Mapping[str, list]) -> list[dict]:
    names = list(space)
    return [dict(zip(names, values)) for values in itertools.product(*(space[n] for n in names))]


def sampled(space: Mapping[str, list], n: int, seed: int = 42) -> list[dict]:
    """``n`` different combinations, drawn by position so that a large space is never listed."""
    sizes = [len(v) for v in space.values()]
    total = math.prod(sizes)
    picks = random.Random(seed).sample(range(total), min(n, total))
    out = []
    for p in picks:
        combo = {}
        for name, values in space.items():
            p, i = divmod(p, len(values))
            combo[name] = values[i]
        out.append(combo)
    return out


#: Settings that a kind knows beside those of its ranges.
KNOWN = {"linear": ("alpha", "maxIter"), "ridge": ("alpha", "maxIter"), "lasso": ("alpha", "maxIter"), "elastic_net": ("alpha", "l1_ratio", "maxIter"),
         **{kind: tuple(given) for kind, given in trees.DEFAULTS.items()}}


def fault(kind: str, combos: list[dict]) -> str | None:
    """Why a kind cannot be fitted with these combinations, or None."""
    if kind not in KNOWN:
        return f"unknown model: {kind}"
    unknown = sorted({name for combo in combos for name in combo} - set(KNOWN[kind]))
    return f"unknown settings of {kind}: {', '.join(unknown)}" if unknown else None if combos else f"no combination of {kind}"


def search_all(feat: DataFrame, combos: Mapping[str, list[dict]], types: Iterable[str] | None = None, k: int = 5) -> DataFrame:
    """(serie, modelo, combinacion, parametros, fold, n, mse_train, mse_test) for every combination of every kind and fold."""
    for kind, own in combos.items():
        if why := fault(kind, own):
            raise ValueError(why)
    if types is not None:
        feat = feat.where(F.col("serie").isin(*types))
    linear = {kind: own for kind, own in combos.items() if kind in models.LINEAR_KINDS}
    grown = {kind: own for kind, own in combos.items() if kind in models.TREE_KINDS}
    parts = ([gram.search(feat, linear, k)] if linear else []) + ([trees.search(feat, grown, k)] if grown else [])
    done = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    named = [(kind, i, {a: str(b) for a, b in combo.items()}) for kind, own in combos.items() for i, combo in enumerate(own)]
    names = feat.sparkSession.createDataFrame(named, "modelo string, combinacion int, parametros map<string,string>")
    return done.join(F.broadcast(names), ["modelo", "combinacion"]).select(
        "serie", "modelo", "combinacion", "parametros", "fold", "n", "mse_train", "mse_test")


def search(feat: DataFrame, kind: str, combos: list[dict], types: Iterable[str] | None = None, k: int = 5) -> DataFrame:
    """``search_all`` for one kind."""
    return search_all(feat, {kind: combos}, types, k)


def search_summary(results: DataFrame) -> DataFrame:
    """Per combination the mean score (negative squared error) and its rank within the series and model."""
    per = results.groupBy("serie", "modelo", "combinacion").agg(
        F.first("parametros").alias("parametros"), (-F.avg("mse_test")).alias("score"),
        F.sqrt(F.avg("mse_test")).alias("rmse"), F.count(F.lit(1)).alias("folds"))
    w = Window.partitionBy("serie", "modelo")
    return per.withColumns({"combinaciones": F.count(F.lit(1)).over(w),
                            "puesto": F.row_number().over(w.orderBy(F.desc("score"), "combinacion"))})


def grid_search(feat: DataFrame, kind: str, types: Iterable[str] | None = None, k: int = 5, grid: Mapping[str, list] | None = None) -> DataFrame:
    """Every combination of the grid, ranked; rank 1 is the best."""
    return search_summary(search(feat, kind, combinations(grid or GRID[kind]), types, k))


def random_search(feat: DataFrame, kind: str, types: Iterable[str] | None = None, n: int = DRAWS, k: int = 5, seed: int = 42,
                  space: Mapping[str, list] | None = None) -> DataFrame:
    """``n`` seeded combinations of the space, ranked."""
    return search_summary(search(feat, kind, sampled(space or SPACE[kind], n, seed), types, k))


def compare_models(feat: DataFrame, kinds: Iterable[str] = tuple(SPACE), types: Iterable[str] | None = None, n: int = DRAWS_EACH, k: int = 5,
                   seed: int = 42) -> DataFrame:
    """Best of ``n`` drawn combinations of every kind, best kind first. A kind that cannot be fitted comes last, with the reason in ``error``."""
    drawn = {kind: sampled(SPACE[kind], n, seed) if kind in SPACE else [] for kind in dict.fromkeys(kinds)}
    faults = [(kind, why) for kind, own in drawn.items() if (why := fault(kind, own))]
    fitted = {kind: own for kind, own in drawn.items() if kind not in dict(faults)}
    spark, shape = feat.sparkSession, "serie string, modelo string, combinacion int, parametros map<string,string>, score double, rmse double, folds bigint, combinaciones bigint"
    best = spark.createDataFrame([], shape)
    if fitted:
        best = search_summary(search_all(feat, fitted, types, k)).where("puesto = 1").drop("puesto")
    out = best.withColumn("error", F.lit(None).cast("string"))
    if faults:
        series = feat.select("serie").distinct() if types is None else feat.where(F.col("serie").isin(*types)).select("serie").distinct()
        failed = series.withColumn("f", F.explode(F.array(*[F.struct(F.lit(kind).alias("modelo"), F.lit(why).alias("error")) for kind, why in faults])))
        out = out.unionByName(failed.select("serie", "f.modelo", "f.error"), allowMissingColumns=True)
    w = Window.partitionBy("serie").orderBy(F.desc_nulls_last("score"), "modelo")
    return out.withColumn("puesto", F.row_number().over(w))


def validation_curve(feat: DataFrame, kind: str, param: str, values: list, types: Iterable[str] | None = None, k: int = 5) -> DataFrame:
    """Mean and deviation of the training and validation error for each value, and the best value."""
    res = search(feat, kind, [{param: v} for v in values], types, k)
    value = F.element_at("parametros", F.lit(param)).cast("double")
    out = res.groupBy("serie", value.alias("valor")).agg(
        F.avg(F.sqrt("mse_train")).alias("train_rmse_mean"), F.stddev_pop(F.sqrt("mse_train")).alias("train_rmse_std"),
        F.avg(F.sqrt("mse_test")).alias("val_rmse_mean"), F.stddev_pop(F.sqrt("mse_test")).alias("val_rmse_std"))
    best = F.min_by("valor", F.struct("val_rmse_mean", "valor")).over(Window.partitionBy("serie"))
    return out.withColumn("mejor_valor", best)
