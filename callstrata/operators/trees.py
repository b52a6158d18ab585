"""Regression trees, forests and boosting for many small series at once.

Spark deals the rows by model key (series, fold, block of combinations); each key's rows, one daily series at most, lie in one task, so
all models of all folds grow in the same job. Inside a task the trees of a forest grow level by level together: the
histograms of all open nodes of all trees are one count over (node, feature, bin). Features are cut at no more than
``BINS`` - 1 borders that halve the way between neighbouring values. The objective, the boosting step and the
sampling are those of the tree models of ``pyspark.ml``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callstrata.operators.gram import spread, vector

BINS = 32
SEED = 42
#: Cells (rows x features x trees) of a level's histogram that are counted at a time, and blocks of combinations per series and fold.
CELLS, BLOCKS = 4_000_000, 16
# The models' settings where none are given.
DEFAULTS = {
    "random_forest": {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 2, "featureSubsetStrategy": "all", "bootstrap": True},
    "gradient_boosting": {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8, "minInstancesPerNode": 1},
    "decision_tree": {"maxDepth": 10, "minInstancesPerNode": 1},
}


def borders(x: np.ndarray) -> np.ndarray:
    """Borders of a feature: between all neighbouring values if they are few, else next to the quantiles."""
    values, counts = np.unique(x, return_counts=True)
    middle = (values[1:] + values[:-1]) / 2
    if len(values) <= BINS:
        return middle
    upto = np.cumsum(counts)[:-1]
    goals = len(x) / BINS * np.arange(1, BINS)
    return middle[np.unique(np.abs(upto[None, :] - goals[:, None]).argmin(axis=1))]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin numbers; a value goes left of a border that it does not exceed."""
    return np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])


class Trees:
    """Grown trees as flat arrays: node k of any tree has a feature (-1: leaf), a bin, its two children and a mean."""

    def __init__(self, bins: np.ndarray, y: np.ndarray, weight: np.ndarray, depth: int, least: int, share: float, rng: np.random.Generator):
        """``weight``: trees x rows. ``share``: part of the features that a node may choose from."""
        t, (n, p) = len(weight), bins.shape
        self.feature, self.bin, self.left, self.mean = (np.empty(0, k) for k in (np.int64, np.int64, np.int64, np.float64))
        tree, row = np.nonzero(weight)
        at, w = tree.copy(), weight[tree, row].astype(float)
        first, count = 0, t  # open nodes are numbered from ``first``
        used = max(1, int(np.ceil(share * p)))
        for level in range(depth + 1):
            node = at - first
            s0, s1 = np.bincount(node, w, count), np.bincount(node, w * y[row], count)
            mean = np.divide(s1, s0, out=np.zeros(count), where=s0 > 0)
            feature, cut = np.full(count, -1), np.zeros(count, np.int64)
            if level < depth:
                base = np.divide(s1 * s1, s0, out=np.zeros(count), where=s0 > 0)
                # a node too small or without spread stays a leaf, and needs no histogram
                able = (s0 >= 2 * least) & (np.bincount(node, w * y[row] ** 2, count) - base > 1e-9 * (1.0 + base))
                new, own = np.cumsum(able) - 1, able[node]
                if own.any():
                    feature[able], cut[able] = self._best(bins, y, row[own], new[node[own]], w[own], int(able.sum()), s0[able], s1[able], least, used, rng)
            split = feature >= 0
            left = np.full(count, -1)
            left[split] = first + count + 2 * np.arange(split.sum())
            for name, part in (("feature", feature), ("bin", cut), ("left", left), ("mean", mean)):
                setattr(self, name, np.concatenate([getattr(self, name), part]))
            if not split.any():
                break
            going = split[node]
            row, w, node = row[going], w[going], node[going]
            at = left[node] + (bins[row, feature[node]] > cut[node])
            first, count = first + count, 2 * int(split.sum())

    @staticmethod
    def _best(bins, y, row, node, w, count, s0, s1, least, used, rng):
        """Feature and bin of the largest gain per open node; -1 where none lowers the squared error or a side would be too small."""
        p, most = bins.shape[1], int(bins.max(initial=0)) + 1
        gain, feature, cut = np.zeros(count), np.full(count, -1), np.zeros(count, np.int64)
        open_to = None if used == p else rng.random((count, p)).argsort(axis=1).argsort(axis=1) < used
        step = max(1, CELLS // max(1, len(row), count * most))
        base = np.divide(s1 * s1, s0, out=np.zeros(count), where=s0 > 0)
        for lo in range(0, p, step):
            hi = min(p, lo + step)
            cell = ((node * (hi - lo))[:, None] + np.arange(hi - lo)) * most + bins[row, lo:hi]
            size, shape = count * (hi - lo) * most, (count, hi - lo, most)
            n0 = np.bincount(cell.ravel(), np.repeat(w, hi - lo), size).reshape(shape).cumsum(axis=2)[:, :, :-1]
            n1 = np.bincount(cell.ravel(), np.repeat(w * y[row], hi - lo), size).reshape(shape).cumsum(axis=2)[:, :, :-1]
            if n0.shape[2] == 0:
                continue
            r0, r1 = s0[:, None, None] - n0, s1[:, None, None] - n1
            ok = (n0 >= least) & (r0 >= least)
            if open_to is not None:
                ok &= open_to[:, lo:hi, None]
            won = np.where(ok, n1 * n1 / np.where(ok, n0, 1) + r1 * r1 / np.where(ok, r0, 1) - base[:, None, None], 0.0).reshape(count, -1)
            best = won.argmax(axis=1)
            top = won[np.arange(count), best]
            better = top > np.maximum(gain, 1e-9 * (1.0 + base))
            gain[better] = top[better]
            feature[better] = lo + best[better] // (most - 1)
            cut[better] = best[better] % (most - 1)
        return feature, cut

    def predict(self, bins: np.ndarray, trees: int, depths: Iterable[int] = ()) -> np.ndarray | dict[int, np.ndarray]:
        """trees x rows; with ``depths``, the same for the trees cut off at each of these depths. Trees grow level by level, so
        a shallower one is the upper part of a deeper one."""
        at = np.repeat(np.arange(trees)[:, None], len(bins), axis=1)
        rows, depth, out = np.arange(len(bins))[None, :], 0, {}
        while True:
            if depth in depths:
                out[depth] = self.mean[at]
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                last = self.mean[at]
                return {d: out.get(d, last) for d in depths} if depths else last
            after = self.left[at] + (bins[rows, np.maximum(feature, 0)] > self.bin[at])
            at, depth = np.where(inner, after, at), depth + 1


def feature_share(strategy: str, p: int) -> float:
    return {"all": 1.0, "sqrt": np.sqrt(p) / p, "log2": max(1.0, np.log2(p)) / p}[strategy]


#: Settings whose smaller values are read off a model grown with the largest: number of trees or rounds, and depth.
PATHS = {"random_forest": ("numTrees", "maxDepth"), "gradient_boosting": ("maxIter",), "decision_tree": ("maxDepth",)}


def predicted_paths(kind: str, x: np.ndarray, y: np.ndarray, ahead: np.ndarray, combos: list[Mapping], seed: int) -> list[np.ndarray]:
    """Predictions for the rows of ``ahead`` by models of the training rows, one per combination. The combinations differ in
    the settings of ``PATHS`` only and share one growth."""
    all_given = [{**DEFAULTS[kind], **c} for c in combos]
    given = {**all_given[0], **{name: max(g[name] for g in all_given) for name in PATHS[kind]}}
    rng = np.random.default_rng(seed)
    cuts = [borders(x[:, j]) for j in range(x.shape[1])]
    bins, new = binned(x, cuts), binned(ahead, cuts)
    n, depth, least = len(y), int(given["maxDepth"]), int(given["minInstancesPerNode"])
    if kind == "gradient_boosting":
        at, out, told = np.zeros(n), np.zeros(len(new)), {}
        rate, wanted = float(given["subsamplingRate"]), {int(g["maxIter"]) for g in all_given}
        for k in range(int(given["maxIter"])):
            goal, step = (y, 1.0) if k == 0 else (2.0 * (y - at), float(given["stepSize"]))
            weight = (rng.random((1, n)) < rate).astype(float) if rate < 1.0 else np.ones((1, n))
            tree = Trees(bins, goal, weight, depth, least, 1.0, rng)
            at = at + step * tree.predict(bins, 1)[0]
            out = out + step * tree.predict(new, 1)[0]
            if k + 1 in wanted:
                told[k + 1] = out
        return [told[int(g["maxIter"])] for g in all_given]
    depths = sorted({int(g["maxDepth"]) for g in all_given})
    if kind == "decision_tree":
        one = Trees(bins, y, np.ones((1, n)), depth, least, 1.0, rng).predict(new, 1, depths)
        return [one[int(g["maxDepth"])][0] for g in all_given]
    trees, share = int(given["numTrees"]), feature_share(given["featureSubsetStrategy"], x.shape[1])
    stops = sorted({int(g["numTrees"]) for g in all_given})
    sums, told, grown = {d: np.zeros(len(new)) for d in depths}, {}, 0
    together = max(1, CELLS // (8 * max(1, n)))
    while grown < trees:
        t = min(together, min(s for s in stops if s > grown) - grown)
        weight = rng.poisson(1.0, (t, n)).astype(float) if given["bootstrap"] else np.ones((t, n))
        weight[weight.sum(axis=1) == 0] = 1.0
        part = Trees(bins, y, weight, depth, least, share, rng).predict(new, t, depths)
        grown += t
        for d in depths:
            sums[d] = sums[d] + part[d].sum(axis=0)
            if grown in stops:
                told[grown, d] = sums[d] / grown
    return [told[int(g["numTrees"]), int(g["maxDepth"])] for g in all_given]


def predicted(kind: str, x: np.ndarray, y: np.ndarray, ahead: np.ndarray, params: Mapping, seed: int) -> np.ndarray:
    """Predictions for the rows of ``ahead`` by a model of the training rows."""
    return predicted_paths(kind, x, y, ahead, [params], seed)[0]


def _seed(*parts) -> int:
    return zlib.crc32("|".join(map(str, (SEED, *parts))).encode())


def by_series(seen: DataFrame, ahead: DataFrame, kind: str, by: Iterable[str] = ("serie",), **params) -> DataFrame:
    """(keys, ds, modelo, yhat): a model per key, fitted on ``seen`` and applied to ``ahead``; keys without training rows are left out."""
    keys = list(by)
    rows = seen.select(*keys, "ds", F.col("y").cast("double").alias("y"), vector().alias("x"), F.lit(False).alias("_new")).unionByName(
        ahead.select(*keys, "ds", F.lit(None).cast("double").alias("y"), vector().alias("x"), F.lit(True).alias("_new")))
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in seen.select(*keys).schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        new = pdf["_new"].to_numpy()
        if new.all() or not new.any():
            return pd.DataFrame({c: [] for c in [*keys, "ds", "modelo", "yhat"]})
        x = np.vstack(pdf["x"].to_numpy())
        yhat = predicted(kind, x[~new], pdf.loc[~pdf["_new"], "y"].to_numpy(), x[new], params, _seed(kind, *(pdf[k].iloc[0] for k in keys)))
        return pdf.loc[pdf["_new"], [*keys, "ds"]].assign(modelo=kind, yhat=yhat)

    return spread(rows, *keys).groupBy(*keys).applyInPandas(run, f"{head}, ds date, modelo string, yhat double")


def search(feat: DataFrame, combos: Mapping[str, list[Mapping]], k: int = 5) -> DataFrame:
    """The rows of ``gram.search`` for tree kinds: a group is one series, fold and block of combinations.

    Combinations that differ only in the number of trees or rounds, or in the depth of a forest, are read off one growth.
    """
    from callstrata.operators.ensemble import expanding_folds

    paths: dict[tuple, list[int]] = {}
    for kind, own in combos.items():
        for i, combo in enumerate(own):
            rest = tuple(sorted((name, v) for name, v in {**DEFAULTS[kind], **combo}.items() if name not in PATHS[kind]))
            paths.setdefault((kind, rest), []).append(i)
    jobs = [(kind, own) for (kind, _), own in paths.items()]
    blocks = max(1, min(BLOCKS, len(jobs)))
    rows = expanding_folds(feat.select("serie", "ds", F.col("y").cast("double").alias("y"), vector().alias("x")), k, min_rows=0)
    rows = rows.withColumn("bloque", F.explode(F.array(*[F.lit(b) for b in range(blocks)])))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        test = (pdf["parte"] == "test").to_numpy()
        names = ["serie", "modelo", "combinacion", "fold", "n", "mse_train", "mse_test"]
        if test.all() or not test.any():
            return pd.DataFrame(columns=names)
        serie, fold, x, y = pdf["serie"].iloc[0], int(pdf["fold"].iloc[0]), np.vstack(pdf["x"].to_numpy()), pdf["y"].to_numpy()
        out = []
        for kind, own in jobs[int(pdf["bloque"].iloc[0])::blocks]:
            found = predicted_paths(kind, x[~test], y[~test], x, [combos[kind][i] for i in own], _seed(kind, serie, fold, own[0]))
            for i, yhat in zip(own, found, strict=True):
                e = (yhat - y) ** 2
                out.append((serie, kind, i, fold, int((~test).sum()), float(e[~test].mean()), float(e[test].mean())))
        return pd.DataFrame(out, columns=names)

    keys = ["serie", "fold", "bloque"]
    return spread(rows, *keys).groupBy(*keys).applyInPandas(run, "serie string, modelo string, combinacion int, fold int, n bigint, mse_train double, mse_test double")
