"""Exact quantiles of any number of columns in two passes over the rows, and scaling by them."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callstrata.session import checkpointed


def exact_quantiles(df: DataFrame, cols: Iterable[str], probs: Iterable[float], accuracy: int = 10_000) -> DataFrame:
    """(columna, prob, valor): quantiles with linear interpolation between neighbouring ranks; nulls and NaN do not count.

    The first pass brackets every rank with Spark's mergeable sketch. The second counts the rows below each bracket and the
    values inside it; only different values inside brackets are shuffled, about ``4 / accuracy`` of the rows, and equal ones combine
    first. A bracket that misses its rank is widened to the whole column, so the result never rests on the sketch.
    """
    cols, probs = list(cols), [float(p) for p in probs]
    num = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols}
    near = 2.0 / accuracy
    ends = [x for p in probs for x in (max(0.0, p - near), min(1.0, p + near))]
    first = df.agg(*[e for i, c in enumerate(cols) for e in (F.count(num[c]).alias(f"n{i}"), F.percentile_approx(num[c], F.array(*map(F.lit, ends)), accuracy).alias(f"q{i}"))]).first()
    wanted = []  # (column, prob, rank, low, high)
    for i, c in enumerate(cols):
        for j, p in enumerate(probs):
            if first[f"n{i}"]:
                wanted.append((c, p, (first[f"n{i}"] - 1) * p, first[f"q{i}"][2 * j], first[f"q{i}"][2 * j + 1]))
    spark, shape = df.sparkSession, "columna string, prob double, valor double"
    empty = spark.createDataFrame([(c, p, None) for i, c in enumerate(cols) if not first[f"n{i}"] for p in probs], shape)
    if not wanted:
        return empty
    values = checkpointed(_inside(df, num, wanted))
    below = _below(df, num, wanted)
    held = {r["k"]: r["n"] for r in values.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    missed = [k for k, (_, _, rank, _, _) in enumerate(wanted) if not below[k] <= math.floor(rank) or not math.ceil(rank) < below[k] + held.get(k, 0)]
    if missed:
        for k in missed:
            wanted[k] = (*wanted[k][:3], -math.inf, math.inf)
            below[k] = 0
        values = checkpointed(_inside(df, num, wanted))
    ranks = spark.createDataFrame([(k, c, p, float(rank), int(below[k])) for k, (c, p, rank, _, _) in enumerate(wanted)], "k int, columna string, prob double, rango double, antes long")
    upto = F.sum("n").over(Window.partitionBy("k").orderBy("v"))
    ranked = values.withColumn("hasta", upto).join(F.broadcast(ranks), "k").withColumn("hasta", F.col("hasta") + F.col("antes"))
    at = lambda rank: F.min(F.when(F.col("hasta") > rank, F.col("v")))
    low, part = F.floor("rango"), F.col("rango") - F.floor("rango")
    found = ranked.groupBy("columna", "prob", part.alias("_p")).agg(at(low).alias("_a"), at(F.ceil("rango")).alias("_b"))
    return found.select("columna", "prob", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_p")).alias("valor")).unionByName(empty)


def _inside(df: DataFrame, num: dict, wanted: list[tuple]) -> DataFrame:
    """(k, v, n): how often each value lies in the bracket number k."""
    hits = [F.when(num[c].between(lo, hi), F.struct(F.lit(k).alias("k"), num[c].alias("v"))) for k, (c, _, _, lo, hi) in enumerate(wanted)]
    return df.select(F.explode(F.array_compact(F.array(*hits))).alias("h")).groupBy("h.k", "h.v").agg(F.count(F.lit(1)).alias("n"))


def _below(df: DataFrame, num: dict, wanted: list[tuple]) -> list[int]:
    """Rows below each bracket."""
    row = df.agg(*[F.count_if(num[c] < lo).alias(f"b{k}") for k, (c, _, _, lo, _) in enumerate(wanted)]).first()
    return [row[f"b{k}"] for k in range(len(wanted))]


def robust_scaled(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Columns less their median, in units of the distance between their quartiles; 0 where the quartiles are equal."""
    cols = list(cols)
    found = {(r["columna"], r["prob"]): r["valor"] for r in exact_quantiles(df, cols, (0.25, 0.5, 0.75)).collect()}  # three figures a column

    def scaled(c: str):
        q1, q2, q3 = (found[c, p] for p in (0.25, 0.5, 0.75))
        if q2 is None:
            return F.lit(None).cast("double")
        return (F.col(c) - F.lit(q2)) / F.lit(q3 - q1) if q3 > q1 else F.col(c) * 0.0

    return df.withColumns({c: scaled(c) for c in cols})
